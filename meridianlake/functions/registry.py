"""Named drivers of embedders, rerankers, language models, tokenizers and key stores; a later one of the same name wins."""

from __future__ import annotations

import random
import time
from collections.abc import Callable


class Unknown(KeyError):
    pass


class Registry:
    def __init__(self, kind: str, **built_in: Callable):
        self.kind, self.made, self.makers = kind, {}, dict(built_in)

    def extend(self, name: str, maker: Callable) -> None:
        self.makers[name] = maker
        self.made.pop(name, None)

    def get(self, name: str):
        """The driver of that name, made once."""
        if name not in self.made:
            if name not in self.makers:
                raise Unknown(f"no {self.kind} named {name!r}")
            self.made[name] = self.makers[name]()
        return self.made[name]

    def forget(self) -> None:
        self.made.clear()


class Refused(Exception):
    """A remote service's answer; status 0 stands for no answer at all."""

    def __init__(self, status: int, message: str = ""):
        super().__init__(message or f"status {status}")
        self.status = status

    @property
    def again(self) -> bool:
        return self.status in (0, 429) or self.status >= 500


def retrying(call: Callable, attempts: int = 3, wait: float = 0.1, sleep: Callable = time.sleep) -> Callable:
    """call, tried again after overload and server errors with doubling waits; other refusals are final."""

    def run(*args):
        for n in range(1, attempts + 1):
            try:
                return call(*args)
            except Refused as e:
                if not e.again or n == attempts:
                    raise
                pause = wait * 2 ** (n - 1)
                sleep(pause + random.uniform(0, pause / 2))

    return run
