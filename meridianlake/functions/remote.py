"""Clients of remote embedding, rerank, language-model and vector services.

A client is a function that runs in Arrow batches on the executors. How a request travels is a parameter: `transport` takes
(url, headers, body) and gives (status, text); the default uses urllib. Secrets are parameters too.
"""

from __future__ import annotations

import json
import math
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from .filters import remote_filter
from .registry import Refused, retrying

Transport = Callable[[str, dict, dict], tuple[int, str]]


def http(url: str, headers: dict, body: dict, timeout: float = 30) -> tuple[int, str]:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.status, answer.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode("utf-8", "replace")
    except OSError:
        return 0, ""


def post(transport: Transport, url: str, headers: dict, body: dict) -> dict:
    status, text = transport(url, headers, body)
    if not 200 <= status < 300:
        raise Refused(status, f"{url} answered {status}")
    try:
        return json.loads(text)
    except ValueError:
        raise Refused(status, f"{url} gave no JSON") from None


def by_index(rows: list[dict], value: str) -> list:
    """Values of an answer's rows in the order of their `index`, which need not be the order in which they come."""
    return [r[value] for _, r in sorted(enumerate(rows), key=lambda x: (x[1].get("index", x[0]), x[0]))]


# Where services are asked, what the texts are called in the request, and where the vectors are in the answer.
EMBEDDING_FORMS = {
    "openai": ("/v1/embeddings", lambda m, t: {"model": m, "input": t}, lambda a: by_index(a["data"], "embedding")),
    "azure-openai": ("/embeddings?api-version=2024-02-01", lambda m, t: {"input": t}, lambda a: by_index(a["data"], "embedding")),
    "mistral": ("/v1/embeddings", lambda m, t: {"model": m, "input": t}, lambda a: by_index(a["data"], "embedding")),
    "jina": ("/v1/embeddings", lambda m, t: {"model": m, "input": t}, lambda a: by_index(a["data"], "embedding")),
    "voyage": ("/v1/embeddings", lambda m, t: {"model": m, "input": t}, lambda a: by_index(a["data"], "embedding")),
    "cohere": ("/v2/embed", lambda m, t: {"model": m, "texts": t, "input_type": "search_document", "embedding_types": ["float"]}, lambda a: a["embeddings"]["float"]),
    "gemini": (":batchEmbedContents", lambda m, t: {"requests": [{"model": m, "content": {"parts": [{"text": x}]}} for x in t]}, lambda a: [e["values"] for e in a["embeddings"]]),
    "huggingface": ("", lambda m, t: {"inputs": t}, lambda a: a),
    "ollama": ("/api/embed", lambda m, t: {"model": m, "input": t}, lambda a: a["embeddings"]),
}


def embedder(form: str, base: str, model: str, headers: dict | None = None, transport: Transport = http, attempts: int = 3) -> Callable[[list[str]], list[list[float]]]:
    """Provider of vectors for operators.embedding; another number of vectors than texts is an error."""
    path, ask, read = EMBEDDING_FORMS[form]

    def call(texts: list[str]) -> list[list[float]]:
        vectors = read(post(transport, base.rstrip("/") + path, headers or {}, ask(model, texts)))
        if len(vectors) != len(texts):
            raise ValueError(f"{form} gave {len(vectors)} vectors for {len(texts)} texts")
        return vectors

    return retrying(call, attempts)


def embedding_usage(texts: list[str], rate_per_1000: float = 0.0) -> tuple[int, float]:
    """Estimated tokens, a quarter of the characters of each text, and what they cost."""
    tokens = sum(math.ceil(len(t) / 4) for t in texts)
    return tokens, tokens / 1000 * rate_per_1000


# Paths of rerank services.
RERANK_PATHS = {"cohere": "/v2/rerank", "jina": "/v1/rerank"}


def reranker(form: str, base: str, model: str, headers: dict | None = None, transport: Transport = http, attempts: int = 3) -> Callable[[str, list[str], int], list[tuple[int, float]]]:
    """(query, texts, k) -> places from 0 and scores, best first; places that no text has are skipped."""

    def call(query: str, texts: list[str], k: int) -> list[tuple[int, float]]:
        if not texts:
            return []
        answer = post(transport, base.rstrip("/") + RERANK_PATHS[form], headers or {}, {"model": model, "query": query, "documents": texts, "top_n": k})
        return [(r["index"], float(r["relevance_score"])) for r in answer.get("results", ()) if isinstance(r.get("index"), int) and 0 <= r["index"] < len(texts)]

    return retrying(call, attempts)


class Model:
    """A language model: `generate` a whole answer or `stream` its pieces. Streams aren't tried again."""

    name = "null"

    def generate(self, prompt: str) -> str:
        return ""

    def stream(self, prompt: str) -> Iterator[str]:
        yield from ()


class StubModel(Model):
    name = "stub"

    def generate(self, prompt: str) -> str:
        return "ANSWER: " + prompt.strip()[:80]

    def stream(self, prompt: str) -> Iterator[str]:
        for k, word in enumerate(self.generate(prompt).split(" ")):
            yield word if k == 0 else " " + word


class HttpModel(Model):
    """Services with a messages or a chat-completions interface. `lines` gives the lines of a streamed answer."""

    # Path, and where the text is in an answer and in a streamed piece.
    FORMS = {
        "messages": ("/v1/messages", lambda a: "".join(p.get("text", "") for p in a.get("content", ())), lambda e: e.get("delta", {}).get("text", "") if e.get("type") == "content_block_delta" else ""),
        "chat": ("/v1/chat/completions", lambda a: a["choices"][0]["message"]["content"] if a.get("choices") else "", lambda e: (e["choices"][0].get("delta", {}).get("content") or "") if e.get("choices") else ""),
    }

    def __init__(self, form: str, base: str, name: str, headers: dict | None = None, most_tokens: int = 1024, transport: Transport = http, lines: Callable[[str, dict, dict], Iterator[str]] | None = None, attempts: int = 3):
        self.path, self.read, self.piece = self.FORMS[form]
        self.base, self.name, self.headers, self.most, self.transport, self.lines, self.attempts = base.rstrip("/"), name, headers or {}, most_tokens, transport, lines, attempts

    def _body(self, prompt: str, **more) -> dict:
        return {"model": self.name, "max_tokens": self.most, "messages": [{"role": "user", "content": prompt}], **more}

    def generate(self, prompt: str) -> str:
        return retrying(lambda p: self.read(post(self.transport, self.base + self.path, self.headers, self._body(p))), self.attempts)(prompt)

    def stream(self, prompt: str) -> Iterator[str]:
        if self.lines is None:
            yield self.generate(prompt)
            return
        for event in events(self.lines(self.base + self.path, self.headers, self._body(prompt, stream=True))):
            if text := self.piece(event):
                yield text


def events(lines: Iterator[str]) -> Iterator[dict]:
    """JSON events of a stream of `data:` lines up to [DONE]; lines that can't be read are skipped."""
    for line in lines:
        if not line.startswith("data:"):
            continue
        data = line[5:].strip()
        if data == "[DONE]":
            return
        try:
            event = json.loads(data)
        except ValueError:
            continue
        if isinstance(event, dict):
            yield event


def vector_service(base: str, headers: dict | None = None, transport: Transport = http, attempts: int = 3) -> Callable[[str, list[float], int, dict, float | None], list[tuple[str, float, dict]]]:
    """(namespace, vector, k, filters, threshold) -> (id, score, payload), best first. Filters beyond equality, lists and ranges are refused."""

    def call(namespace: str, vector: list[float], k: int, filters: dict, threshold: float | None) -> list[tuple[str, float, dict]]:
        body: dict = {"vector": vector, "limit": max(1, k), "with_payload": True}
        if told := remote_filter(filters):
            body["filter"] = told
        if threshold is not None:
            body["score_threshold"] = threshold
        answer = post(transport, f"{base.rstrip('/')}/collections/{namespace}/points/search", headers or {}, body)
        return [(str(r["id"]), float(r["score"]), r.get("payload") or {}) for r in answer.get("result", ())][: max(0, k)]

    return retrying(call, attempts)


def wordings(model: Model, n: int) -> Callable[[str], list[str]]:
    """Query -> itself and up to n other wordings by the model, one per line, without repeats; the null model gives none."""

    def run(query: str) -> list[str]:
        answer = model.generate(f"Rewrite the question in {n} other ways, one per line:\n{query}") if n > 0 else ""
        lines = [line.strip() for line in answer.split("\n") if line.strip()]
        return list(dict.fromkeys([query, *lines]))[: n + 1]

    return run
