"""Envelope encryption: a random data key for each payload, wrapped by a versioned key of its tenant; rotation, destruction, tenants.

Key tables are small (a few versions of a tenant's key) and joined by tenant; payloads never leave their rows.
"""

from __future__ import annotations

import base64
import contextlib
import contextvars
import hashlib
import json
import os
import secrets
import tempfile
from collections.abc import Callable, Iterator
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.registry import Registry
from .store import decrypt, encrypt


class KeyStore(Protocol):
    """Versions of the keys of tenants, oldest first, as base64 of 32 bytes."""

    def load(self) -> dict[str, list[str]]: ...

    def save(self, keys: dict[str, list[str]]) -> None: ...


class MemoryStore:
    def __init__(self):
        self.keys: dict[str, list[str]] = {}

    def load(self):
        return {k: list(v) for k, v in self.keys.items()}

    def save(self, keys):
        self.keys = {k: list(v) for k, v in keys.items()}


class FileStore:
    """Keys in one file that only its owner may read, replaced as a whole: AES-GCM under a hash of the master secret, or plain base64 without one."""

    def __init__(self, spark: SparkSession, path: str, master: str | None = None):
        self.spark, self.path, self.master = spark, path, master

    def _aes(self, function: Callable, raw: bytes) -> bytes | None:
        key = hashlib.sha256(self.master.encode()).digest()
        return self.spark.range(1).select(function(F.lit(raw), F.lit(key), F.lit("GCM"), F.lit("DEFAULT")).alias("x")).first()["x"]

    def load(self):
        if not os.path.exists(self.path):
            return {}
        with open(self.path, "rb") as f:
            raw = base64.b64decode(f.read())
        if self.master is not None:
            raw = self._aes(F.try_aes_decrypt, raw)
            if raw is None:
                raise ValueError("the key file can't be read with this secret")
        return json.loads(bytes(raw))

    def save(self, keys):
        raw = json.dumps(keys).encode()
        if self.master is not None:
            raw = bytes(self._aes(F.aes_encrypt, raw))
        handle, name = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(self.path)))
        with os.fdopen(handle, "wb") as f:
            f.write(base64.b64encode(raw))
        os.chmod(name, 0o600)
        os.replace(name, self.path)


class Keys:
    """Versioned keys of tenants: the newest wraps, all of them unwrap, newest first."""

    def __init__(self, store: KeyStore):
        self.store = store

    def create(self, tenant: str) -> None:
        if not self.exists(tenant):
            self.rotate(tenant)

    def exists(self, tenant: str) -> bool:
        return bool(self.store.load().get(tenant))

    def rotate(self, tenant: str) -> int:
        """A further version; its number."""
        keys = self.store.load()
        keys.setdefault(tenant, []).append(base64.b64encode(secrets.token_bytes(32)).decode())
        self.store.save(keys)
        return len(keys[tenant])

    def destroy(self, tenant: str) -> None:
        """Without its keys nothing of the tenant can be read again, backups included."""
        keys = self.store.load()
        keys.pop(tenant, None)
        self.store.save(keys)

    def table(self, spark: SparkSession) -> DataFrame:
        """(tenant_id, version, kek): one row for each version."""
        rows = [(t, n + 1, base64.b64decode(k)) for t, versions in self.store.load().items() for n, k in enumerate(versions)]
        return spark.createDataFrame(rows, "tenant_id string, version int, kek binary")


KEY_SERVICES = Registry("key service", local=lambda: Keys(MemoryStore()))


def fresh_key(seed: Column) -> Column:
    """A random data key of 32 bytes for each row."""
    return F.unhex(F.sha2(F.concat_ws(":", F.uuid(), F.uuid(), seed).cast("binary"), 256))


def seal(rows: DataFrame, keys: DataFrame, content: str = "content") -> DataFrame:
    """rows with `payload`, `wrapped_key` and `key_version` in place of the content: a key of its own for each payload.

    A tenant without a key is an error: nothing is ever written in the clear.
    """
    newest = keys.withColumn("_n", F.row_number().over(Window.partitionBy("tenant_id").orderBy(F.desc("version")))).where("_n = 1").select("tenant_id", "version", "kek")
    kept = [c for c in rows.columns if c != content]
    keyed = rows.join(newest, "tenant_id", "left").select(*kept, content, F.col("version").alias("key_version"), "kek", fresh_key(F.col(content)).alias("_dek"))
    # A random key is used twice: it passes through Arrow once, so that the planner can't draw it again.
    fixed = keyed.mapInArrow(lambda batches: batches, keyed.schema)
    kek = F.when(F.col("kek").isNull(), F.raise_error(F.lit("a tenant has no key")).cast("binary")).otherwise(F.col("kek"))
    return fixed.select(*kept, "key_version", encrypt(F.col(content).cast("binary"), F.col("_dek")).alias("payload"), encrypt(F.col("_dek"), kek).alias("wrapped_key"))


def _unwrapped(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """rows with `_dek`, by the newest version of the tenant's key that opens the wrapped key; null where none does."""
    versions = keys.groupBy("tenant_id").agg(F.sort_array(F.collect_list(F.struct("version", "kek")), asc=False).alias("_keys"))  # a few versions
    opened = F.filter(F.transform("_keys", lambda k: F.try_aes_decrypt(F.unbase64("wrapped_key"), k["kek"], F.lit("GCM"), F.lit("DEFAULT"))), lambda x: x.isNotNull())
    return rows.join(versions, "tenant_id", "left").withColumn("_dek", F.try_element_at(F.coalesce(opened, F.array().cast("array<binary>")), F.lit(1))).drop("_keys")


def unseal(rows: DataFrame, keys: DataFrame, tenant: str | None = None) -> DataFrame:
    """rows with `content`; null for a wrong or destroyed key and a changed payload. tenant: rows of others are refused."""
    if tenant is not None:
        rows = rows.withColumn("tenant_id", F.when(F.col("tenant_id").eqNullSafe(F.lit(tenant)), F.col("tenant_id")).otherwise(F.raise_error(F.lit("content of another tenant")).cast("string")))
    return _unwrapped(rows, keys).withColumn("content", decrypt(F.col("payload"), F.col("_dek"))).drop("_dek")


def stored_text(payload: Column, wrapped: Column, opened: Column) -> Column:
    """Content of a stored reference: empty for none, plain base64 where nothing was wrapped, else what was opened."""
    return F.when(payload.isNull(), F.lit("")).when(wrapped.isNull(), F.unbase64(payload).cast("string")).otherwise(opened)


def rewrap(rows: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with their data keys wrapped by the newest version, rows whose key can't be opened). Payloads stay as they are."""
    newest = keys.withColumn("_n", F.row_number().over(Window.partitionBy("tenant_id").orderBy(F.desc("version")))).where("_n = 1").select("tenant_id", F.col("version").alias("_version"), "kek")
    both = _unwrapped(rows, keys).join(newest, "tenant_id", "left")
    good = both.where("_dek is not null").withColumn("wrapped_key", encrypt(F.col("_dek"), F.col("kek"))).withColumn("key_version", F.col("_version"))
    return good.select(*rows.columns), both.where("_dek is null").select(*rows.columns)


class NoTenant(RuntimeError):
    pass


class Tenants:
    """The tenant in whose name plans are built: a default, or, in strict mode, only one that was set."""

    ISOLATION = ("namespace",)

    def __init__(self, default: str | None = None, strict: bool = False, isolation: str = "namespace"):
        if isolation not in self.ISOLATION:
            raise ValueError(f"isolation must be one of {self.ISOLATION}, not {isolation!r}")
        self.default, self.strict = default, strict
        self.held: contextvars.ContextVar[str | None] = contextvars.ContextVar("tenant", default=None)

    def set(self, tenant: str) -> None:
        self.held.set(tenant)

    def forget(self) -> None:
        self.held.set(None)

    def current(self) -> str:
        named = self.held.get() or (None if self.strict else self.default)
        if named is None:
            raise NoTenant("no tenant is set")
        return named

    @contextlib.contextmanager
    def as_tenant(self, tenant: str) -> Iterator[None]:
        before = self.held.set(tenant)
        try:
            yield
        finally:
            self.held.reset(before)

    def run_as(self, tenant: str, call: Callable):
        with self.as_tenant(tenant):
            return call()

    def only(self, rows: DataFrame) -> DataFrame:
        """Rows of the current tenant: its name goes into the plan as a literal, so it reaches the scan."""
        return rows.where(F.col("tenant_id") == self.current())


def shred_tenants(tables: dict[str, DataFrame], tenants: DataFrame, service: Keys | None = None, reason: str | None = None, at: Column | None = None) -> dict[str, DataFrame]:
    """Every table without the tenants' rows, their keys destroyed, and under `shredded` and `audit` the rows to register.

    The list of tenants is an instruction of an administrator, not data: at most 10,000 at once.
    """
    from .store import shred

    named = [r["tenant_id"] for r in tenants.select("tenant_id").distinct().limit(10_001).collect()]
    if len(named) > 10_000:
        raise ValueError("more than 10,000 tenants: shred them in several calls")
    for tenant in named if service is not None else ():
        service.destroy(tenant)
    when = at if at is not None else F.current_timestamp()
    gone = tenants.select("tenant_id").distinct()
    note = F.to_json(F.struct(F.lit(reason).alias("reason")))
    return shred(tables, tenants) | {"shredded": gone.withColumn("shredded_at", when), "audit": gone.select("tenant_id", F.lit("tenant.shredded").alias("action"), F.col("tenant_id").alias("target"), note.alias("context"), when.alias("created"))}
