"""Embedding of texts by a provider: distinct texts in batches, a cache table of what is known, usage by batch.

A provider is a function from a list of texts to a list of vectors. The deterministic one needs no service; others are
registered under a name.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.registry import Registry, retrying
from ..functions.text import count_tokens


def deterministic(dimensions: int = 8, model: str = "fake-embed-v1") -> Callable[[list[str]], list[list[float]]]:
    def one(text: str) -> list[float]:
        raw = [int(hashlib.sha256(f"{model}:{i}:{text}".encode()).hexdigest()[:8], 16) / 0xFFFFFFFF * 2 - 1 for i in range(dimensions)]
        size = math.sqrt(sum(x * x for x in raw))
        return [x / size for x in raw] if size > 0 else raw

    return lambda texts: [one(t) for t in texts]


EMBEDDERS = Registry("embedder", deterministic=deterministic)


def cache_key(tenant: Column, text: Column, identity: str, model: str, dimensions: int) -> Column:
    return F.sha2(F.concat_ws(":", tenant, F.lit(identity), F.lit(model), F.lit(str(dimensions)), text), 256)


KNOWN = "key string, text string, v array<double>, tokens long"


def embed_texts(rows: DataFrame, provider: Callable[[list[str]], list[list[float]]], dimensions: int, batch: int = 96, attempts: int = 3) -> DataFrame:
    """(key, text, v, tokens) for rows of (key, text). A wrong number or length of vectors is an error; null texts are left out."""
    call = retrying(provider, attempts)

    def run(frames):
        for pdf in frames:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                vectors = call(part["text"].tolist())
                if len(vectors) != len(part) or any(len(v) != dimensions for v in vectors):
                    raise ValueError(f"provider gave {len(vectors)} vectors for {len(part)} texts, or not of {dimensions} dimensions")
                yield pd.DataFrame({"key": part["key"], "text": part["text"], "v": vectors, "tokens": [count_tokens(t) for t in part["text"]]})

    return rows.where("text is not null").select("key", "text").mapInPandas(run, KNOWN)


#: Days for which a cached vector is good.
TTL_DAYS = 30


def with_cache(chunks: DataFrame, cache: DataFrame | None, provider, dimensions: int, identity: str = "deterministic", model: str = "fake-embed-v1", batch: int = 96, now: Column | None = None, days: int = TTL_DAYS) -> tuple[DataFrame, DataFrame]:
    """(chunks with v and used tokens, new cache rows). chunks: tenant_id, text. Each distinct text is embedded once; hits cost nothing.

    Cache rows older than `days` by their `made_at` don't count; rows without that column are good for ever.
    """
    keyed = chunks.withColumn("key", cache_key(F.coalesce("tenant_id", F.lit("")), F.coalesce("text", F.lit("")), identity, model, dimensions))
    wanted = keyed.where("text is not null").select("key", "text").dropDuplicates(["key"])
    if cache is not None:
        if "made_at" in cache.columns:
            cache = cache.where(F.col("made_at") > (F.current_timestamp() if now is None else now) - F.make_dt_interval(F.lit(days)))
        cache = cache.dropDuplicates(["key"])
        wanted = wanted.join(cache.select("key"), "key", "left_anti")
    fresh = embed_texts(wanted, provider, dimensions, batch)
    known = fresh.select("key", "v", "tokens")
    if cache is not None:
        known = known.unionByName(cache.select("key", "v", F.lit(0).cast("long").alias("tokens")))
    return keyed.join(known, "key", "left"), fresh


def clear_cache(cache: DataFrame, tenant: str | None = None) -> DataFrame:
    """Cache rows that stay: all but those tagged with the tenant, or none. A cache without tags is cleared as a whole."""
    if tenant is None or "tenant_id" not in cache.columns:
        return cache.limit(0)
    return cache.where(~F.col("tenant_id").eqNullSafe(F.lit(tenant)))
