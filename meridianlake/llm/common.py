"""Helpers shared by the training-data operators."""

from __future__ import annotations

import json
import re
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import settled as cut

__all__ = ["bounded_sample", "cut", "parse_json", "read", "rid_of_shuffles", "sentence_spans", "small"]

SENTENCE_END = re.compile(r"(?<=[.!?…])[\"'»”’)\]]*\s+|\n[ \t]*\n\s*")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Rows of a few fields each that may be sent to all executors: below some 100 MB.
SMALL_ROWS = 500_000


def small(df: DataFrame) -> DataFrame:
    """df with a hint to broadcast it if it has at most SMALL_ROWS rows; a larger one is joined as any table."""
    held = cut(df)
    return F.broadcast(held) if held.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else held


@contextmanager
def rid_of_shuffles(spark: SparkSession):
    """Inside, the shuffle files of each action are removed as soon as it has ended, not when the driver next collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of each sentence; blanks between sentences belong to none."""
    spans, at = [], 0
    for m in SENTENCE_END.finditer(text):
        if m.start() > at:
            spans.append((at, m.start()))
        at = m.end()
    if at < len(text):
        spans.append((at, len(text)))
    return [(a, b) for a, b in spans if text[a:b].strip()]


def parse_json(text: str | None) -> dict | None:
    """The object in text, also when it was encoded twice; None for null, cut off or other values."""
    for _ in range(2):
        if not isinstance(text, str):
            break
        try:
            text = json.loads(text)
        except ValueError:
            return None
    return text if isinstance(text, dict) else None


def bounded_sample(df: DataFrame, key: str, rows: int, total: int) -> DataFrame:
    """At most `rows` rows, chosen by a hash of the key: the same ones on every run and for every partitioning.

    total: about how many rows df has; a share of the hashes is taken first, so that no task passes on more than its part.
    """
    share = min(1.0, 4 * rows / max(1, total))
    part = F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1_000_000)) < int(share * 1_000_000) + 1
    return df.where(part).orderBy(F.xxhash64(key), key).limit(rows)
