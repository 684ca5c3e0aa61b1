"""Most similar vectors by multi-index hashing.

Binary codes are learned on a bounded sample: for each block of bits the rotation that loses least when only signs are kept.
The vectors of a namespace are dealt to shards of about SHARD_ROWS by a hash of their id. A shard cuts its codes of BITS bits
into substrings of log2(rows) bits and indexes each of them; a code within Hamming distance m * (r + 1) - 1 of a query differs
in some of the m substrings by at most r bits, so looking up every key within r bits of the query's substrings finds all of
them. The radius grows until twice k codes lie within the distance that is covered, or to the last radius; whatever the probes
met is reranked by the floats, without a limit on their number. Shards below SMALL rows have no use for an index: all their
codes are within reach.

Every query meets every shard of its namespace, in blocks: queries are copied to the shards, vectors move once. Nothing but the
rotations (of a sample of fixed size) is sent to all executors.
"""

from __future__ import annotations

import zlib
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_sample, small

BITS = 256
SHARD_ROWS = 60_000
SMALL = 512
QUERIES_IN_BLOCK = 20_000
FILTER_BITS = 1 << 22


def learn(X: np.ndarray, rounds: int = 20, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection of unit vectors to BITS signed axes: one rotation after the other, each from another start."""
    rng = np.random.default_rng(seed)
    d = X.shape[1]
    mean = X.mean(0) if len(X) else np.zeros(d)
    Z = X - mean
    out = []
    for _ in range(-(-BITS // d)):
        R = np.linalg.qr(rng.normal(size=(d, d)))[0]
        for _ in range(rounds if len(X) > d else 0):
            U, _, W = np.linalg.svd(np.sign(Z @ R).T @ Z)
            R = W.T @ U.T
        out.append(R)
    return mean.astype(np.float32), np.hstack(out)[:, :BITS].astype(np.float32)


def encode(X: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Signs on the learned axes, one row of BITS booleans for each vector."""
    return (X - model[0]) @ model[1] > 0


@lru_cache(maxsize=64)
def masks(bits: int, radius: int) -> np.ndarray:
    """All changes of a substring of `bits` bits by exactly `radius` bits."""
    return np.array([sum(1 << b for b in chosen) for chosen in combinations(range(bits), radius)], dtype=np.int64)


def last_radius(bits: int) -> int:
    """The largest radius whose ball is at most a 28th of all substrings: beyond it, probing meets most of the rows anyway."""
    r, ball = 0, 1
    while r < bits and 28 * (ball + comb(bits, r + 1)) <= 1 << bits:
        r += 1
        ball += comb(bits, r)
    return r


class Index:
    """The codes of one shard, cut into substrings, each with its buckets."""

    def __init__(self, X: np.ndarray, model: tuple[np.ndarray, np.ndarray]):
        self.X, self.model = X, model
        self.sub = max(1, min(16, round(np.log2(max(2, len(X))))))
        self.parts = BITS // self.sub
        code = encode(X, model)
        self.code = np.packbits(code, axis=1).view(np.uint64)
        self.buckets = []
        for key in self.keys(code).T:
            order = np.argsort(key, kind="stable").astype(np.int32)
            self.buckets.append((np.searchsorted(key[order], np.arange((1 << self.sub) + 1)), order))

    def keys(self, code: np.ndarray) -> np.ndarray:
        powers = 1 << np.arange(self.sub, dtype=np.int64)
        return code[:, : self.parts * self.sub].reshape(len(code), self.parts, self.sub) @ powers

    def near(self, q: np.ndarray, k: int) -> np.ndarray:
        """Rows whose codes the probes around the query's code meet."""
        if len(self.X) <= SMALL:
            return np.arange(len(self.X))
        code = encode(q[None, :], self.model)
        own, packed = self.keys(code)[0], np.packbits(code, axis=1).view(np.uint64)[0]
        met = np.zeros(len(self.X), dtype=bool)
        for radius in range(last_radius(self.sub) + 1):
            around = masks(self.sub, radius)
            for (starts, order), key in zip(self.buckets, own):
                probes = around ^ key
                a, n = starts[probes], starts[probes + 1] - starts[probes]
                total = int(n.sum())
                if total:
                    met[order[np.repeat(a - np.cumsum(n) + n, n) + np.arange(total)]] = True
            found = np.flatnonzero(met)
            if len(found) > 2 * k and np.count_nonzero(np.bitwise_count(self.code[found] ^ packed).sum(1) < self.parts * (radius + 1)) > 2 * k:
                break
        return found

    def best(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k + 1 most similar of the rows met, with all that is as similar as the last of them."""
        rows = self.near(q, k)
        score = np.round((self.X[rows] * q).sum(1, dtype=np.float64), 9)
        if len(rows) > k + 1:
            keep = score >= np.partition(score, len(score) - k - 1)[len(score) - k - 1]
            rows, score = rows[keep], score[keep]
        return rows, score


def valid(vectors: DataFrame, namespaces: DataFrame) -> DataFrame:
    """(id, namespace, v) of the vectors that have their namespace's length and aren't all zero."""
    sizes = small(namespaces.select(F.col("namespace").cast("string").alias("of"), F.col("dimensions").cast("int").alias("dimensions")).dropDuplicates(["of"]))
    rows = vectors.select(F.col("id").cast("string").alias("id"), F.col("namespace").cast("string").alias("namespace"), F.col("embedding").cast("array<float>").alias("v")).where("id is not null and namespace is not null and v is not null")
    usable = (F.size("v") == F.col("dimensions")) & F.exists("v", lambda x: x != 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x))
    return rows.join(sizes, F.col("namespace") == F.col("of")).where(usable).select("id", "namespace", "v")


def _unit(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    X = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(column), -1)
    return X / np.linalg.norm(X, axis=1, keepdims=True)


def _models(rows: DataFrame, sample_rows: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """One projection for each length of vectors in a sample of at most sample_rows."""
    sample, by = bounded_sample(rows, "id", sample_rows, rows.count()).select("v").toArrow(), {}
    lengths = np.asarray(pa.compute.list_value_length(sample.column("v"))) if len(sample) else np.zeros(0)
    for n in np.unique(lengths):
        by[int(n)] = learn(_unit(sample.filter(pa.array(lengths == n)).column("v")))
    return by


def nearest(vectors: DataFrame, namespaces: DataFrame, queries: DataFrame, k: int = 10, sample_rows: int = 20_000) -> DataFrame:
    """(query, id, similarity, rank): the k other ids of the same namespace with the highest cosine similarity to each query id.

    queries: one column `query` of ids. Vectors that are null, zero, of a wrong length or hold no numbers take no part, nor do
    queries for them. An id delivered twice counts once, identical vectors of other ids are neighbours like any. Similarities
    are rounded to nine digits; equal ones are ordered by id. The neighbours of a namespace with fewer than k other ids are all
    of them. Other columns are ignored; either table may be empty.
    """
    rows = valid(vectors, namespaces)
    held = rows.sparkSession.sparkContext.broadcast(_models(rows, sample_rows))
    ids = queries.select(F.col("query").cast("string").alias("query")).where("query is not null").distinct()
    asked = _only(rows, ids.select(F.col("query").alias("id"))).join(ids, F.col("id") == F.col("query")).select("query", F.col("namespace").alias("within"), F.col("v").alias("q")).dropDuplicates(["query"])
    # One row for each namespace.
    counts = rows.groupBy("namespace").agg(F.count("*").alias("n")).select("namespace", F.ceil(F.col("n") / SHARD_ROWS).cast("int").alias("shards"))
    blocks = asked.groupBy(F.col("within").alias("namespace")).agg(F.count("*").alias("n")).select("namespace", F.ceil(F.col("n") / QUERIES_IN_BLOCK).cast("int").alias("blocks"))
    dealt = small(counts.join(blocks, "namespace"))
    left = rows.join(dealt, "namespace").select("id", "namespace", "v", F.pmod(F.xxhash64("id"), F.col("shards")).alias("shard"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    right = asked.join(dealt.withColumnRenamed("namespace", "within"), "within").select("query", "within", "q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards").cast("long") - 1)).alias("shard"), F.pmod(F.xxhash64("query"), F.col("blocks")).cast("int").alias("block"))

    def run(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(ours) and len(theirs):
            X, Q = _unit(ours.column("v")), _unit(theirs.column("q"))
            names, first = np.unique(np.asarray(ours.column("id").to_pylist(), dtype=object).astype(str), return_index=True)
            index = Index(X[first], held.value.get(X.shape[1]) or learn(np.zeros((0, X.shape[1]), dtype=np.float32)))
            asked_ = np.asarray(theirs.column("query").to_pylist(), dtype=object).astype(str)
            for name, q in zip(asked_, Q):
                at, score = index.best(q, k)
                other = names[at] != name
                at, score = at[other], score[other]
                order = np.lexsort((at, -score))[:k]  # names are in order, so rows are
                got.append((np.full(len(order), name), names[at[order]], score[order]))
        query, other, score = (np.concatenate(x) for x in zip(*got)) if got else (np.zeros(0, str), np.zeros(0, str), np.zeros(0))
        return pa.table({"query": pa.array(query.astype(object), pa.string()), "id": pa.array(other.astype(object), pa.string()), "similarity": pa.array(score, pa.float64())})

    found = left.groupBy("namespace", "shard", "block").cogroup(right.groupBy("within", "shard", "block")).applyInArrow(run, "query string, id string, similarity double")
    best = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id's hash is among those of `ids`."""
    h = F.pmod(F.crc32(F.col("id").cast("binary")), F.lit(FILTER_BITS))
    got = ids.select(h.alias("h")).groupBy(F.expr("int(h div 64)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, int(h % 64)))").alias("b")).toPandas()  # at most FILTER_BITS / 64 rows
    bits = np.zeros(FILTER_BITS // 64, dtype=np.uint64)
    bits[got["w"].to_numpy(dtype=np.int64)] = got["b"].to_numpy(dtype=np.int64).view(np.uint64) if len(got) else 0
    held = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        for batch in batches:
            places = np.array([zlib.crc32(x.encode()) % FILTER_BITS for x in batch.column("id").to_pylist()], dtype=np.int64)
            yield batch.filter(pa.array((held.value[places >> 6] >> (places & 63).astype(np.uint64) & np.uint64(1)).astype(bool)))

    return rows.mapInArrow(run, rows.schema)


def found(vectors: DataFrame, namespaces: DataFrame, probes: DataFrame, k: int = 10) -> DataFrame:
    near = nearest(vectors, namespaces, probes.select(F.col("id").alias("query")), k)
    return probes.select(F.col("probe_id").cast("long").alias("probe_id"), F.col("id").cast("string").alias("query")).distinct().join(near.select("query", "id"), "query").select("probe_id", "id")


def every_hundredth(vectors: DataFrame) -> DataFrame:
    """The stated query set for ids that aren't numbers: those whose CRC-32 is divisible by 100."""
    return vectors.select(F.col("id").cast("string").alias("query")).where(F.crc32(F.col("query").cast("binary")) % 100 == 0).distinct()
