"""Documents into containers of fixed capacity, by lexical retrieval packing.

Texts are measured in tokens of a public tokenizer. Shards of neighbouring sources hold a bounded number of documents each,
whatever their source's size. A shard's inverted index scores documents by BM25 over their tokens; each container is
seeded with the largest unused item, filled greedily with the seed's best neighbours of those still unused that fit, and
topped up with the largest unused item that fits. Only texts larger than the capacity are split: into full containers and a rest,
which is an item like any other.
"""

from __future__ import annotations

import base64
import math
from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern that cuts text before byte-pair merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Windows are settings, not data; more of them are refused.
MOST_WINDOWS = 1000

_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        _ENCODERS[path] = tiktoken.Encoding("tokens", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


class Index:
    """Inverted index with BM25 weights over the documents of a shard."""

    def __init__(self, tokens: list[np.ndarray], k1: float = 1.2, b: float = 0.75, keep: int = 48):
        self.n, self.keep = len(tokens), keep
        lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        vocabulary = int(max((int(t.max()) for t in tokens if len(t)), default=0)) + 1
        pairs = np.repeat(np.arange(self.n), lengths) * vocabulary + (np.concatenate(tokens).astype(np.int64) if self.n else 0)
        pair, tf = np.unique(pairs, return_counts=True)
        self.doc, self.term = pair // vocabulary, pair % vocabulary
        df = np.bincount(self.term, minlength=vocabulary)
        self.idf = np.log1p((self.n - df + 0.5) / (df + 0.5))
        norm = k1 * (1 - b + b * lengths / max(1.0, lengths.mean() if self.n else 1.0))
        self.weight = (self.idf[self.term] * tf * (k1 + 1) / (tf + norm[self.doc])).astype(np.float32)
        self.rows = np.searchsorted(self.doc, np.arange(self.n + 1))
        order = np.argsort(self.term, kind="stable")
        self.by_term, self.by_weight = self.doc[order], self.weight[order]
        self.starts = np.searchsorted(self.term[order], np.arange(vocabulary + 1))
        # Terms that stand in a quarter of the documents and more as full rows: these are added faster than lists.
        often = np.flatnonzero(4 * df > self.n)
        self.row_of = np.full(vocabulary, -1)
        self.row_of[often] = np.arange(len(often))
        self.often = np.zeros((len(often), self.n))
        inside = self.row_of[self.term] >= 0
        self.often[self.row_of[self.term[inside]], self.doc[inside]] = self.weight[inside]
        self.known: dict[int, np.ndarray] = {}

    def scores(self, d: int) -> np.ndarray:
        """Scores of all documents over all terms of document d, 0 without a common term and for d itself."""
        if d not in self.known:
            terms = self.term[self.rows[d] : self.rows[d + 1]]
            full = self.row_of[terms]
            spans = [slice(self.starts[t], self.starts[t + 1]) for t in terms[full < 0].tolist()]
            score = self.often[full[full >= 0]].sum(axis=0)
            if spans:
                score += np.bincount(np.concatenate([self.by_term[s] for s in spans]), weights=np.concatenate([self.by_weight[s] for s in spans]), minlength=self.n)
            score[d] = 0
            self.known[d] = score
        return self.known[d]

    def neighbours(self, d: int, free: np.ndarray | None = None):
        """Documents (of those that are free) that share a term with document d, best first, `keep` at a time."""
        score = self.scores(d)
        left = np.flatnonzero(score > 0 if free is None else free & (score > 0))
        own = score[left]
        if len(left) > self.keep:
            # The first ones mostly do: they are told without sorting the rest.
            top = own >= -np.partition(-own, self.keep - 1)[self.keep - 1]
            order = np.flatnonzero(top)[np.argsort(-own[top], kind="stable")[: self.keep]]
            yield left[order]
            rest = np.ones(len(left), dtype=bool)
            rest[order] = False
            left, own = left[rest], own[rest]
        order = left[np.argsort(-own, kind="stable")]
        for k in range(0, len(order), self.keep):
            yield order[k : k + self.keep]


def pack(sizes: list[int], capacity: int, index: Index) -> list[list[tuple[int, int, int]]]:
    """Containers of (document, part, tokens); part 0 is a whole text, parts of a split one count from 1."""
    containers, items = [], []  # items: (tokens, document, part)
    for d, n in enumerate(sizes):
        if n > capacity:
            full, rest = divmod(n, capacity)
            containers += [[(d, k + 1, capacity)] for k in range(full)]
            if rest:
                items.append((rest, d, full + 1))
        elif n:
            items.append((n, d, 0))
    items.sort()
    order = items[:]  # unused items by size
    at = {d: (n, d, part) for n, d, part in items}  # one item of each document is open

    free = np.zeros(index.n, dtype=bool)
    free[list(at)] = True

    def take(item):
        del order[bisect_left(order, item)]
        del at[item[1]]
        free[item[1]] = False

    while order:
        seed = order[-1]
        take(seed)
        room, held = capacity - seed[0], [(seed[1], seed[2], seed[0])]
        if order and room >= order[0][0]:
            # Down the ranking of the unused, `keep` at a time, of these the larger ones first: a small gap takes few documents.
            for near in index.neighbours(seed[1], free):
                if not order or room < order[0][0]:
                    break
                for item in sorted((at[d] for d in near.tolist()), reverse=True):
                    if item[0] <= room:
                        take(item)
                        held.append((item[1], item[2], item[0]))
                        room -= item[0]
            while order and order[0][0] <= room:
                item = order[bisect_right(order, (room, math.inf, 0)) - 1]
                take(item)
                held.append((item[1], item[2], item[0]))
                room -= item[0]
        containers.append(held)
    return containers


PACKED = "window_id long, container_id long, position int, doc_id long, part int, tokens long"


def pack_documents(docs: DataFrame, windows: DataFrame, shard_rows: int = 2000, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row per placed text or part of one: window, container, position in it, doc_id, part (0: whole) and tokens.

    Null and empty texts have no tokens and take no place. A doc_id delivered twice is packed once. Windows without a positive
    capacity are left out; repeated windows count once. Equal sizes go by doc_id. Other columns are ignored. Either table may
    be empty.
    """
    capacities = sorted({(r["window_id"], r["capacity"]) for r in windows.select(F.col("window_id").cast("long").alias("window_id"), F.col("capacity_tokens").cast("long").alias("capacity")).where("window_id is not null and capacity_tokens > 0").distinct().limit(MOST_WINDOWS + 1).collect()})
    if len(capacities) > MOST_WINDOWS:
        raise ValueError(f"more than {MOST_WINDOWS} windows: pack them in several calls")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null and text <> ''")
    # Ids alone are shuffled to find the repeated ones; texts only where there are any.
    again = cut(rows.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if again.limit(1).count():
        rows = rows.join(again, "doc_id", "left_anti").unionByName(rows.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    shards = max(1, math.ceil(rows.count() / shard_rows))
    spread = rows.repartitionByRange(shards, "lang", "source", "doc_id").drop("lang", "source")

    def run(frames):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        enc = encoder(tokenizer)
        ids, tokens = [], []
        for pdf in frames:
            for d, text in zip(pdf["doc_id"].tolist(), pdf["text"]):
                ids.append(d)
                tokens.append(np.asarray(enc.encode_ordinary(text), dtype=np.int32))
        order = sorted(range(len(ids)), key=ids.__getitem__)
        ids, tokens = [ids[k] for k in order], [tokens[k] for k in order]
        index = Index(tokens)
        sizes = [len(t) for t in tokens]
        for window, capacity in capacities:
            got = [(window, (shard << 32) + c, p, ids[d], part, n) for c, held in enumerate(pack(sizes, capacity, index)) for p, (d, part, n) in enumerate(held)]
            yield pd.DataFrame(got, columns=["window_id", "container_id", "position", "doc_id", "part", "tokens"])

    return spread.mapInPandas(run, PACKED)


def fill(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """Containers, documents, tokens and the share of used space of each window."""
    sizes = windows.select(F.col("window_id").cast("long").alias("window_id"), F.col("capacity_tokens").cast("long").alias("capacity_tokens")).dropDuplicates(["window_id"])
    packed = pack_documents(docs, windows).groupBy("window_id", "container_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("parts"))
    return packed.groupBy("window_id").agg(F.count("*").alias("containers"), F.sum("parts").alias("parts"), F.sum("tokens").alias("tokens")).join(sizes, "window_id").withColumn("used_share", F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")))
