"""Retrieval over batches of queries: vector top-k, keyword scores, rank fusion, reranking, diversity and budgets.

hits: one row per (qid, id) with a `score`; the order within a query is by score, then id. Queries come in batches, so every
stage is one relational step for all of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V

#: Queries of one scan of the vectors, and scores that a task holds at once (8 bytes each, some copies).
QUERIES_IN_BLOCK = 4096
SCORES_IN_TASK = 2_000_000


def ranked(hits: DataFrame, k: int | None = None, by: str = "score", name: str = "rank") -> DataFrame:
    """Hits with their rank within the query, the k best if k is given. Catalyst limits the groups before the shuffle."""
    order = Window.partitionBy("qid").orderBy(F.desc(by), "id")
    out = hits.withColumn(name, F.row_number().over(order))
    return out if k is None else out.where(F.col(name) <= max(0, k))


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", threshold: float | None = None, decimals: int = 6, dimensions: int | None = None) -> DataFrame:
    """(qid, id, score, rank): the k best vectors of each query, scored exactly.

    vectors: id, v and, for tenant isolation, scope; queries: qid, q and scope. Queries are taken in blocks of
    QUERIES_IN_BLOCK, one scan of the vectors for each; each task scores its vectors against a block by one matrix product and
    passes on its k best per query, ties decided by id, so what is shuffled grows with queries x tasks, not with pairs. Scores are
    rounded before ranking. dimensions: a query of another length is an error; a vector of another length than the query, null
    vectors and null ids are left out. Large collections go through `bucket_topk` or an index of the caller's.
    """
    if metric not in V.METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    scoped = "scope" in vectors.columns and "scope" in queries.columns
    kinds = (vectors.schema["id"].dataType.simpleString(), queries.schema["qid"].dataType.simpleString())
    rows = vectors.where("id is not null and v is not null").select("id", F.col("v").cast("array<double>").alias("v"), *([F.col("scope").cast("string").alias("scope")] if scoped else []))
    q = F.col("q").cast("array<double>")
    if dimensions is not None:
        q = F.when(F.size(q) == dimensions, q).otherwise(F.raise_error(F.lit(f"queries must have {dimensions} dimensions")).cast("array<double>"))
    asked = queries.where("qid is not null and q is not null").select("qid", q.alias("q"), *([F.col("scope").cast("string").alias("scope")] if scoped else [])).dropDuplicates(["qid"])
    # Each block is read by itself, so a block of queries is what the driver holds; one pass tells how many there are.
    total = asked.count()
    blocks = max(1, -(-total // QUERIES_IN_BLOCK))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)))
    out = None
    for block in range(blocks):
        table = (asked.where(F.col("block") == block) if blocks > 1 else asked).drop("block").toArrow()
        found = rows.mapInArrow(_scorer(rows.sparkSession.sparkContext.broadcast(table), k, metric, threshold, decimals, scoped), f"qid {kinds[1]}, id {kinds[0]}, score double")
        out = found if out is None else out.unionByName(found)
    return ranked(out.dropDuplicates(["qid", "id"]), k)


def _scorer(held, k: int, metric: str, threshold: float | None, decimals: int, scoped: bool):
    def run(batches):
        table = held.value
        queries = table["q"].to_pylist()
        scopes = np.array(table["scope"].to_pylist(), dtype=object) if scoped else None
        lengths_ = np.array([len(q) for q in queries], dtype=np.int64)
        # Queries by length: their places, matrix and norms, made once.
        by_length = {}
        for n in set(lengths_.tolist()) - {0}:
            at = np.flatnonzero(lengths_ == n)
            Q = np.array([queries[i] for i in at])
            by_length[n] = (at, Q, np.sqrt((Q * Q).sum(1)))
        qids = table["qid"].combine_chunks() if len(table) else table["qid"]
        for batch in batches:
            lengths = np.asarray(batch.column("v").value_lengths())
            for n, (places, Q, q_norms) in by_length.items():
                at = np.flatnonzero(lengths == n)
                step = max(64, SCORES_IN_TASK // len(Q))
                for lo in range(0, len(at), step):
                    part = batch.take(pa.array(at[lo : lo + step]))
                    X = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
                    S = _scores(Q, q_norms, X, metric)
                    np.round(S, decimals, out=S)
                    S[np.isnan(S)] = -np.inf
                    if scoped:
                        own = np.array(part.column("scope").to_pylist(), dtype=object)
                        S[scopes[places][:, None] != own[None, :]] = -np.inf
                    if threshold is not None:
                        S[S < threshold] = -np.inf
                    qi, vi = _best(S, part.column("id"), k)
                    yield pa.RecordBatch.from_arrays([qids.take(pa.array(places[qi])), part.column("id").take(pa.array(vi)), pa.array(S[qi, vi])], ["qid", "id", "score"])

    return run


def _scores(Q: np.ndarray, q_norms: np.ndarray, X: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l2":
        # Differences, not the expanded square: that loses digits where vectors are close. One dimension after the other keeps it to the size of the result.
        total = np.zeros((len(Q), len(X)))
        for j in range(Q.shape[1]):
            apart = Q[:, j, None] - X[None, :, j]
            apart *= apart
            total += apart
        return 1 / (1 + np.sqrt(total, out=total))
    S = Q @ X.T
    if metric == "cosine":
        norms = q_norms[:, None] * np.sqrt((X * X).sum(1))[None, :]
        S = np.divide(S, norms, out=np.zeros_like(S), where=norms > 0)
    return S


def _best(S: np.ndarray, ids, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k best scores of each row; of equal ones those with the least ids."""
    if k <= 0 or not S.size:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    # Columns in the order of ids: the first of equal scores is the least id.
    order = np.asarray(pa.compute.sort_indices(ids)).astype(np.int64)
    T_ = S[:, order]
    if T_.shape[1] > k:
        floor = -np.partition(-T_, k - 1, axis=1)[:, k - 1 : k]
        above, level = T_ > floor, T_ == floor
        room = k - above.sum(1, keepdims=True)
        keep = above | level & (np.cumsum(level, axis=1) <= room)
    else:
        keep = np.ones(T_.shape, dtype=bool)
    qi, vi = np.nonzero(keep & (T_ > -np.inf))
    return qi, order[vi]


def keyword_scores(candidates: DataFrame, queries: DataFrame, k: int | None = None, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(qid, id, score, rank) by BM25 over each query's own candidates: counts and mean length come from the pool alone.

    candidates: qid, id, content; queries: qid, text. Hits without a term of the query are left out.
    """
    docs = candidates.select("qid", "id", T.terms(F.coalesce("content", F.lit(""))).alias("terms"))
    pool = docs.groupBy("qid").agg(F.count("*").alias("n"), F.avg(F.size("terms")).alias("mean_length"))
    asked = queries.select("qid", F.explode(F.array_distinct(T.terms(F.coalesce("text", F.lit(""))))).alias("term"))
    seen = docs.select("qid", "id", F.size("terms").alias("length"), F.explode("terms").alias("term")).join(asked, ["qid", "term"], "left_semi")
    tf = seen.groupBy("qid", "id", "length", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("qid", "term").agg(F.count("*").alias("df"))
    weighed = tf.join(df, ["qid", "term"]).join(pool, "qid")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean_length")))
    return ranked(weighed.groupBy("qid", "id").agg(F.round(F.sum(part), 6).alias("score")).where("score > 0"), k)


def corpus_keyword_topk(docs: DataFrame, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """BM25 of all documents for all queries by an inverted index: postings meet query terms in a join on the term."""
    split = docs.select("id", T.terms(F.coalesce("content", F.lit(""))).alias("terms"))
    total = split.agg(F.count("*").alias("n"), F.avg(F.size("terms")).alias("mean_length"))  # one row
    asked = queries.select("qid", F.explode(F.array_distinct(T.terms(F.coalesce("text", F.lit(""))))).alias("term"))
    tf = split.select("id", F.size("terms").alias("length"), F.explode("terms").alias("term")).join(asked.select("term").distinct(), "term", "left_semi").groupBy("id", "length", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean_length")))
    weights = tf.join(df, "term").crossJoin(F.broadcast(total)).select("id", "term", part.alias("w"))
    return ranked(weights.join(asked, "term").groupBy("qid", "id").agg(F.round(F.sum("w"), 6).alias("score")), k)


def fuse(rankings: list[DataFrame], k: int | None = None, constant: int = 60) -> DataFrame:
    """(qid, id, score, rank) by reciprocal ranks: the sum of 1 / (constant + rank) over the rankings that hold the hit."""
    rows = None
    for r in rankings:
        one = r.select("qid", "id", (1 / (F.lit(float(constant)) + F.col("rank"))).alias("part"))
        rows = one if rows is None else rows.unionByName(one)
    return ranked(rows.groupBy("qid", "id").agg(F.round(F.sum("part"), 9).alias("score")), k)


def fetch_size(top_k: int, fetch: int | None = None, widen: bool = False) -> int:
    """How many candidates to fetch: the caller's wish, four times top_k before a stage that reorders, else top_k."""
    return max(fetch, top_k) if fetch is not None else top_k * 4 if widen else top_k


def rerank_overlap(hits: DataFrame, queries: DataFrame, k: int | None = None) -> DataFrame:
    """Hits rescored by the share of the query's distinct terms that the content holds."""
    asked = queries.select("qid", F.array_distinct(T.terms(F.coalesce("text", F.lit("")))).alias("asked"))
    got = F.size(F.array_intersect("asked", F.array_distinct(T.terms(F.coalesce("content", F.lit(""))))))
    share = F.when(F.size("asked") > 0, got / F.size("asked")).otherwise(F.lit(0.0))
    return ranked(hits.drop("score", "rank").join(asked, "qid").withColumn("score", F.round(share, 6)).drop("asked"), k)


def threshold(hits: DataFrame, least: float) -> DataFrame:
    return hits.where(F.col("score") >= least)


def without_repeats(hits: DataFrame) -> DataFrame:
    """The first hit of each content within a query; blank contents are never taken for the same."""
    blank = T.trimmed(F.coalesce("content", F.lit(""))) == ""
    first = Window.partitionBy("qid", F.when(blank, F.concat(F.lit("id:"), F.col("id").cast("string"))).otherwise(T.text_hash(T.trimmed(F.col("content"))))).orderBy("rank", "id")
    return hits.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")


def within_budget(hits: DataFrame, budget: int, tokens: Column | None = None) -> DataFrame:
    """Hits in order while their tokens fit the budget; the first is always kept, the first that doesn't fit ends the list."""
    counted = hits.withColumn("tokens", T.token_count(F.coalesce("content", F.lit(""))) if tokens is None else tokens)
    upto = Window.partitionBy("qid").orderBy("rank", "id").rowsBetween(Window.unboundedPreceding, 0)
    return counted.withColumn("spent", F.sum("tokens").over(upto)).withColumn("_nth", F.row_number().over(Window.partitionBy("qid").orderBy("rank", "id"))).where((F.col("spent") <= budget) | (F.col("_nth") == 1)).drop("_nth")


def with_parents(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with `parent_content`, looked up in the same tenant; a miss leaves the hit as it is."""
    parents = chunks.select(F.col("id").alias("parent_id"), F.col("tenant_id").alias("parent_tenant"), F.col("content").alias("parent_content"))
    return hits.join(parents, (F.col("parent_chunk_id") == F.col("parent_id")) & (F.col("tenant_id") == F.col("parent_tenant")), "left").drop("parent_id", "parent_tenant")


def hit_text() -> Column:
    return F.when(F.coalesce("parent_content", F.lit("")) != "", F.col("parent_content")).otherwise(F.col("content"))


def diverse(hits: DataFrame, queries: DataFrame, k: int, balance: float = 0.5) -> DataFrame:
    """Greedy maximal marginal relevance: balance x similarity to the query - (1 - balance) x similarity to what is chosen.

    hits: qid, id, v, rank; queries: qid, q. Similarity to the chosen counts from 0 up; the earlier hit wins ties; hits without
    a vector are left out, unless none has one: then the first k stay. One group is a query's candidate pool.
    """
    share = min(1.0, max(0.0, balance))
    kind = hits.schema["id"].dataType.simpleString()
    both = hits.select("qid", "id", "rank", F.col("v").cast("array<double>").alias("v")).join(queries.select("qid", F.col("q").cast("array<double>").alias("q")), "qid")

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank", "id"], kind="stable")
        with_v = pdf[[v is not None and len(v) > 0 for v in pdf["v"]]]
        if with_v.empty:
            chosen = pdf.head(k)
            return pd.DataFrame({"qid": chosen["qid"], "id": chosen["id"], "rank": range(1, len(chosen) + 1)})
        unit = lambda M: M / np.where((n := np.linalg.norm(M, axis=-1, keepdims=True)) > 0, n, 1)
        X, q = unit(np.stack(with_v["v"].tolist())), unit(np.asarray(with_v["q"].iloc[0], dtype=float))
        near, worst, taken = X @ q, np.zeros(len(X)), []
        free = np.ones(len(X), dtype=bool)
        while len(taken) < min(k, len(X)):
            gain = np.where(free, np.round(share * near - (1 - share) * worst, 9), -np.inf)
            at = int(gain.argmax())
            taken.append(at)
            free[at] = False
            worst = np.maximum(worst, X @ X[at])
        chosen = with_v.iloc[taken]
        return pd.DataFrame({"qid": chosen["qid"], "id": chosen["id"], "rank": range(1, len(chosen) + 1)})

    return both.groupBy("qid").applyInPandas(pick, f"qid {hits.schema['qid'].dataType.simpleString()}, id {kind}, rank int")


def contexts(hits: DataFrame, budget: int | None = None, template: str = "Context:\n{context}\n\nQuestion: {question}") -> DataFrame:
    """(qid, context, prompt, citations): numbered blocks of each query's hits within the budget, in one prompt."""
    shown = hits.withColumn("shown", hit_text() if "parent_content" in hits.columns else F.col("content"))
    if budget is not None:
        shown = within_budget(shown.withColumn("content", F.col("shown")), budget)
    order = Window.partitionBy("qid").orderBy("rank", "id")
    numbered = shown.withColumn("n", F.row_number().over(order)).select("qid", "question", "n", "id", F.concat(F.lit("["), F.col("n"), F.lit("] "), F.col("shown")).alias("block"))
    out = numbered.groupBy("qid", "question").agg(F.sort_array(F.collect_list(F.struct("n", "block", "id"))).alias("blocks"))  # a query's few hits
    text = F.array_join(F.transform("blocks", lambda x: x["block"]), "\n\n")
    return out.select("qid", text.alias("context"), T.render(template, text, F.col("question")).alias("prompt"), F.transform("blocks", lambda x: x["id"]).alias("citations"))


def stub_answer(prompt: Column) -> Column:
    """Answer of the offline model."""
    return F.concat(F.lit("ANSWER: "), F.substring(T.trimmed(prompt), 1, 80))


def sign_buckets(vectors: DataFrame, planes: list[list[float]]) -> DataFrame:
    """Vectors with the bucket of a random-hyperplane index; equal buckets are candidates for an exact score."""
    signs = [F.when(V.dot(F.col("v"), F.array(*[F.lit(float(x)) for x in p])) > 0, F.lit(1 << i)).otherwise(F.lit(0)) for i, p in enumerate(planes)]
    return vectors.withColumn("bucket", sum(signs[1:], signs[0]))


def bucket_topk(vectors: DataFrame, queries: DataFrame, k: int, planes: list[list[float]], probes: int = 1, metric: str = "cosine", decimals: int = 6) -> DataFrame:
    """(qid, id, score, rank) among the vectors whose bucket differs from the query's in at most `probes` signs, scored exactly.

    The index of large collections: queries are copied to the buckets they probe and meet the vectors there in a join on the
    bucket, so the collection is neither scanned per block of queries nor sent out. What lies in other buckets is not found:
    more planes make buckets smaller, more probes find more.
    """
    from itertools import combinations

    near = [sum(1 << b for b in chosen) for r in range(probes + 1) for chosen in combinations(range(len(planes)), r)]
    rows = sign_buckets(vectors.where("id is not null and v is not null").select("id", "v"), planes)
    asked = sign_buckets(queries.where("qid is not null and q is not null").dropDuplicates(["qid"]).select("qid", F.col("q").alias("v")), planes)
    probed = asked.select("qid", F.col("v").alias("q"), F.explode(F.array(*[F.col("bucket").bitwiseXOR(F.lit(m)) for m in near])).alias("bucket"))
    scored = probed.join(rows, "bucket").where(F.size("q") == F.size("v")).select("qid", "id", F.round(V.score(metric, F.col("q"), F.col("v")), decimals).alias("score"))
    return ranked(scored, k)


def scored_by_place(hits: DataFrame, results: DataFrame) -> DataFrame:
    """Hits with the scores of a service that names them by their place: results (qid, index from 0, score); unknown places are skipped."""
    order = Window.partitionBy("qid").orderBy("rank", "id")
    placed = hits.withColumn("index", (F.row_number().over(order) - 1).cast("int"))
    return placed.drop("score", "rank").join(results.select("qid", F.col("index").cast("int").alias("index"), "score"), ["qid", "index"]).drop("index")
