"""The read path as one plan: candidates, fusion, rerank, threshold, repeats, diversity or limit, parents, budget."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import filters as FL
from ..functions import remote
from ..functions import text as T
from ..functions import vectors as V
from ..functions.registry import Registry
from ..operators import embedding as EM
from ..operators import search as S

#: A reranker is None (the overlap of terms, a plan without Python) or a function (query, texts, k) -> (place, score) pairs.
RERANKERS = Registry("reranker", overlap=lambda: None)
#: Language models: objects with `generate` and `stream`.
MODELS = Registry("model", stub=remote.StubModel, null=remote.Model)
#: Wordings: functions query -> list of texts, the query itself first.
WORDINGS = Registry("wording", none=lambda: lambda query: [query])


@dataclass(frozen=True)
class Request:
    """What a search asks for. Defaults: ten hits, namespace `documents`, balance 0.5, repeats removed."""

    top_k: int = 10
    namespace: str = "documents"
    tenant: str | None = None
    metric: str = "cosine"
    filters: dict = field(default_factory=dict)
    threshold: float | None = None
    hybrid: bool = False
    rerank: bool = False
    mmr: float | None = None
    dedup: bool = True
    expand_parents: bool = False
    budget: int | None = None
    fetch: int | None = None
    dimensions: int = 8
    embedder: str | None = None
    reranker: str = "overlap"
    wording: str = "none"
    wordings: int = 0

    @property
    def fetch_k(self) -> int:
        return S.fetch_size(self.top_k, self.fetch, self.hybrid or self.rerank or self.mmr is not None)


class Search:
    """Fluent builder; every call gives a new search, `hits` the lazy DataFrame.

    chunks: id, v, content, metadata and, where used, namespace, tenant_id, parent_chunk_id. queries: qid, text and,
    optionally, variant (further wordings of a query, whose rankings are fused). Questions are embedded by a plan of built-in
    functions or, after `using`, by a registered embedder, once for each distinct text.
    """

    def __init__(self, chunks: DataFrame, queries: DataFrame, request: Request | None = None):
        self.chunks, self.queries, self.request = chunks, queries, request or Request()

    def _with(self, **changes) -> Search:
        return Search(self.chunks, self.queries, replace(self.request, **changes))

    def top_k(self, k: int) -> Search:
        return self._with(top_k=k)

    def threshold(self, least: float) -> Search:
        return self._with(threshold=least)

    def filter(self, conditions: dict) -> Search:
        return self._with(filters={**self.request.filters, **conditions})

    def where(self, key: str, value) -> Search:
        return self.filter({key: value})

    def namespace(self, name: str) -> Search:
        return self._with(namespace=name)

    def tenant(self, name: str) -> Search:
        return self._with(tenant=name)

    def hybrid(self, on: bool = True) -> Search:
        return self._with(hybrid=on)

    def rerank(self, on: bool = True, by: str = "overlap") -> Search:
        return self._with(rerank=on, reranker=by)

    def using(self, embedder: str, dimensions: int | None = None) -> Search:
        """The registered embedder of the questions: the one that made the vectors."""
        return self._with(embedder=embedder, dimensions=dimensions or self.request.dimensions)

    def store(self, chunks: DataFrame) -> Search:
        """The same search over other chunks."""
        return Search(chunks, self.queries, self.request)

    def expand_queries(self, by: str, n: int = 3) -> Search:
        """Up to n (at least one) further wordings of each query by a registered function, whose rankings are fused."""
        return self._with(wording=by, wordings=max(1, n))

    def mmr(self, balance: float = 0.5) -> Search:
        return self._with(mmr=balance)

    def dedup(self, on: bool = True) -> Search:
        return self._with(dedup=on)

    def expand_parents(self, on: bool = True) -> Search:
        return self._with(expand_parents=on)

    def context_budget(self, tokens: int) -> Search:
        return self._with(budget=tokens)

    def fetch(self, k: int) -> Search:
        return self._with(fetch=k)

    def _embedded(self, texts: DataFrame) -> DataFrame:
        r = self.request
        if r.embedder is None:
            return texts.withColumn("q", V.embed(F.col("text"), r.dimensions))
        keyed = texts.withColumn("_key", T.text_hash(F.col("text")))
        known = EM.embed_texts(keyed.select(F.col("_key").alias("key"), "text").dropDuplicates(["key"]), EM.EMBEDDERS.get(r.embedder), r.dimensions)
        return keyed.join(known.select(F.col("key").alias("_key"), F.col("v").alias("q")), "_key").drop("_key")

    def _variants(self) -> DataFrame:
        r = self.request
        if "variant" in self.queries.columns:
            return self.queries
        if not r.wordings:
            return self.queries.withColumn("variant", F.lit(0))
        make, n = WORDINGS.get(r.wording), r.wordings

        @F.pandas_udf("array<string>")
        def worded(s: pd.Series) -> pd.Series:
            return s.map(lambda q: list(dict.fromkeys([q, *make(q)]))[: n + 1] if isinstance(q, str) else [])

        return self.queries.select("qid", F.posexplode(worded(F.col("text"))).alias("variant", "text"))

    def hits(self) -> DataFrame:
        r = self.request
        chunks = self.chunks
        if "namespace" in chunks.columns:
            chunks = chunks.where(F.col("namespace") == r.namespace)
        if r.tenant is not None:
            chunks = chunks.where(F.col("tenant_id") == r.tenant)
        if r.filters:
            chunks = chunks.where(FL.matches(F.col("metadata"), r.filters))
        variants = self._variants()
        # One search for all wordings: a wording is a query of its own until its ranking is fused.
        keyed = variants.select(F.struct("qid", "variant").alias("k"), "qid", "variant", "text")
        keyed = self._embedded(keyed)
        asked = keyed.select(F.to_json("k").alias("qid"), "q", "text", F.col("qid").alias("query"))
        near = S.exact_topk(chunks.select("id", "v"), asked.select("qid", "q"), r.fetch_k, r.metric, dimensions=r.dimensions)
        if r.hybrid:
            pool = near.select("qid", "id").join(chunks.select("id", "content"), "id")
            near = S.fuse([near, S.keyword_scores(pool, asked.select("qid", "text"), r.fetch_k)], r.fetch_k)
        back = asked.select("qid", "query")
        if "variant" in self.queries.columns or r.wordings:
            hits = S.fuse([near.join(back, "qid").select(F.col("query").alias("qid"), "id", "rank")], r.fetch_k)
        else:
            hits = near.join(back, "qid").select(F.col("query").alias("qid"), "id", "score", "rank")
        carried = [c for c in ("content", "v", "tenant_id", "parent_chunk_id", "document_id") if c in chunks.columns]
        hits = hits.join(chunks.select("id", *carried), "id")
        first = variants.where("variant = 0").select("qid", "text").dropDuplicates(["qid"])
        if r.rerank:
            hits = reranked(hits, first, r.fetch_k, r.reranker)
        if r.threshold is not None:
            hits = S.threshold(hits, r.threshold)
        if r.dedup:
            hits = S.without_repeats(hits)
        if r.mmr is not None:
            chosen = S.diverse(hits, self._embedded(first).select("qid", "q"), r.top_k, r.mmr)
            hits = hits.drop("rank").join(chosen, ["qid", "id"])
        else:
            hits = S.ranked(hits.withColumn("_place", -F.col("rank")).drop("rank"), r.top_k, "_place").drop("_place")
        if r.expand_parents:
            hits = S.with_parents(hits, self.chunks)
        if r.budget is not None:
            text = S.hit_text() if "parent_content" in hits.columns else F.col("content")
            hits = S.within_budget(hits, r.budget, T.token_count(F.coalesce(text, F.lit(""))))
        return hits

    get = hits

    def first(self) -> DataFrame:
        return self.top_k(1).hits()

    def count(self) -> int:
        return self.hits().count()


def reranked(hits: DataFrame, queries: DataFrame, k: int, by: str = "overlap") -> DataFrame:
    """Hits rescored by a registered reranker, the k best of each query. A service gets each query with its own hits at once."""
    call = RERANKERS.get(by)
    if call is None:
        return S.rerank_overlap(hits, queries, k)
    pool = hits.select("qid", "id", "rank", "content").join(queries.select("qid", "text"), "qid")
    out = f"qid {hits.schema['qid'].dataType.simpleString()}, index int, score double"

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank", "id"], kind="stable")
        found = call(pdf["text"].iloc[0] or "", [x or "" for x in pdf["content"]], k)
        return pd.DataFrame([(pdf["qid"].iloc[0], place, value) for place, value in found], columns=["qid", "index", "score"])

    # One group is the candidate pool of a query.
    return S.ranked(S.scored_by_place(hits, pool.groupBy("qid").applyInPandas(score, out)), k)


def ask(search: Search, budget: int = 2000, template: str = "Context:\n{context}\n\nQuestion: {question}") -> DataFrame:
    """(qid, answer, citations) by the offline model over each query's context, as a plan without Python."""
    hits = search.hits().join(search.queries.select("qid", F.col("text").alias("question")).dropDuplicates(["qid"]), "qid")
    return S.contexts(hits, budget, template).select("qid", "prompt", S.stub_answer(F.col("prompt")).alias("answer"), "citations")


@dataclass(frozen=True)
class Ask:
    """Questions with cited context for a registered model; every call gives a new one. The search runs once."""

    search: Search
    model: str = "stub"
    template: str = "Context:\n{context}\n\nQuestion: {question}"
    budget: int = 2000

    def using(self, model: str) -> Ask:
        return replace(self, model=model)

    def prompt(self, template: str) -> Ask:
        return replace(self, template=template)

    def context_budget(self, tokens: int) -> Ask:
        return replace(self, budget=tokens)

    def with_search(self, change: Callable[[Search], Search]) -> Ask:
        return replace(self, search=change(self.search))

    def prompts(self) -> DataFrame:
        """(qid, context, prompt, citations)"""
        hits = self.search.hits().join(self.search.queries.select("qid", F.col("text").alias("question")).dropDuplicates(["qid"]), "qid")
        return S.contexts(hits, self.budget, self.template)

    def generate(self) -> DataFrame:
        """(qid, prompt, answer, model, citations)"""
        model = MODELS.get(self.model)

        @F.pandas_udf("string")
        def answer(s: pd.Series) -> pd.Series:
            return s.map(lambda p: model.generate(p) if isinstance(p, str) else None)

        return self.prompts().select("qid", "prompt", answer(F.col("prompt")).alias("answer"), F.lit(model.name).alias("model"), "citations")

    def stream(self) -> DataFrame:
        """(qid, n, piece): the pieces of each answer in order, passed on while they come."""
        model, prompts = MODELS.get(self.model), self.prompts().select("qid", "prompt")
        kind = prompts.schema["qid"].dataType.simpleString()

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                for qid, prompt in zip(pdf["qid"], pdf["prompt"]):
                    for n, piece in enumerate(model.stream(prompt)):
                        yield pd.DataFrame({"qid": [qid], "n": [n], "piece": [piece]})

        return prompts.mapInPandas(run, f"qid {kind}, n int, piece string")
