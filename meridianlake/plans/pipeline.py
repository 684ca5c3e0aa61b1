"""The write path as one plan: parse, clean, redact, chunk, embed; then the rows that replace those of the changed documents."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as C
from ..operators import embedding as EM
from ..operators import store as ST
from ..sources import parsers as P
from ..sources.sinks import settled

# Keys of a document's metadata that its chunks don't inherit.
NOT_INHERITED = ("pii_tokens", "pii_redactions", "json", "rows", "provenance")
#: States of a document on its way, in order.
STATES = ("pending", "parsing", "chunking", "embedding", "indexed", "failed")


class Stages:
    """A chain of named steps over documents with `text`, `sections`, `metadata` and `language`."""

    def __init__(self, *steps: tuple[str, Callable[[DataFrame], DataFrame]]):
        self.steps = steps

    def pipe(self, name: str, step: Callable[[DataFrame], DataFrame]) -> Stages:
        return Stages(*self.steps, (name, step))

    def names(self) -> list[str]:
        return [name for name, _ in self.steps]

    def process(self, documents: DataFrame) -> DataFrame:
        for _, step in self.steps:
            documents = documents.transform(step)
        return documents


def cleaned(documents: DataFrame) -> DataFrame:
    return documents.withColumn("text", T.clean(F.col("text")))


def with_language(documents: DataFrame) -> DataFrame:
    """A language that is known already stays."""
    known = F.col("language") if "language" in documents.columns else F.lit(None).cast("string")
    return documents.withColumn("language", F.coalesce(known, T.language_vote(F.col("text"))))


def redacted(documents: DataFrame, tokens: bool = False) -> DataFrame:
    """Personal items masked in the text, in all sections and in every value of the metadata; `pii_redactions` counts them."""
    flat = F.array(F.col("text"))
    whole = documents.withColumn("_all", F.concat(flat, F.coalesce(F.transform("sections", lambda s: s["content"]), F.array().cast("array<string>")), F.coalesce(F.map_values("metadata"), F.array().cast("array<string>"))))
    done = whole.withColumn("_done", T.redacted_all(F.col("_all"), tokens))
    n = F.coalesce(F.size("sections"), F.lit(0))
    texts = F.col("_done.texts")
    sections = F.when(F.col("sections").isNull(), F.col("sections")).otherwise(F.transform("sections", lambda s, i: s.withField("content", F.get(texts, i + 1))))
    values = F.map_from_arrays(F.map_keys("metadata"), F.slice(texts, n + 2, F.size(F.map_keys("metadata"))))
    metadata = F.when(F.col("metadata").isNull() | (F.size("metadata") == 0), F.col("metadata")).otherwise(values)
    out = done.withColumn("text", F.get(texts, F.lit(0))).withColumn("_sections", sections).withColumn("_metadata", metadata).withColumn("pii_redactions", F.col("_done.counts"))
    return out.drop("_all", "_done", "sections", "metadata").withColumnsRenamed({"_sections": "sections", "_metadata": "metadata"})


def default_stages(redact: bool = True) -> Stages:
    return Stages(("clean", cleaned), ("language", with_language), *([("redact", redacted)] if redact else []))


def inherited(metadata: Column) -> Column:
    return F.map_filter(F.coalesce(metadata, F.create_map().cast("map<string, string>")), lambda k, v: ~k.isin(*NOT_INHERITED))


def chunk_documents(documents: DataFrame, strategy: str = "recursive", size: int = 1000, overlap: int = 200) -> DataFrame:
    """Chunks with an id, their token count and metadata: the document's that are inherited, with index and offset over them."""
    made = C.chunks(documents, "text", strategy, size, overlap)
    own = F.create_map(F.lit("chunk_index"), F.col("idx").cast("string"), F.lit("offset"), F.col("start").cast("string"))
    kept = F.map_filter(inherited(F.col("metadata")), lambda k, v: ~k.isin("chunk_index", "offset"))
    return made.select(
        F.sha2(F.concat_ws(":", "document_id", "content_hash", F.col("idx").cast("string")), 256).alias("id"), "document_id", "tenant_id", "idx", "start", "content", "heading", "is_parent",
        F.when(F.col("parent_idx").isNotNull(), F.sha2(F.concat_ws(":", "document_id", "content_hash", F.col("parent_idx").cast("string")), 256)).alias("parent_chunk_id"),
        T.token_count(F.col("content")).alias("token_count"), F.map_concat(kept, own).alias("metadata"),
    )


@dataclass
class Indexed:
    """Rows of one run: documents with their new state, chunks with vectors, usage, and what the embedding cache learned."""

    documents: DataFrame
    chunks: DataFrame
    usage: DataFrame
    cache: DataFrame


def index_documents(sources: DataFrame, stages: Stages | None = None, strategy: str = "recursive", size: int = 1000, overlap: int = 200, embedder: str = "deterministic", dimensions: int = 8, namespace: str = "documents", cache: DataFrame | None = None, shredded: DataFrame | None = None, cost_per_1000: float = 0.0) -> Indexed:
    """Documents (document_id, tenant_id, content, mime, metadata map, at) into chunks with vectors.

    A document that can't be parsed becomes `failed` with its error and has no chunks; others become `indexed`. Parent chunks
    have no vector. Texts that the cache knows cost nothing. What comes out is meant to replace the rows of the same documents
    in the next generation of each table (see sinks.replace_documents), so readers see all of a document or nothing.
    """
    rows = sources if shredded is None else ST.not_shredded(sources, shredded)
    parsed = rows.withColumn("parsed", P.parsed(F.col("content"), F.col("mime")))
    merged = F.map_concat(F.map_filter(F.coalesce("parsed.metadata", F.create_map().cast("map<string, string>")), lambda k, v: ~F.map_contains_key(F.coalesce("metadata", F.create_map().cast("map<string, string>")), k)), F.coalesce("metadata", F.create_map().cast("map<string, string>")))
    read = parsed.select("document_id", "tenant_id", "at", F.sha2(F.col("content"), 256).alias("content_hash"), F.col("parsed.text").alias("text"), F.col("parsed.sections").alias("sections"), merged.alias("metadata"), F.col("parsed.error").alias("error"))
    # Both are used several times: texts are parsed, cleaned and cut once.
    ready = settled((stages or default_stages()).process(read))
    made = settled(chunk_documents(ready.where("error is null and text is not null"), strategy, size, overlap))
    children = made.where(~F.coalesce("is_parent", F.lit(False)))
    embedded, fresh = EM.with_cache(children.withColumn("text", F.col("content")), cache, EM.EMBEDDERS.get(embedder), dimensions, identity=embedder)
    vectors = embedded.drop("text", "key", "tokens")
    parents = made.where(F.coalesce("is_parent", F.lit(False))).withColumn("v", F.lit(None).cast("array<double>"))
    chunks = vectors.unionByName(parents).withColumn("namespace", F.lit(namespace))
    # A text that several tenants share is embedded once for each: its key holds the tenant.
    owners = embedded.select("key", "tenant_id").distinct()
    calls = fresh.join(owners, "key").groupBy("tenant_id").agg(F.sum("tokens").alias("tokens")).withColumn("cost", (F.col("tokens") / 1000 * cost_per_1000).cast("decimal(12,6)")).withColumn("currency", F.lit("USD")).withColumn("at", F.current_timestamp())
    state = ready.select("document_id", "tenant_id", "content_hash", F.when(F.col("error").isNotNull(), "failed").otherwise("indexed").alias("status"), "error", F.when(F.col("error").isNull(), F.lit(namespace)).alias("indexed_namespace"), "at", *[c for c in ("language", "pii_redactions") if c in ready.columns])
    return Indexed(state, chunks, ST.usage_rows(calls, "embedding"), fresh)


def on_batches(write: Callable[[Indexed, int], None], **settings):
    """foreachBatch handler: each batch of documents is indexed and handed to `write` with its number; failed documents are among its rows."""

    def run(batch: DataFrame, number: int) -> None:
        write(index_documents(batch, **settings), number)

    return run
