"""Queries of the write path, drivers, keys, tenants, models and sources, registered in the catalogue with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalogue import _CHUNKS, _DOCUMENTS, _INGEST, _NEAR, _PAIRS, _SNAPSHOT, _SQL, _WORDINGS, _arrivals, _asked, _chunks, _corpus, _docs, _documents, _long_rank, _questions, _vectors, query, table, tenant_snapshot
from .functions import text as T
from .operators import embedding as EM
from .operators import evaluation as E
from .operators import search as S
from .operators import security as SEC
from .operators import store as ST
from .plans import models as M
from .plans import pipeline as PL
from .plans.retrieval import MODELS, RERANKERS, WORDINGS, Ask, Search
from .sources import readers as R

# --- drivers -----------------------------------------------------------------------------------------------------------------


def by_length(query_text: str, texts: list[str], k: int) -> list[tuple[int, float]]:
    """A reranker as a service would be: the shortest texts first, and a place that no text has."""
    found = sorted(((place, 1.0 / (1 + len(t))) for place, t in enumerate(texts)), key=lambda x: -x[1])
    return [*found, (len(texts) + 5, 9.0)]


RERANKERS.extend("shortest", lambda: by_length)
EM.EMBEDDERS.extend("second", lambda: EM.deterministic(8, "fake-embed-v2"))
WORDINGS.extend("lower", lambda: lambda q: [q, q.lower(), q])


@query(_NEAR.format(k=40) + " SELECT qid, id, score, rank FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (SELECT qid, id, 1.0::DOUBLE / (1 + length(content)) AS score FROM near JOIN d USING (id))) WHERE rank <= 10")
def rerank_registered(spark, d):
    return _long_rank(Search(_corpus(spark, d), _questions(spark, d)).top_k(10).rerank(by="shortest").dedup(False).hits())


@query(_NEAR.format(k=10).replace("fake-embed-v1", "fake-embed-v2") + " SELECT qid, id, score, rank FROM near")
def search_registered_embedder(spark, d):
    made = EM.embed_texts(_corpus(spark, d).select(F.col("id").cast("string").alias("key"), F.col("content").alias("text")), EM.EMBEDDERS.get("second"), 8)
    chunks = made.select(F.col("key").cast("long").alias("id"), F.col("text").alias("content"), "v")
    return _long_rank(Search(chunks, _questions(spark, d)).using("second").top_k(10).dedup(False).hits())


@query(_WORDINGS.replace("SELECT item_id, 1, lower(query) FROM eval_items", "SELECT item_id, 1, lower(query) FROM eval_items WHERE lower(query) <> query"))
def expanded_queries(spark, d):
    return _long_rank(Search(_corpus(spark, d), _questions(spark, d)).expand_queries("lower", 1).top_k(10).fetch(20).dedup(False).hits())


def _asking(spark, d):
    return Ask(Search(_corpus(spark, d), _questions(spark, d)).top_k(5).dedup(False)).context_budget(800)


@query(_SQL["ask_answers"].replace("cited FROM p", "cited, 'stub' AS model FROM p"))
def ask_registered_model(spark, d):
    out = _asking(spark, d).using("stub").generate()
    return out.select("qid", T.text_hash(F.col("prompt")).alias("prompt_hash"), "answer", F.array_join(F.transform("citations", lambda x: x.cast("string")), ",").alias("cited"), "model")


@query("SELECT qid, answer, len(string_split(answer, ' '))::BIGINT AS pieces FROM (" + _SQL["ask_answers"] + ")")
def ask_streamed(spark, d):
    pieces = _asking(spark, d).stream().groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("n", "piece"))).alias("p"))  # the words of one answer
    return pieces.select("qid", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("answer"), F.size("p").cast("long").alias("pieces"))


@query("SELECT item_id AS qid, '' AS answer FROM eval_items WHERE false")
def ask_null_model(spark, d):
    """The null model streams nothing."""
    assert MODELS.get("null").generate("x") == ""
    return _asking(spark, d).using("null").stream().select("qid", F.col("piece").alias("answer"))


@query(f"{_PAIRS}, hits AS (SELECT qid, id, label, rank FROM (SELECT qid, id, label, row_number() OVER (PARTITION BY qid ORDER BY round(list_cosine_similarity(q, v), 6) DESC, id) AS rank FROM pairs) WHERE rank <= 10), rel AS (SELECT DISTINCT qid, 'doc-' || qlabel AS id FROM pairs UNION SELECT qid, qid::VARCHAR FROM pairs), named AS (SELECT qid, id::VARCHAR AS id, rank FROM hits UNION ALL SELECT qid, 'doc-' || label, rank FROM hits), met AS (SELECT qid, count(DISTINCT id) AS found, min(rank) AS first FROM named JOIN rel USING (qid, id) GROUP BY qid) SELECT r.qid, coalesce(found, 0)::BIGINT AS found, round(coalesce(1 / first::DOUBLE, 0.0), 6) AS reciprocal_rank FROM (SELECT DISTINCT qid FROM rel) r LEFT JOIN met USING (qid)")
def eval_by_document(spark, d):
    """Labels name chunks or whole documents."""
    asked = _asked(spark, d)
    hits = S.exact_topk(_vectors(spark, d), asked, 10).join(_vectors(spark, d).select("id", F.concat(F.lit("doc-"), "label").alias("document_id")), "id").withColumn("id", F.col("id").cast("string"))
    relevant = asked.select("qid", F.concat(F.lit("doc-"), "label").alias("id")).unionByName(asked.select("qid", F.col("qid").cast("string").alias("id")))
    return E.by_case(hits, relevant, 10).select("qid", "found", "reciprocal_rank")


# --- keys and tenants ----------------------------------------------------------------------------------------------------------


def _keys(spark, d, versions: int = 1):
    """Keys of the sources, of which there are a few."""
    keys = SEC.Keys(SEC.MemoryStore())
    names = [r["source"] for r in _docs(spark, d).where("source is not null").select("source").distinct().limit(10_001).collect()]
    if len(names) > 10_000:
        raise ValueError("more than 10,000 sources")
    for name in sorted(names):
        for _ in range(versions):
            keys.rotate(name)
    return keys, sorted(names)


def _secret(spark, d):
    return _docs(spark, d).where("text is not null and source is not null").select("doc_id", F.col("source").alias("tenant_id"), F.col("text").alias("content"))


@query("SELECT doc_id, sha256(text) AS hash, 1::BIGINT AS version, false AS repeated FROM documents WHERE text IS NOT NULL AND source IS NOT NULL")
def envelope_roundtrip(spark, d):
    keys, _ = _keys(spark, d)
    sealed = SEC.seal(_secret(spark, d), keys.table(spark))
    opened = SEC.unseal(sealed, keys.table(spark))
    # No two payloads have the same data key, equal texts included.
    same = F.when(F.col("payload") == F.col("content"), True).otherwise(False)
    return opened.select("doc_id", T.text_hash(F.col("content")).alias("hash"), F.col("key_version").cast("long").alias("version"), same.alias("repeated"))


@query("SELECT doc_id, sha256(text) AS hash, 2::BIGINT AS version FROM documents WHERE text IS NOT NULL AND source IS NOT NULL")
def key_rotation(spark, d):
    """Data keys are wrapped again by a new version; the payloads then open with the new version alone."""
    keys, names = _keys(spark, d)
    sealed = SEC.seal(_secret(spark, d), keys.table(spark))
    for name in names:
        keys.rotate(name)
    good, failed = SEC.rewrap(sealed, keys.table(spark))
    newest = keys.table(spark).where("version = 2")
    return SEC.unseal(good, newest).unionByName(failed.withColumn("content", F.lit(None).cast("string"))).select("doc_id", T.text_hash(F.col("content")).alias("hash"), F.col("key_version").cast("long").alias("version"))


@query("WITH s AS (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL), n AS (SELECT source, row_number() OVER (ORDER BY source) AS k FROM s) SELECT doc_id, CASE WHEN k % 2 = 0 THEN sha256(text) END AS hash FROM documents JOIN n USING (source) WHERE text IS NOT NULL")
def keys_destroyed(spark, d):
    """Without its key nothing of a tenant can be read."""
    keys, names = _keys(spark, d)
    sealed = SEC.seal(_secret(spark, d), keys.table(spark))
    table_ = keys.table(spark)
    for name in names[::2]:
        keys.destroy(name)
    left = table_.where(F.col("tenant_id").isin([n for n in names if keys.exists(n)]))
    return SEC.unseal(sealed, left).select("doc_id", T.text_hash(F.col("content")).alias("hash"))


@query(f"SELECT id FROM {_DOCUMENTS} WHERE tenant_id = (SELECT min(tenant_id) FROM rag_documents)")
def tenant_context(spark, d):
    docs = _documents(spark, d)
    tenants = SEC.Tenants(strict=True)
    with tenants.as_tenant(docs.agg(F.min("tenant_id").alias("t")).first()["t"]):
        return tenants.only(docs).select("id")


@query(f"{_INGEST} SELECT doc_id AS id, is_new, version::BIGINT AS version FROM v WHERE tenant_id NOT LIKE 'm%'")
def ingest_without_shredded(spark, d):
    arrivals = _arrivals(spark, d)
    gone = arrivals.where("tenant_id like 'm%'").select("tenant_id")
    return ST.ingest(arrivals.where("tenant_id is not null"), shredded=gone).select("id", "is_new", "version")


@query("WITH s AS (SELECT source AS tenant_id, text, sha256(text) AS h, ingested_at, doc_id FROM documents WHERE text IS NOT NULL), o AS (SELECT DISTINCT tenant_id, h FROM s WHERE doc_id % 2 = 0), n AS (SELECT s.*, o.h IS NOT NULL AS held FROM s LEFT JOIN o ON s.tenant_id IS NOT DISTINCT FROM o.tenant_id AND s.h = o.h AND s.tenant_id IS NOT NULL WHERE doc_id % 2 = 1) SELECT doc_id AS id, row_number() OVER (PARTITION BY tenant_id, h ORDER BY ingested_at, doc_id) = 1 AND NOT held AS is_new FROM n")
def ingest_against_existing(spark, d):
    """The even half is held already; of the odd half only texts that their tenant doesn't hold are new."""
    rows = _arrivals(spark, d)
    held = rows.where("id % 2 = 0 and content is not null").select("tenant_id", T.text_hash(F.col("content")).alias("content_hash"), F.lit(None).cast("timestamp").alias("soft_deleted_at"), F.lit("{}").alias("metadata"), F.lit(1).cast("long").alias("version"))
    return ST.ingest(rows.where("id % 2 = 1"), held).select("id", "is_new")


@query(f"SELECT indexed_namespace AS namespace FROM {_DOCUMENTS} WHERE indexed_namespace IS NOT NULL UNION SELECT 'documents'")
def indexed_namespaces(spark, d):
    return ST.indexed_namespaces(_documents(spark, d))


@query(f"SELECT tenant_id, count(*) AS documents, count(*) FILTER (soft_deleted_at IS NOT NULL OR size % 5 = 0) AS deleted FROM {_DOCUMENTS} GROUP BY 1")
def soft_deletes(spark, d):
    docs = _documents(spark, d)
    out = ST.soft_delete(docs, docs.where("size % 5 = 0"), F.lit("2030-01-01").cast("timestamp"))
    return out.groupBy("tenant_id").agg(F.count("*").alias("documents"), F.count("soft_deleted_at").alias("deleted"))


@query(f"WITH c AS (SELECT id, json_extract_string(CASE WHEN json_valid(metadata) THEN metadata END, '$.document_id') AS document_id FROM {_CHUNKS}), g AS (SELECT id FROM {_DOCUMENTS} WHERE size % 3 = 0), k AS (SELECT * FROM c WHERE document_id IS NULL OR document_id NOT IN (SELECT id FROM g)) SELECT (SELECT count(*) FROM {_DOCUMENTS}) - (SELECT count(*) FROM g) AS documents, (SELECT count(*) FROM k) AS chunks, (SELECT count(*) FROM k) AS vectors")
def purge_cascade(spark, d):
    """Documents go with their chunks, and the chunks with their vectors."""
    docs = _documents(spark, d)
    chunks = _chunks(spark, d).select("id", F.try_variant_get(F.try_parse_json("metadata"), "$.document_id", "string").alias("document_id"))
    left, chunks_, vectors = ST.purge(docs, chunks, _chunks(spark, d).select("id", "namespace"), docs.where("size % 3 = 0").select("id"))
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(left, "documents").crossJoin(one(chunks_, "chunks")).crossJoin(one(vectors, "vectors"))  # one row each


@query(f"{_SNAPSHOT} SELECT tenant_id, CASE WHEN bytes + 1000000 > 1050000 THEN 'bytes' END AS exceeded FROM s WHERE bytes + 1000000 > 1050000 AND tenant_id IS NOT NULL")
def quota_with_new_bytes(spark, d):
    none = spark.createDataFrame([], "tenant_id string, max_documents long, max_bytes long, max_tokens long")
    held = tenant_snapshot(spark, d)
    new = held.select("tenant_id", F.lit(400_000).cast("long").alias("bytes"))
    more = new.unionByName(held.select("tenant_id", F.lit(600_000).cast("long").alias("bytes")))
    return ST.over_quota(held.where("tenant_id is not null"), none, {"documents": None, "bytes": 1_050_000, "tokens": None}, more).select("tenant_id", "exceeded")


@query(f"WITH c AS (SELECT json_extract_string(CASE WHEN json_valid(metadata) THEN metadata END, '$.document_id') AS document_id FROM {_CHUNKS}) SELECT count(*) = 0 AS consistent FROM c WHERE document_id IS NULL OR document_id NOT IN (SELECT id FROM {_DOCUMENTS})")
def reconcile_verdict(spark, d):
    owner = F.try_variant_get(F.try_parse_json("metadata"), "$.document_id", "string")
    vectors = _chunks(spark, d).select("id", owner.alias("document_id"))
    whole = ST.is_consistent(vectors.select(F.col("id").alias("chunk_id"), F.lit(False).alias("is_parent")), vectors, _documents(spark, d))
    return spark.createDataFrame([(whole,)], "consistent boolean")


@query("SELECT doc_id, 'caller' AS origin, source AS kept, sha256(coalesce(text, '')) AS checksum FROM documents WHERE source IS NOT NULL")
def provenance_merge(spark, d):
    source = F.create_map(F.lit("kept"), F.col("source"), F.lit("origin"), F.lit("source"), F.lit("provenance"), F.lit("forged"))
    caller = F.create_map(F.lit("origin"), F.lit("caller"))
    m = ST.provenance(source, caller, source_type=F.lit("text"), checksum=F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    return _docs(spark, d).where("source is not null").select("doc_id", m.alias("m")).select("doc_id", F.element_at("m", "origin").alias("origin"), F.element_at("m", "kept").alias("kept"), F.get_json_object(F.element_at("m", "provenance"), "$.checksum").alias("checksum"))


# --- the write path --------------------------------------------------------------------------------------------------------------


@query("SELECT source AS tenant_id, count(DISTINCT text) FILTER (doc_id % 2 = 0 OR doc_id % 4 = 1) AS wanted FROM (SELECT source, doc_id, text FROM documents WHERE text IS NOT NULL AND source IS NOT NULL) d WHERE NOT EXISTS (SELECT 1 FROM documents o WHERE o.text = d.text AND o.source = d.source AND o.doc_id % 4 = 3) GROUP BY 1 HAVING wanted > 0")
def embedding_cache_expires(spark, d):
    """Of the cached texts, those of ids 4n + 3 are a day old, those of ids 4n + 1 too old to count."""
    rows = _docs(spark, d).where("text is not null and source is not null").select(F.col("source").alias("tenant_id"), "text", "doc_id")
    key = EM.cache_key(F.col("tenant_id"), F.col("text"), "deterministic", "fake-embed-v1", 8)
    age = F.when(F.col("doc_id") % 4 == 3, 1).otherwise(31)
    cache = rows.where("doc_id % 2 = 1").select(key.alias("key"), F.array(F.lit(0.0)).alias("v"), (F.lit("2030-01-31").cast("timestamp") - F.make_dt_interval(age)).alias("made_at"), "tenant_id")
    chunks, fresh = EM.with_cache(rows.select("tenant_id", "text"), cache, EM.EMBEDDERS.get("deterministic"), 8, now=F.lit("2030-01-31").cast("timestamp"))
    return fresh.select("key").join(rows.select(key.alias("key"), "tenant_id").distinct(), "key").groupBy("tenant_id").agg(F.count("*").alias("wanted"))


@query("SELECT source AS tenant_id, count(*) AS left_ FROM documents WHERE text IS NOT NULL AND source <> (SELECT min(source) FROM documents) GROUP BY 1")
def cache_cleared(spark, d):
    rows = _docs(spark, d).where("text is not null and source is not null").select(F.col("source").alias("tenant_id"), "text")
    return EM.clear_cache(rows, rows.agg(F.min("tenant_id")).first()[0]).groupBy("tenant_id").agg(F.count("*").alias("left_"))


def _sources(spark, d):
    return _docs(spark, d).select(F.col("doc_id").cast("string").alias("document_id"), F.col("source").alias("tenant_id"), F.col("text").cast("binary").alias("content"), F.lit("text/plain").alias("mime"), F.create_map(F.lit("title"), F.coalesce("document_key", F.lit("")), F.lit("provenance"), F.lit("x")).alias("metadata"), F.col("ingested_at").alias("at")).where("content is not null and tenant_id is not null")


@query()
def pipeline_index(spark, d):
    """The whole write path: parsed, cleaned, redacted, chunked, embedded."""
    out = PL.index_documents(_sources(spark, d))
    return out.chunks.groupBy("document_id").agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"), F.count("v").alias("vectors"), F.max(F.map_contains_key("metadata", "provenance")).alias("leaked"))


@query("SELECT doc_id::VARCHAR AS document_id, 'indexed' AS status, sha256(text) AS content_hash, 'documents' AS indexed_namespace FROM documents WHERE text IS NOT NULL AND source IS NOT NULL")
def pipeline_states(spark, d):
    return PL.index_documents(_sources(spark, d)).documents.select("document_id", "status", "content_hash", "indexed_namespace")


@query()
def pipeline_usage(spark, d):
    return PL.index_documents(_sources(spark, d), cost_per_1000=0.02).usage.drop("created_at", "period").withColumn("cost", F.col("cost").cast("double"))


@query(rf"WITH w AS (SELECT doc_id, lang, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}]+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL) SELECT doc_id, lang AS language FROM w WHERE lang IS NOT NULL")
def language_kept(spark, d):
    """A language that is known stays."""
    rows = _docs(spark, d).where("text is not null and lang is not null").select("doc_id", "text", F.col("lang").alias("language"))
    return PL.with_language(rows).select("doc_id", "language")


@query()
def redacted_tree(spark, d):
    """Text, sections and metadata masked together."""
    meta = F.from_json("metadata", "map<string, string>")
    rows = _chunks(spark, d).where("content is not null").select("id", F.col("content").alias("text"), F.array(F.struct(F.lit("paragraph").alias("type"), F.col("content").alias("content"), F.lit(0).alias("level"), F.lit(1).alias("page"))).alias("sections"), F.when(F.try_parse_json("metadata").isNotNull(), meta).alias("metadata"))
    out = PL.redacted(rows)
    same = F.col("text") == F.get("sections", F.lit(0))["content"]
    return out.select("id", same.alias("same"), F.contains("text", F.lit("@")).alias("left_"), F.map_contains_key(F.coalesce("metadata", F.create_map().cast("map<string, string>")), "author").alias("author"))


# --- rows as documents ------------------------------------------------------------------------------------------------------------


def _customers(spark, d):
    """Customers with their nation and orders; orders lead back to the customer, which ends there."""
    nation = M.Definition("nation", table(spark, d, "nation"), "n_nationkey").text(F.col("n_name"))
    plain = M.Definition("customer", table(spark, d, "customer"), "c_custkey").text(F.col("c_name"))
    orders = M.Definition("order", table(spark, d, "orders"), "o_orderkey").text(F.concat_ws(" ", "o_orderstatus", "o_orderkey")).include("owner", plain, "o_custkey")
    return plain.add("segment", F.col("c_mktsegment")).include("home", nation, "c_nationkey").include_many("order", orders, "o_custkey").metadata(kind=F.lit("customer"))


@query("WITH o AS (SELECT o_custkey AS k, string_agg('[order]' || chr(10) || o_orderstatus || ' ' || o_orderkey, chr(10) || chr(10) ORDER BY o_orderkey) AS p, count(*) AS n FROM orders GROUP BY 1) SELECT c_custkey::BIGINT AS key, sha256(c_name || chr(10) || chr(10) || 'segment: ' || c_mktsegment || chr(10) || chr(10) || '[home]' || chr(10) || n_name || CASE WHEN p IS NULL THEN '' ELSE chr(10) || chr(10) || p END) AS hash, 'customer:' || c_custkey AS document_key, (1 + coalesce(n, 0))::BIGINT AS included FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN o ON k = c_custkey")
def model_compile(spark, d):
    out = M.compile_definition(_customers(spark, d))
    return out.select(F.col("key").cast("long").alias("key"), T.text_hash(F.col("content")).alias("hash"), "document_key", F.size("included").cast("long").alias("included"))


@query("SELECT c_custkey::BIGINT AS key, sha256(c_name) AS hash FROM customer")
def model_searchable(spark, d):
    """Of the listed columns those that hold text."""
    out = M.compile_definition(M.searchable("customer", table(spark, d, "customer"), "c_custkey", ["c_name", "c_nationkey", "no_such_column"]))
    return out.select(F.col("key").cast("long").alias("key"), T.text_hash(F.col("content")).alias("hash"))


@query("SELECT 'customer:' || c_custkey AS document_key, CASE WHEN c_custkey % 11 = 0 THEN 'forget' WHEN c_custkey % 7 = 0 THEN 'add' WHEN c_custkey % 5 = 0 THEN 'update' ELSE 'process' END AS change FROM customer WHERE (c_custkey % 11 = 0 AND c_custkey % 7 <> 0) OR (c_custkey % 11 <> 0 AND (c_custkey % 7 = 0 OR c_custkey % 5 = 0 OR c_custkey % 3 = 0))")
def model_sync_plan(spark, d):
    rows = table(spark, d, "customer")
    text = F.when(F.col("c_custkey") % 11 == 0, F.lit(" ")).otherwise(F.col("c_name"))
    compiled = M.compile_definition(M.Definition("customer", rows, "c_custkey").text(text))
    held = rows.where("c_custkey % 7 <> 0").select(F.concat(F.lit("customer:"), "c_custkey").alias("document_key"), T.text_hash(F.when(F.col("c_custkey") % 5 == 0, F.lit("old")).otherwise(F.col("c_name"))).alias("content_hash"), F.when(F.col("c_custkey") % 3 == 0, "failed").otherwise("indexed").alias("status"))
    return M.sync_plan(compiled, held).select("document_key", "change")


@query("WITH k AS (SELECT id, tenant_id, version, soft_deleted_at, json_extract_string(CASE WHEN json_valid(metadata) THEN metadata END, '$.document_key') AS document_key FROM " + _DOCUMENTS + "), n AS (SELECT id FROM k WHERE soft_deleted_at IS NULL QUALIFY row_number() OVER (PARTITION BY tenant_id, document_key ORDER BY version DESC, id DESC) = 1) SELECT id FROM k WHERE document_key IS NOT NULL AND id NOT IN (SELECT id FROM n)")
def model_other_generations(spark, d):
    docs = _documents(spark, d).withColumn("document_key", F.try_variant_get(F.try_parse_json("metadata"), "$.document_key", "string"))
    return M.other_generations(docs)


@query(f"WITH c AS (SELECT id, json_extract_string(CASE WHEN json_valid(metadata) THEN metadata END, '$.document_id') AS document_id FROM {_CHUNKS}) SELECT c.id, CASE WHEN right(c.id, 1) = '0' THEN 'Own' WHEN d.id IS NOT NULL THEN 'Row' END AS model, CASE WHEN right(c.id, 1) = '0' THEN c.id ELSE d.id END AS model_key FROM c LEFT JOIN {_DOCUMENTS} d ON d.id = c.document_id")
def hits_to_models(spark, d):
    own = F.col("id").endswith("0")
    hits = _chunks(spark, d).select("id", F.try_variant_get(F.try_parse_json("metadata"), "$.document_id", "string").alias("document_id"), F.when(own, "Own").alias("embeddable_type"), F.when(own, F.col("id")).alias("embeddable_id"))
    docs = _documents(spark, d).select("id", F.lit("Row").alias("embeddable_type"), F.col("id").alias("embeddable_id"))
    return M.resolve(hits, docs).select("id", "model", "model_key")


# --- sources -----------------------------------------------------------------------------------------------------------------------


def _fetch(url: str, addresses: list[str]) -> tuple[int, str | None, bytes]:
    """An offline web: every third page by the length of its address is missing, every second names no type."""
    return (404 if len(url) % 3 == 0 else 200), (None if len(url) % 2 else "Text/Plain; charset=utf-8"), url.encode()


@query("WITH u AS (SELECT DISTINCT 'https://pages.example/' || source || '/' || doc_id AS url FROM documents WHERE source IS NOT NULL), a AS (SELECT url FROM u UNION ALL SELECT 'http://10.0.0.1/' || doc_id FROM documents WHERE doc_id % 100 = 0) SELECT url, CASE WHEN url LIKE 'http:%' OR length(url) % 3 = 0 THEN NULL WHEN length(url) % 2 = 1 THEN 'text/html' ELSE 'text/plain' END AS mime, CASE WHEN url LIKE 'http:%' THEN 'not a public http or https address' WHEN length(url) % 3 = 0 THEN 'status 404' END AS error FROM a")
def web_pages(spark, d):
    rows = _docs(spark, d)
    urls = rows.where("source is not null").select(F.concat(F.lit("https://pages.example/"), "source", F.lit("/"), "doc_id").alias("url")).distinct()
    own = rows.where("doc_id % 100 = 0").select(F.concat(F.lit("http://10.0.0.1/"), "doc_id").alias("url"))
    return R.web_pages(urls.unionByName(own), _fetch, lambda host: ["93.184.215.14"]).select("url", "mime", "error")


@query(f"SELECT doc_id, CASE WHEN document_key IS NULL OR n IS NULL THEN 'missing' WHEN n = 0 THEN 'empty' WHEN n > 5000 THEN 'too large' END AS skipped FROM documents LEFT JOIN (SELECT doc_id AS f, strlen(coalesce(text, '')) AS n FROM documents WHERE doc_id % 3 > 0) ON f = doc_id")
def row_files(spark, d):
    rows = _docs(spark, d)
    path = F.concat(F.lit("files/"), "doc_id")
    held = rows.where("doc_id % 3 > 0").select(path.alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content")).withColumn("length", F.octet_length("content"))
    named = rows.select("doc_id", F.when(F.col("document_key").isNotNull(), path).alias("file"))
    return R.row_files(named, "file", held, 5000).select("doc_id", "skipped")


