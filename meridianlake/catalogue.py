"""Queries of the core operators, each over its whole tables, and the SQL they are checked against.

A query is registered with its SQL by `query`; without SQL it is checked by rows here and by value in the tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import filters as FL
from .functions import text as T
from .functions import vectors as V
from .operators import chunking as C
from .operators import evaluation as E
from .operators import search as S
from .operators import store as ST
from .plans.retrieval import Search, ask
from .sources import parsers as P
from .sources import readers as R
from .sources.sinks import shared_folder

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- vectors -------------------------------------------------------------------------------------------------------------


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("v"), F.col("label").cast("long").alias("label"))


def _asked(spark, d):
    """The stated query set: every row whose id is divisible by 100."""
    return _vectors(spark, d).where("id % 100 = 0").select(F.col("id").alias("qid"), F.col("v").alias("q"), "label")


_V = "SELECT vec_id::BIGINT AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v, label::BIGINT AS label FROM embeddings"
_PAIRS = f"WITH e AS ({_V}), pairs AS (SELECT a.id AS qid, b.id AS id, a.v AS q, b.v AS v, a.label AS qlabel, b.label AS label FROM e a, e b WHERE a.id % 100 = 0)"


def _topk_sql(score: str, k: int = 10, where: str = "true") -> str:
    return f"{_PAIRS} SELECT qid, id, score, rank FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (SELECT qid, id, round({score}, 6) AS score FROM pairs WHERE {where})) WHERE rank <= {k}"


def _long_rank(df: DataFrame) -> DataFrame:
    return df.select("qid", "id", "score", F.col("rank").cast("long").alias("rank"))


@query(_topk_sql("list_cosine_similarity(q, v)"))
def vector_topk_cosine(spark, d):
    return _long_rank(S.exact_topk(_vectors(spark, d), _asked(spark, d), 10))


@query(_topk_sql("list_dot_product(q, v)"))
def vector_topk_dot(spark, d):
    return _long_rank(S.exact_topk(_vectors(spark, d), _asked(spark, d), 10, "dot"))


@query(_topk_sql("1 / (1 + list_distance(q, v))"))
def vector_topk_l2(spark, d):
    return _long_rank(S.exact_topk(_vectors(spark, d), _asked(spark, d), 10, "l2"))


@query(_topk_sql("list_cosine_similarity(q, v)", 10, "list_cosine_similarity(q, v) >= 0.2"))
def vector_threshold(spark, d):
    return _long_rank(S.exact_topk(_vectors(spark, d), _asked(spark, d), 10, threshold=0.2))


@query(_topk_sql("list_cosine_similarity(q, v)", 10, "qlabel = label"))
def tenant_scoped_search(spark, d):
    vectors, asked = _vectors(spark, d).withColumn("scope", F.col("label")), _asked(spark, d).withColumn("scope", F.col("label"))
    return _long_rank(S.exact_topk(vectors, asked, 10))


@query(f"WITH e AS ({_V}), z AS (SELECT id, v, list_transform(v, lambda x: 0.0::DOUBLE) AS zero FROM e) SELECT id, CASE WHEN list_dot_product(zero, zero) > 0 THEN 1.0 ELSE 0.0 END AS score, round(sqrt(list_dot_product(v, v)), 6) AS norm FROM z")
def vector_zero_norm_guard(spark, d):
    zero = F.transform("v", lambda x: F.lit(0.0))
    return _vectors(spark, d).select("id", V.cosine(F.col("v"), zero).alias("score"), F.round(V.norm(F.col("v")), 6).alias("norm"))


def _meta(spark, d):
    """Vectors with JSON metadata in which the key `env` is missing for some rows and null for others."""
    env = F.when(F.col("label") == 0, F.lit("{}")).when(F.col("label") == 1, F.lit('{"env":null}')).otherwise(F.concat(F.lit('{"env":"e'), F.col("label"), F.lit('","n":'), F.col("label"), F.lit(',"s":"'), F.col("label"), F.lit('"}')))
    return _vectors(spark, d).withColumn("metadata", env)


def _filtered(conditions):
    return lambda spark, d: _meta(spark, d).where(FL.matches(F.col("metadata"), conditions)).select("id", "label")


for _name, _conditions, _where in (
    ("vector_filter_eq", {"env": "e3"}, "label = 3"),
    ("vector_filter_strict_type", {"s": ["3", 4]}, "label = 3"),
    ("vector_filter_lt_zero", {"n": {"lt": 0}}, "false"),
    ("vector_filter_lte_zero", {"n": {"lte": 0}}, "label <= 1"),
    ("vector_filter_gte_zero", {"n": {"gte": 0}}, "true"),
    ("vector_filter_null", {"env": None}, "label <= 1"),
    ("vector_filter_in", {"env": ["e2", "e4"]}, "label IN (2, 4)"),
    ("vector_filter_neq_missing", {"env": {"neq": "e3"}}, "label <> 3"),
    ("vector_filter_nin_missing", {"env": {"nin": ["e3", "e5"]}}, "label NOT IN (3, 5)"),
    ("vector_filter_range", {"n": {"gte": 3, "lte": 6}}, "label BETWEEN 3 AND 6"),
    ("vector_filter_lt_missing", {"n": {"lt": 4}}, "label < 4"),
    ("vector_filter_conjunction", {"n": {"gt": 2}, "env": ["e3", "e7", None]}, "label IN (3, 7)"),
):
    _QUERIES[_name] = _filtered(_conditions)
    _SQL[_name] = f"SELECT id, label FROM ({_V}) WHERE {_where}"


@query(f"SELECT label AS namespace, count(*) AS vectors FROM ({_V}) GROUP BY label")
def namespace_count(spark, d):
    return _vectors(spark, d).groupBy(F.col("label").alias("namespace")).agg(F.count("*").alias("vectors"))


@query("SELECT CASE WHEN vec_id % 3 = 0 THEN 'changed' ELSE 'kept' END AS state, count(*) AS n, round(sum(CASE WHEN vec_id % 3 = 0 THEN -embedding[1]::DOUBLE ELSE embedding[1]::DOUBLE END), 6) AS first_sum FROM embeddings GROUP BY 1")
def vector_upsert_last_wins(spark, d):
    rows = _vectors(spark, d).select(F.lit("docs").alias("namespace"), "id", F.col("v").cast("array<double>").alias("v"), F.lit("kept").alias("state"))
    # Each changed id comes three times in one batch; the last of its changes counts.
    changes = rows.where("id % 3 = 0")
    times = [changes.select("namespace", "id", F.transform("v", lambda x: x * m).alias("v"), F.lit(state).alias("state"), F.lit(n).alias("seq")) for n, m, state in ((1, 5.0, "early"), (3, -1.0, "changed"), (2, 7.0, "between"))]
    return ST.upsert(rows, times[0].unionByName(times[1]).unionByName(times[2]), 64).groupBy("state").agg(F.count("*").alias("n"), F.round(F.sum(F.element_at("v", 1)), 6).alias("first_sum"))


@query("SELECT vec_id::BIGINT AS id FROM embeddings WHERE vec_id % 7 <> 0")
def delete_by_ids(spark, d):
    rows = _vectors(spark, d)
    return ST.delete_ids(rows, rows.where("id % 7 = 0")).select("id")


@query(f"SELECT id FROM ({_V}) WHERE label <> 4")
def delete_by_filter(spark, d):
    rows = _meta(spark, d)
    return ST.delete_matching(rows, FL.matches(F.col("metadata"), {"env": "e4"})).select("id")


@query("WITH s AS (SELECT vec_id::BIGINT AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), m AS (SELECT id, v, list_max(list_transform(v, lambda x: abs(x))) AS top FROM s) SELECT id, list_sum(list_transform(v, lambda x: round(x / top * 127)))::BIGINT AS total, list_max(list_transform(v, lambda x: round(x / top * 127)))::BIGINT AS largest FROM m")
def quantize_int8(spark, d):
    return _vectors(spark, d).select("id", V.int8(F.col("v")).alias("b")).select("id", F.aggregate("b", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), F.array_max("b").cast("long").alias("largest"))


@query(f"{_PAIRS}, h AS (SELECT qid, id, list_sum(list_transform(list_zip(q, v), lambda p: CASE WHEN (p[1] > 0) <> (p[2] > 0) THEN 1 ELSE 0 END))::BIGINT AS distance FROM pairs) SELECT qid, id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank FROM h) WHERE rank <= 10")
def binary_hamming_topk(spark, d):
    # Of vectors of signs, the product falls by two with each bit in which they differ.
    signs = lambda c: F.transform(c, lambda x: F.when(x > 0, 1.0).otherwise(-1.0))
    near = S.exact_topk(_vectors(spark, d).withColumn("v", signs("v")), _asked(spark, d).withColumn("q", signs("q")), 10, "dot")
    return near.select("qid", "id", ((64 - F.col("score")) / 2).cast("long").alias("distance"), F.col("rank").cast("long").alias("rank"))


@query(f"SELECT id, list_sum(list_transform(v, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END))::BIGINT AS ones FROM ({_V})")
def quantize_binary(spark, d):
    return _vectors(spark, d).select("id", (F.bit_count(V.sign_bits(F.col("v"), 0, 32)) + F.bit_count(V.sign_bits(F.col("v"), 32, 32))).cast("long").alias("ones"))


def planes(n: int = 8, dimensions: int = 64) -> list[list[float]]:
    """Normals of hyperplanes, the same everywhere: cosines of multiples of an angle without a period."""
    from math import cos

    return [[round(cos(1.7 * (i * dimensions + j + 1) ** 1.1), 6) for j in range(dimensions)] for i in range(n)]


_BUCKET = " + ".join(f"CASE WHEN list_dot_product(v, {p}::DOUBLE[]) > 0 THEN {1 << i} ELSE 0 END" for i, p in enumerate(planes()))


@query(f"SELECT ({_BUCKET})::BIGINT AS bucket, count(*) AS vectors FROM ({_V}) GROUP BY 1")
def lsh_buckets(spark, d):
    return S.sign_buckets(_vectors(spark, d), planes()).groupBy(F.col("bucket").cast("long").alias("bucket")).agg(F.count("*").alias("vectors"))


@query(f"WITH e AS ({_V}), b AS MATERIALIZED (SELECT *, ({_BUCKET}) AS bucket FROM e), p AS (SELECT x.id AS qid, y.id AS id, round(list_cosine_similarity(x.v, y.v), 6) AS score FROM b x JOIN b y ON bit_count(xor(x.bucket, y.bucket)) <= 1 WHERE x.id % 100 = 0) SELECT qid, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM p) WHERE rank <= 10")
def lsh_search(spark, d):
    return _long_rank(S.bucket_topk(_vectors(spark, d), _asked(spark, d), 10, planes()))


def _mmr_sql(near: str, k: int, share: float) -> str:
    """Greedy choice by recursion. near: a table (qid, id, rank, v, q); one step chooses one hit of each query."""
    length = lambda x: f"sqrt(list_dot_product({x}, {x}))"
    unit = lambda x: f"list_transform({x}, lambda e: e / CASE WHEN {length(x)} > 0 THEN {length(x)} ELSE 1 END)"
    return (
        f"u AS (SELECT qid, id, rank, {unit('v')} AS u, {unit('q')} AS uq FROM {near}), "
        "pool AS (SELECT qid, list(id ORDER BY rank, id) AS ids, list(u ORDER BY rank, id) AS us, list(list_dot_product(u, uq) ORDER BY rank, id) AS near FROM u GROUP BY qid), "
        "pick(qid, ids, us, near, chosen, worst) AS (SELECT qid, ids, us, near, []::BIGINT[], list_transform(us, lambda x: 0.0::DOUBLE) FROM pool UNION ALL "
        "SELECT qid, ids, us, near, list_append(chosen, p), list_transform(range(1, len(us) + 1), lambda i: greatest(worst[i], list_dot_product(us[i], us[p]))) FROM (SELECT *, list_position(gain, list_max(gain))::BIGINT AS p FROM "
        f"(SELECT *, list_transform(range(1, len(us) + 1), lambda i: CASE WHEN list_contains(chosen, i) THEN -1e9 ELSE round({share}::DOUBLE * near[i] - {1 - share}::DOUBLE * worst[i], 9) END) AS gain FROM pick WHERE len(chosen) < least({k}, len(us))))), "
        f"chosen AS (SELECT qid, ids[chosen[n]] AS id, n::INTEGER AS rank FROM (SELECT qid, ids, chosen, unnest(range(1, len(chosen) + 1)) AS n FROM pick WHERE len(chosen) = least({k}, len(us))))"
    )


@query(_PAIRS.replace("WITH e", "WITH RECURSIVE e") + ", near40 AS MATERIALIZED (SELECT * FROM (SELECT qid, id, v, q, row_number() OVER (PARTITION BY qid ORDER BY round(list_cosine_similarity(q, v), 6) DESC, id) AS rank FROM pairs) WHERE rank <= 40), " + _mmr_sql("near40", 10, 0.5) + " SELECT qid, id, rank FROM chosen")
def mmr_select(spark, d):
    asked = _asked(spark, d)
    pool = S.exact_topk(_vectors(spark, d), asked, 40).join(_vectors(spark, d).select("id", "v"), "id")
    return S.diverse(pool, asked, 10, 0.5)


# --- text ----------------------------------------------------------------------------------------------------------------


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source", "document_key", "mime", "ingested_at", "n_chars")


_WS = "chr(32)||chr(9)||chr(10)||chr(13)||chr(11)"
_CLEAN = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n|\r', chr(10), 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '[\x{00AD}\x{200B}-\x{200D}\x{FEFF}]', '', 'g'), '\n{3,}', chr(10)||chr(10), 'g'), '[ \t]{2,}', ' ', 'g'), '[ \t]+\n', chr(10), 'g'), """ + _WS + ")"


@query(f"SELECT doc_id, length({_CLEAN})::BIGINT AS chars, sha256({_CLEAN}) AS hash FROM documents WHERE text IS NOT NULL")
def text_clean(spark, d):
    t = T.clean(F.col("text"))
    return _docs(spark, d).where("text is not null").select("doc_id", F.char_length(t).cast("long").alias("chars"), T.text_hash(t).alias("hash"))


_TOKENS = f"CASE WHEN trim(text, {_WS}) = '' THEN 0 ELSE greatest(1, floor((ceil(len(regexp_split_to_array(trim(text, {_WS}), '[\\s\\x0B\\x85\\x{{00A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+')) * 1.3::DOUBLE) + ceil(length(trim(text, {_WS})) / 4.0::DOUBLE)) / 2 + 0.5)) END::BIGINT"


@query(f"SELECT doc_id, {_TOKENS} AS tokens FROM documents WHERE text IS NOT NULL")
def token_count(spark, d):
    return _docs(spark, d).where("text is not null").select("doc_id", T.token_count(F.col("text")).alias("tokens"))


_PREFIX = _TOKENS.replace("text", "s")


@query(f"WITH t AS (SELECT doc_id, text, {_TOKENS} AS tokens FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, CASE WHEN tokens <= 50 THEN text ELSE rtrim(list_filter(list_transform(range(0, 51), lambda k: substr(text, 1, 200 - 4 * k)), lambda s: {_PREFIX} <= 50)[1], {_WS}) END AS text FROM t) SELECT doc_id, {_TOKENS} AS tokens, length(text)::BIGINT AS chars FROM c")
def token_truncate(spark, d):
    t = T.truncate_tokens(F.col("text"), 50)
    return _docs(spark, d).where("text is not null").select("doc_id", T.token_count(t).alias("tokens"), F.char_length(t).cast("long").alias("chars"))


_WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}]+'), lambda w: w <> '')"
# The stop words once more, as the requirement states them.
_STOPS = {
    "it": "il lo la che di e un una per con non sono gli nel alla come più anche",
    "de": "der die das und ist nicht ein eine mit auf für den von zu auch werden sind",
    "en": "the and is of to in that it for with as are this be on not or",
}
_VOTES = ", ".join(f"len(list_filter(w, lambda x: x IN ({', '.join(repr(s) for s in stop.split())}))) AS {lang}" for lang, stop in _STOPS.items())


@query(f"WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL), v AS (SELECT doc_id, {_VOTES} FROM d) SELECT doc_id, CASE WHEN greatest(it, de, en) = 0 THEN NULL WHEN it = greatest(it, de, en) THEN 'it' WHEN de = greatest(it, de, en) THEN 'de' ELSE 'en' END AS detected FROM v")
def language_detect(spark, d):
    return _docs(spark, d).where("text is not null").select("doc_id", T.language_vote(F.col("text")).alias("detected"))


_TERMS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')"


@query(f"SELECT doc_id, len({_TERMS})::BIGINT AS terms, len(list_distinct({_TERMS}))::BIGINT AS distinct_terms FROM documents WHERE text IS NOT NULL")
def term_tokenize(spark, d):
    t = T.terms(F.col("text"))
    return _docs(spark, d).where("text is not null").select("doc_id", F.size(t).cast("long").alias("terms"), F.size(F.array_distinct(t)).cast("long").alias("distinct_terms"))


@query(rf"SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '[\s\x0B]*\n[\s\x0B]*', chr(10), 'g'), {_WS})) AS hash FROM documents WHERE text IS NOT NULL")
def html_whitespace(spark, d):
    return _docs(spark, d).where("text is not null").select("doc_id", T.text_hash(T.collapse_html(F.col("text"))).alias("hash"))


@query(rf"SELECT doc_id, sha256(trim(regexp_replace(text, '[\s\x0B]+', ' ', 'g'), {_WS})) AS hash FROM documents WHERE text IS NOT NULL")
def xml_whitespace(spark, d):
    return _docs(spark, d).where("text is not null").select("doc_id", T.text_hash(T.collapse_xml(F.col("text"))).alias("hash"))


_CHUNKS = "(SELECT id, any_value(tenant_id) AS tenant_id, any_value(content) AS content, any_value(metadata) AS metadata, any_value(namespace) AS namespace FROM rag_pgvectors GROUP BY id)"


def _chunks(spark, d):
    return table(spark, d, "rag_pgvectors").select("id", "tenant_id", "content", "metadata", "namespace").dropDuplicates(["id"])


_EMAIL = r"[\p{L}\p{N}._%+\-]+@(?:[\p{L}\p{N}\-]+\.)+[\p{L}]{2,24}"


@query(f"SELECT id, sha256(regexp_replace(content, '{_EMAIL}', '[EMAIL]', 'g')) AS hash FROM {_CHUNKS}")
def pii_email_mask(spark, d):
    return _chunks(spark, d).select("id", T.text_hash(T.mask_form(F.col("content"), "email")).alias("hash"))


@query(f"SELECT id, unnest(regexp_extract_all(content, '{_EMAIL}')) AS item FROM {_CHUNKS}")
def pii_email_items(spark, d):
    return _chunks(spark, d).select("id", F.explode(F.regexp_extract_all("content", F.lit(T.FORMS["email"]), F.lit(0))).alias("item"))


@query(f"SELECT id, item, '[EMAIL:' || substr(sha256('email:' || item), 1, 6) || ']' AS token FROM (SELECT id, unnest(regexp_extract_all(content, '{_EMAIL}')) AS item FROM {_CHUNKS})")
def pii_email_tokenize(spark, d):
    items = pii_email_items(spark, d)
    return items.select("id", "item", F.concat(F.lit("[EMAIL:"), F.substring(F.sha2(F.concat(F.lit("email:"), "item"), 256), 1, 6), F.lit("]")).alias("token"))


@query(rf"SELECT id, len(regexp_extract_all(content, '\b[A-Za-z]{{6}}\d{{2}}[A-Za-z]\d{{2}}[A-Za-z]\d{{3}}[A-Za-z]\b'))::BIGINT AS found FROM {_CHUNKS}")
def codice_fiscale(spark, d):
    return _chunks(spark, d).select("id", F.regexp_count("content", F.lit(T.FORMS["codice_fiscale"])).cast("long").alias("found"))


@query()
def pii_redacted(spark, d):
    r = T.redacted(F.col("content"))
    return _chunks(spark, d).select("id", r.alias("r")).select("id", T.text_hash(F.col("r.text")).alias("hash"), F.explode_outer("r.counts").alias("kind", "found"))


# --- ingest, versions, sources --------------------------------------------------------------------------------------------


@query("SELECT source AS tenant_id, sha256(text) AS content_hash, min(doc_id) AS first_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1, 2")
def content_hash_dedup(spark, d):
    return ST.content_dedup(_docs(spark, d).where("text is not null").withColumnRenamed("source", "tenant_id"), ["tenant_id"], ["doc_id"])


def _arrivals(spark, d):
    return _docs(spark, d).select(F.col("source").alias("tenant_id"), "document_key", F.col("text").alias("content"), F.col("ingested_at").alias("arrived"), F.col("doc_id").alias("id"))


_INGEST = "WITH s AS (SELECT source AS tenant_id, document_key, text, ingested_at, doc_id, sha256(text) AS h FROM documents WHERE text IS NOT NULL), n AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, h ORDER BY ingested_at, doc_id) = 1 AS is_new FROM s), v AS (SELECT *, CASE WHEN is_new THEN row_number() OVER (PARTITION BY tenant_id, coalesce(document_key, h), is_new ORDER BY ingested_at, doc_id) ELSE 0 END AS version, lead(1) OVER (PARTITION BY tenant_id, coalesce(document_key, h), is_new ORDER BY ingested_at, doc_id) AS later FROM n)"


@query(f"{_INGEST} SELECT doc_id AS id, is_new, version::BIGINT AS version, is_new AND later IS NOT NULL AS superseded, strlen(text)::BIGINT AS size FROM v")
def ingest_versions(spark, d):
    return ST.ingest(_arrivals(spark, d)).select("id", "is_new", "version", "superseded", "size")


@query(f"{_INGEST} SELECT tenant_id, count(*) AS live FROM v WHERE is_new AND later IS NULL GROUP BY tenant_id")
def live_documents(spark, d):
    return ST.ingest(_arrivals(spark, d)).where("is_new and not superseded").groupBy("tenant_id").agg(F.count("*").alias("live"))


@query("SELECT id, version::BIGINT AS version FROM (SELECT DISTINCT ON (id) * FROM rag_documents) QUALIFY row_number() OVER (PARTITION BY tenant_id, coalesce(json_extract_string(CASE WHEN json_valid(metadata) THEN metadata END, '$.document_key'), id) ORDER BY version DESC, id) = 1")
def latest_versions(spark, d):
    docs = table(spark, d, "rag_documents").dropDuplicates(["id"]).withColumn("own_key", F.coalesce(F.try_variant_get(F.try_parse_json("metadata"), "$.document_key", "string"), F.col("id")))
    return ST.latest(docs, ["tenant_id", "own_key"], [F.desc("version"), F.col("id")]).select("id", F.col("version").cast("long").alias("version"))


@query("SELECT 'nation:' || n_nationkey AS document_key, sha256(n_name || chr(10) || chr(10) || n_regionkey::VARCHAR) AS hash FROM nation")
def row_source(spark, d):
    rows = R.rows_as_text(table(spark, d, "nation"), ["n_name", "n_regionkey"], "n_nationkey", "nation")
    return rows.select("document_key", F.sha2("content", 256).alias("hash"))


@query("SELECT id, coalesce(nullif(json_extract_string(m, '$.url'), ''), nullif(json_extract_string(m, '$.filename'), ''), nullif(json_extract_string(m, '$.document_key'), ''), nullif(json_extract_string(m, '$.source_ref'), ''), nullif(json_extract_string(m, '$.key'), '')) AS source_ref FROM (SELECT id, CASE WHEN json_valid(metadata) THEN metadata END AS m FROM " + _CHUNKS + ")")
def source_references(spark, d):
    readable = F.when(F.try_parse_json("metadata").isNotNull(), F.col("metadata"))
    return _chunks(spark, d).select("id", R.source_ref(readable).alias("source_ref"))


@query("SELECT id, CASE WHEN ext = 'txt' THEN 'text/plain' WHEN ext IN ('md', 'markdown') THEN 'text/markdown' WHEN ext IN ('html', 'htm') THEN 'text/html' WHEN ext = 'xml' THEN 'application/xml' WHEN ext = 'csv' THEN 'text/csv' WHEN ext = 'tsv' THEN 'text/tab-separated-values' WHEN ext IN ('json', 'pdf') THEN 'application/' || ext WHEN ext = 'docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' ELSE 'text/plain' END AS mime FROM (SELECT id, lower(regexp_extract(ref, '\\.([A-Za-z0-9]+)$', 1)) AS ext FROM (SELECT id, json_extract_string(CASE WHEN json_valid(metadata) THEN metadata END, '$.source_ref') AS ref FROM " + _CHUNKS + ") WHERE ref IS NOT NULL)")
def mime_by_extension(spark, d):
    ref = F.try_variant_get(F.try_parse_json("metadata"), "$.source_ref", "string")
    return _chunks(spark, d).select("id", ref.alias("ref")).where("ref is not null").select("id", P.mime_of(F.col("ref")).alias("mime"))


@query("WITH u AS (SELECT id, json_extract_string(CASE WHEN json_valid(metadata) THEN metadata END, '$.source_ref') AS url FROM " + _CHUNKS + "), h AS (SELECT id, url, lower(regexp_extract(url, '^https?://(?:[^/@]*@)?([^/:?#]+)', 1)) AS host FROM u WHERE url LIKE 'http%') SELECT id, host <> '' AND host <> 'localhost' AND host NOT LIKE '%.local' AND host NOT LIKE '%.internal' AND NOT regexp_matches(host, '^(0|10|127|169\\.254|172\\.(1[6-9]|2[0-9]|3[01])|192\\.168|22[4-9]|23[0-9]|24[0-9]|25[0-5])\\.[0-9.]+$') AS safe FROM h")
def safe_urls(spark, d):
    ref = F.try_variant_get(F.try_parse_json("metadata"), "$.source_ref", "string")
    return _chunks(spark, d).select("id", ref.alias("url")).where("url like 'http%'").select("id", R.safe_url(F.col("url")).alias("safe"))


# --- parsers -------------------------------------------------------------------------------------------------------------


@query("SELECT event_id, 'k: ' || json_extract_string(props, '$.k') AS text FROM events WHERE json_valid(props) AND json_extract_string(props, '$.k') IS NOT NULL")
def json_flatten(spark, d):
    rows = table(spark, d, "events").where(F.try_variant_get(F.try_parse_json("props"), "$.k", "string").isNotNull())
    return rows.select("event_id", P.parsed(F.to_json(F.struct(F.try_variant_get(F.try_parse_json("props"), "$.k", "string").alias("k"))).cast("binary"), F.lit("application/json"))["text"].alias("text"))


@query("SELECT n_nationkey::BIGINT AS id, 'key: ' || n_nationkey || ' | name: ' || n_name AS text FROM nation")
def csv_pairs(spark, d):
    row = F.concat(F.lit("key,name\n"), F.col("n_nationkey"), F.lit(","), F.col("n_name")).cast("binary")
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), P.parsed(row, F.lit("text/csv"))["text"].alias("text"))


@query(rf"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL) SELECT doc_id, length(regexp_extract(line, '^(#{{1,6}})\s', 1))::BIGINT AS level, trim(regexp_replace(line, '^#{{1,6}}\s+', ''), {_WS}) AS heading FROM l WHERE regexp_matches(line, '^#{{1,6}}\s+')")
def markdown_headings(spark, d):
    rows = _docs(spark, d).where("text is not null").select("doc_id", F.explode(P.headings(F.col("text"))).alias("h"))
    return rows.select("doc_id", F.col("h.level").cast("long").alias("level"), F.col("h.content").alias("heading"))


@query()
def parsed_documents(spark, d):
    rows = P.parse_documents(_docs(spark, d).withColumn("content", F.col("text").cast("binary")))
    return rows.select("doc_id", F.char_length("parsed.text").cast("long").alias("chars"), F.size("parsed.sections").cast("long").alias("sections"), "parsed.error")


# --- chunks --------------------------------------------------------------------------------------------------------------

_FIXED = f"WITH d AS (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 400)) AS start FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, start::BIGINT AS start, substr(text, start::BIGINT + 1, 500) AS content FROM d), c AS (SELECT * FROM p WHERE trim(content, {_WS}) <> '')"


@query(f"{_FIXED} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1)::BIGINT AS idx, start, sha256(content) AS hash FROM c")
def chunk_fixed(spark, d):
    return C.fixed_chunks(_docs(spark, d).select("doc_id", "text"), "text", 500, 100).select("doc_id", F.col("idx").cast("long").alias("idx"), F.col("start").cast("long").alias("start"), T.text_hash(F.col("content")).alias("hash"))


@query(f"{_FIXED} SELECT doc_id, count(*) AS chunks, sum(length(content))::BIGINT AS chars, max(length(content))::BIGINT AS longest FROM c GROUP BY doc_id")
def chunk_fixed_stats(spark, d):
    return C.fixed_chunks(_docs(spark, d).select("doc_id", "text"), "text", 500, 100).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.char_length("content")).alias("chars"), F.max(F.char_length("content")).cast("long").alias("longest"))


@query("SELECT doc_id, 'Document: ' || coalesce(document_key, '?') || CASE WHEN source <> '' THEN ' > Section: ' || source ELSE '' END AS header FROM documents")
def chunk_headers(spark, d):
    return _docs(spark, d).select("doc_id", C.context_header(F.coalesce("document_key", F.lit("?")), F.col("source")).alias("header"))


def _strategy(name: str, size: int, overlap: int):
    def run(spark, d):
        rows = C.chunks(_docs(spark, d).select("doc_id", "text"), "text", name, size, overlap)
        return rows.select("doc_id", F.col("idx").cast("long").alias("idx"), F.col("start").cast("long").alias("start"), "content", *(() if name in ("tokens", "sentence") else ("heading", "parent_idx", "is_parent")))

    return run


_BLANK = r"[\s\x0B\x1C-\x1F\x85\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_CHUNK_END = " SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::BIGINT AS idx, pos::BIGINT AS start, content FROM c"
# Words with running sums of their tokens; each chunk takes words up to the size and the next one goes back by the overlap.
_SQL["chunk_tokens"] = (
    f"WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '{_BLANK}'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL AND trim(text, {_WS}) <> ''), "
    "n AS (SELECT doc_id, w, list_transform(w, lambda x: greatest(1, (3 + ceil(length(x) / 4.0))::INTEGER // 2)) AS t FROM w WHERE len(w) > 0), "
    "s AS (SELECT doc_id, w, list_prepend(0::BIGINT, list_transform(range(1, len(t) + 1), lambda k: list_sum(t[1:k])::BIGINT)) AS s FROM n), "
    "c(doc_id, w, s, pos, stop, content) AS (SELECT doc_id, w, s, 0::BIGINT, e, array_to_string(w[1:e], ' ') FROM (SELECT *, greatest(1, len(list_filter(s, lambda x: x > 0 AND x <= 120)))::BIGINT AS e FROM s) "
    "UNION ALL SELECT doc_id, w, s, a, e, array_to_string(w[a + 1:e], ' ') FROM (SELECT *, greatest(a + 1, a + len(list_filter(s, lambda x: x > s[a + 1] AND x <= s[a + 1] + 120)))::BIGINT AS e FROM (SELECT doc_id, w, s, greatest(pos + 1, least(stop, stop - len(list_filter(s, lambda x: x < s[stop + 1] AND x >= s[stop + 1] - 20))))::BIGINT AS a FROM c) WHERE a < len(w)))" + _CHUNK_END
)
# Sentences, told by a mark that no text holds, with running sums of their lengths.
_SQL["chunk_sentence"] = (
    f"WITH RECURSIVE w AS (SELECT doc_id, list_transform(list_filter(string_split(regexp_replace(trim(text, {_WS}), '([.!?]){_BLANK}', '\\1' || chr(57344), 'g'), chr(57344)), lambda x: x <> ''), lambda x: trim(x, {_WS})) AS w FROM documents WHERE text IS NOT NULL AND trim(text, {_WS}) <> ''), "
    "s AS (SELECT doc_id, w, list_prepend(0::BIGINT, list_transform(range(1, len(w) + 1), lambda k: list_sum(list_transform(w[1:k], lambda x: length(x) + 1))::BIGINT)) AS s FROM w), "
    "c(doc_id, w, s, pos, stop, content) AS (SELECT doc_id, w, s, 0::BIGINT, e, array_to_string(w[1:e], ' ') FROM (SELECT *, greatest(1, len(list_filter(s, lambda x: x > 0 AND x <= 501)))::BIGINT AS e FROM s) "
    "UNION ALL SELECT doc_id, w, s, a, e, array_to_string(w[a + 1:e], ' ') FROM (SELECT *, greatest(a + 1, a + len(list_filter(s, lambda x: x > s[a + 1] AND x <= s[a + 1] + 501)))::BIGINT AS e FROM (SELECT doc_id, w, s, pos + greatest(1, stop - pos - 1) AS a FROM c) WHERE a < len(w)))" + _CHUNK_END
)
_QUERIES |= {"chunk_tokens": _strategy("tokens", 120, 20), "chunk_recursive": _strategy("recursive", 500, 100), "chunk_sentence": _strategy("sentence", 500, 1), "chunk_markdown": _strategy("markdown", 800, 100), "chunk_parent_child": _strategy("parent_child", 400, 50)}


@query("SELECT source AS tenant_id, count(DISTINCT text) AS embedded, count(*) AS texts FROM documents WHERE text IS NOT NULL GROUP BY 1")
def embedding_cache(spark, d):
    from .operators import embedding as EM

    rows = _docs(spark, d).where("text is not null").select(F.col("source").alias("tenant_id"), "text")
    chunks, fresh = EM.with_cache(rows, None, EM.EMBEDDERS.get("deterministic"), 8)
    made = fresh.join(chunks.select("key", "tenant_id").distinct(), "key").groupBy("tenant_id").agg(F.count("*").alias("embedded"))
    return made.join(chunks.where("v is not null").groupBy("tenant_id").agg(F.count("*").alias("texts")), "tenant_id")


@query(f"SELECT id, (metadata IS NOT NULL AND json_valid(metadata) AND json_extract_string(CASE WHEN json_valid(metadata) THEN metadata END, '$.source_type') IS NOT NULL) AS kept, tenant_id AS tenant FROM {_CHUNKS}")
def vector_payload(spark, d):
    readable = F.when(F.try_parse_json("metadata").isNotNull(), F.to_json(F.from_json("metadata", "map<string, string>")))
    p = ST.payload(readable, tenant_id=F.col("tenant_id"), is_parent=F.lit(False))
    return _chunks(spark, d).select("id", p.alias("p")).select("id", F.map_contains_key("p", "source_type").alias("kept"), F.element_at("p", "tenant_id").alias("tenant"))


# --- retrieval of text ----------------------------------------------------------------------------------------------------

_EMBED = "list_transform(range(0, 8), lambda i: ('0x' || substr(sha256('fake-embed-v1:' || i || ':' || {t}), 1, 8))::UBIGINT::DOUBLE / 4294967295.0::DOUBLE * 2 - 1)"


@query(f"SELECT doc_id, round(list_sum(v), 6) AS total, round(v[1], 6) AS first FROM (SELECT doc_id, {_EMBED.format(t='text')} AS v FROM documents WHERE text IS NOT NULL)")
def fake_embed(spark, d):
    rows = _docs(spark, d).where("text is not null").select("doc_id", V.hash_components(F.col("text")).alias("v"))
    return rows.select("doc_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(F.element_at("v", 1), 6).alias("first"))


def _corpus(spark, d):
    return _docs(spark, d).where("text is not null").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), V.embed(F.col("text")).alias("v"), F.col("source").alias("tenant_id"))


def _questions(spark, d):
    return table(spark, d, "eval_items").select(F.col("item_id").alias("qid"), F.col("query").alias("text"))


_NEAR = f"WITH d AS MATERIALIZED (SELECT doc_id AS id, text AS content, {_EMBED.format(t='text')} AS v FROM documents WHERE text IS NOT NULL), q AS MATERIALIZED (SELECT item_id AS qid, query AS text, {_EMBED.format(t='query')} AS q FROM eval_items), near AS MATERIALIZED (SELECT qid, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (SELECT qid, id, round(list_cosine_similarity(q, v), 6) AS score FROM q, d)) WHERE rank <= {{k}})"


@query(_NEAR.format(k=10) + " SELECT qid, id, score, rank FROM near")
def semantic_search_text(spark, d):
    return _long_rank(S.exact_topk(_corpus(spark, d), _questions(spark, d).withColumn("q", V.embed(F.col("text"))), 10))


_BM25 = r""", pool AS (SELECT near.qid, near.id, list_filter(regexp_split_to_array(lower(content), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS terms FROM near JOIN d USING (id)), sizes AS (SELECT qid, count(*) AS n, avg(len(terms)) AS mean_length FROM pool GROUP BY qid), asked AS (SELECT DISTINCT qid, term FROM (SELECT qid, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')) AS term FROM q)), tf AS (SELECT qid, id, term, length, count(*) AS tf FROM (SELECT qid, id, len(terms) AS length, unnest(terms) AS term FROM pool) JOIN asked USING (qid, term) GROUP BY ALL), df AS (SELECT qid, term, count(*) AS df FROM tf GROUP BY ALL), words AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (SELECT qid, id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * length / mean_length))), 6) AS score FROM tf JOIN df USING (qid, term) JOIN sizes USING (qid) GROUP BY qid, id) WHERE score > 0)"""


@query(_NEAR.format(k=40) + _BM25 + " SELECT qid, id, score, rank FROM words WHERE rank <= 10")
def bm25_topk(spark, d):
    near = S.exact_topk(_corpus(spark, d), _questions(spark, d).withColumn("q", V.embed(F.col("text"))), 40)
    return _long_rank(S.keyword_scores(near.join(_corpus(spark, d).select("id", "content"), "id"), _questions(spark, d), 10))


@query(_NEAR.format(k=40) + _BM25 + ", fused AS (SELECT qid, id, round(sum(1 / (60.0::DOUBLE + rank)), 9) AS score FROM (SELECT qid, id, rank FROM near UNION ALL SELECT qid, id, rank FROM words) GROUP BY qid, id) SELECT qid, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM fused) WHERE rank <= 10")
def rrf_hybrid(spark, d):
    near = S.exact_topk(_corpus(spark, d), _questions(spark, d).withColumn("q", V.embed(F.col("text"))), 40)
    words = S.keyword_scores(near.join(_corpus(spark, d).select("id", "content"), "id"), _questions(spark, d))
    return _long_rank(S.fuse([near, words], 10))


_OVERLAP = r", r AS (SELECT qid, id, content, CASE WHEN len(a) > 0 THEN round(len(list_intersect(a, b)) / len(a)::DOUBLE, 6) ELSE 0.0 END AS score FROM (SELECT near.qid, near.id, content, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(lower(content), '[^\p{L}\p{N}]+'), lambda w: w <> '')) AS b FROM near JOIN d USING (id) JOIN q USING (qid)))"


@query(_NEAR.format(k=40) + _OVERLAP + " SELECT qid, id, score, rank FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM r) WHERE rank <= 10")
def rerank_overlap(spark, d):
    near = S.exact_topk(_corpus(spark, d), _questions(spark, d).withColumn("q", V.embed(F.col("text"))), 40)
    return _long_rank(S.rerank_overlap(near.join(_corpus(spark, d).select("id", "content"), "id"), _questions(spark, d), 10))


_DEDUP = f", kept AS (SELECT qid, id, content, rank FROM near JOIN d USING (id) QUALIFY row_number() OVER (PARTITION BY qid, CASE WHEN trim(content, {_WS}) = '' THEN 'id:' || id ELSE sha256(trim(content, {_WS})) END ORDER BY rank, id) = 1)"


@query(_NEAR.format(k=40) + _DEDUP + " SELECT qid, id, rank FROM kept")
def result_dedup(spark, d):
    near = S.exact_topk(_corpus(spark, d), _questions(spark, d).withColumn("q", V.embed(F.col("text"))), 40)
    return S.without_repeats(near.join(_corpus(spark, d).select("id", "content"), "id")).select("qid", "id", F.col("rank").cast("long").alias("rank"))


_BUDGET = f", counted AS (SELECT qid, id, rank, {_TOKENS.replace('text', 'content')} AS tokens FROM near JOIN d USING (id)), spent AS (SELECT *, sum(tokens) OVER (PARTITION BY qid ORDER BY rank, id ROWS UNBOUNDED PRECEDING)::BIGINT AS spent, row_number() OVER (PARTITION BY qid ORDER BY rank, id) AS nth FROM counted) SELECT qid, id, rank, tokens, spent FROM spent WHERE spent <= 2000 OR nth = 1"


@query(_NEAR.format(k=40) + _BUDGET)
def token_budget(spark, d):
    near = S.exact_topk(_corpus(spark, d), _questions(spark, d).withColumn("q", V.embed(F.col("text"))), 40)
    out = S.within_budget(near.join(_corpus(spark, d).select("id", "content"), "id"), 2000)
    return out.select("qid", "id", F.col("rank").cast("long").alias("rank"), "tokens", "spent")


@query("WITH c AS (SELECT doc_id::VARCHAR AS id, source AS tenant_id, CASE WHEN doc_id % 2 = 1 THEN (doc_id - 1)::VARCHAR END AS parent, text FROM documents) SELECT a.id, sha256(coalesce(nullif(b.text, ''), a.text)) AS hash, b.id IS NOT NULL AS expanded FROM c a LEFT JOIN c b ON a.parent = b.id AND a.tenant_id = b.tenant_id")
def parent_expand(spark, d):
    rows = _docs(spark, d).select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("tenant_id"), F.when(F.col("doc_id") % 2 == 1, (F.col("doc_id") - 1).cast("string")).alias("parent_chunk_id"), F.col("text").alias("content"))
    parents = rows.withColumn("there", F.lit(True))
    out = S.with_parents(rows, parents)
    found = rows.select(F.col("id").alias("p"), F.col("tenant_id").alias("t"))
    both = out.join(found, (F.col("parent_chunk_id") == F.col("p")) & (F.col("tenant_id") == F.col("t")), "left")
    return both.select("id", T.text_hash(S.hit_text()).alias("hash"), F.col("p").isNotNull().alias("expanded"))


_WORDINGS = "WITH d AS MATERIALIZED (SELECT doc_id AS id, " + _EMBED.format(t="text") + " AS v FROM documents WHERE text IS NOT NULL), q AS MATERIALIZED (SELECT qid, variant, " + _EMBED.format(t="text") + " AS q FROM (SELECT item_id AS qid, 0 AS variant, query AS text FROM eval_items UNION ALL SELECT item_id, 1, lower(query) FROM eval_items)), near AS (SELECT qid, variant, id, row_number() OVER (PARTITION BY qid, variant ORDER BY round(list_cosine_similarity(q, v), 6) DESC, id) AS rank FROM q, d), fused AS (SELECT qid, id, round(sum(1 / (60.0::DOUBLE + rank)), 9) AS score FROM near WHERE rank <= 20 GROUP BY qid, id) SELECT qid, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM fused) WHERE rank <= 10"


@query(_WORDINGS)
def multi_query_rrf(spark, d):
    asked = _questions(spark, d).withColumn("variant", F.lit(0))
    both = asked.unionByName(asked.select("qid", F.lower("text").alias("text"), F.lit(1).alias("variant")))
    return _long_rank(Search(_corpus(spark, d), both).top_k(10).fetch(20).dedup(False).hits())


@query(_NEAR.format(k=40) + _BM25 + ", fused AS (SELECT qid, id, round(sum(1 / (60.0::DOUBLE + rank)), 9) AS score FROM (SELECT qid, id, rank FROM near UNION ALL SELECT qid, id, rank FROM words WHERE rank <= 40) GROUP BY qid, id), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS place FROM fused) WHERE place <= 40)" + _OVERLAP.replace("near", "f") + f", rr AS (SELECT qid, id, content, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM r), t AS (SELECT * FROM rr WHERE score >= 0.1), k AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY qid, CASE WHEN trim(content, {_WS}) = '' THEN 'id:' || id ELSE sha256(trim(content, {_WS})) END ORDER BY rank, id) = 1) SELECT qid, id, score, place AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS place FROM k) WHERE place <= 10")
def retrieve_pipeline_full(spark, d):
    search = Search(_corpus(spark, d), _questions(spark, d)).top_k(10).hybrid().rerank().threshold(0.1)
    return _long_rank(search.hits())


@query(_NEAR.format(k=20).replace("WITH d", "WITH RECURSIVE d") + _DEDUP + ", kept5 AS MATERIALIZED (SELECT qid, id, rank, v, q FROM kept JOIN (SELECT id, v FROM d) USING (id) JOIN q USING (qid)), " + _mmr_sql("kept5", 5, 0.5) + f", counted AS (SELECT qid, id, rank, {_TOKENS.replace('text', 'content')} AS tokens FROM chosen JOIN d USING (id)), spent AS (SELECT *, sum(tokens) OVER (PARTITION BY qid ORDER BY rank ROWS UNBOUNDED PRECEDING) AS spent, row_number() OVER (PARTITION BY qid ORDER BY rank) AS nth FROM counted) SELECT qid, id, rank FROM spent WHERE spent <= 1500 OR nth = 1")
def retrieve_pipeline_mmr(spark, d):
    return Search(_corpus(spark, d), _questions(spark, d)).top_k(5).mmr(0.5).context_budget(1500).hits().select("qid", "id", "rank")


@query(_NEAR.format(k=5) + f", counted AS (SELECT qid, id, rank, content, {_TOKENS.replace('text', 'content')} AS tokens FROM near JOIN d USING (id)), s AS (SELECT *, sum(tokens) OVER (PARTITION BY qid ORDER BY rank ROWS UNBOUNDED PRECEDING) AS spent, row_number() OVER (PARTITION BY qid ORDER BY rank) AS n FROM counted), b AS (SELECT qid, string_agg('[' || n || '] ' || content, chr(10) || chr(10) ORDER BY n) AS context, string_agg(id::VARCHAR, ',' ORDER BY n) AS cited FROM s WHERE spent <= 800 OR n = 1 GROUP BY qid), p AS (SELECT qid, cited, 'Context:' || chr(10) || context || chr(10) || chr(10) || 'Question: ' || text AS prompt FROM b JOIN q USING (qid)) SELECT qid, sha256(prompt) AS prompt_hash, 'ANSWER: ' || substr(trim(prompt, {_WS}), 1, 80) AS answer, cited FROM p")
def ask_answers(spark, d):
    out = ask(Search(_corpus(spark, d), _questions(spark, d)).top_k(5).dedup(False), 800)
    return out.select("qid", T.text_hash(F.col("prompt")).alias("prompt_hash"), "answer", F.array_join(F.transform("citations", lambda x: x.cast("string")), ",").alias("cited"))


# --- evaluation ------------------------------------------------------------------------------------------------------------

_CASES = f"{_PAIRS}, hits AS (SELECT qid, id, rank FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(list_cosine_similarity(q, v), 6) DESC, id) AS rank FROM pairs) WHERE rank <= 10), rel AS (SELECT DISTINCT qid, id FROM pairs WHERE qlabel = label), met AS (SELECT qid, count(DISTINCT id) AS found, min(rank) AS first FROM hits JOIN rel USING (qid, id) GROUP BY qid), cases AS (SELECT qid, coalesce(found, 0)::BIGINT AS found, round(coalesce(found, 0) / wanted::DOUBLE, 6) AS recall, round(coalesce(found, 0) / 10.0::DOUBLE, 6) AS precision, round(coalesce(1 / first::DOUBLE, 0.0), 6) AS reciprocal_rank FROM (SELECT qid, count(*) AS wanted FROM rel GROUP BY qid) LEFT JOIN met USING (qid))"


def _judged(spark, d):
    asked = _asked(spark, d)
    hits = S.exact_topk(_vectors(spark, d), asked, 10)
    relevant = asked.select("qid", "label").join(_vectors(spark, d).select("id", "label"), "label").select("qid", "id")
    return E.by_case(hits, relevant, 10)


@query(_CASES + " SELECT qid, found, recall, precision, reciprocal_rank FROM cases")
def eval_per_case(spark, d):
    return _judged(spark, d)


@query(_CASES + " SELECT count(*) AS cases, round(avg(CASE WHEN found > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS hit_rate, round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision, round(avg(reciprocal_rank), 6) AS mrr FROM cases")
def eval_metrics(spark, d):
    return E.summary(_judged(spark, d))


# --- administration ---------------------------------------------------------------------------------------------------------

_RECORDS = "(SELECT DISTINCT ON (id) * FROM rag_usage_records)"
_DOCUMENTS = "(SELECT DISTINCT ON (id) * FROM rag_documents)"


def _records(spark, d):
    return table(spark, d, "rag_usage_records").dropDuplicates(["id"])


def _documents(spark, d):
    return table(spark, d, "rag_documents").dropDuplicates(["id"])


@query(f"SELECT status, count(*) AS documents FROM {_DOCUMENTS} GROUP BY status")
def status_counts(spark, d):
    return ST.status_counts(_documents(spark, d))


@query(f"SELECT tenant_id, period, upper(currency) AS currency, sum(tokens)::BIGINT AS tokens, sum(cost)::DOUBLE AS cost, count(*) AS records FROM {_RECORDS} GROUP BY 1, 2, 3")
def usage_by_period(spark, d):
    return ST.usage(_records(spark, d), ["tenant_id", "period"]).withColumn("cost", F.col("cost").cast("double"))


@query(f"SELECT lower(operation) AS operation, upper(currency) AS currency, sum(tokens)::BIGINT AS tokens, sum(cost)::DOUBLE AS cost, count(*) AS records FROM {_RECORDS} GROUP BY 1, 2")
def usage_rollup(spark, d):
    return ST.usage(_records(spark, d).withColumn("operation", F.lower("operation")), ["operation"]).withColumn("cost", F.col("cost").cast("double"))


_SNAPSHOT = f"WITH a AS (SELECT tenant_id, count(*) AS documents, coalesce(sum(size), 0) AS bytes FROM {_DOCUMENTS} WHERE soft_deleted_at IS NULL GROUP BY 1), b AS (SELECT tenant_id, sum(tokens) AS tokens FROM {_RECORDS} GROUP BY 1), s AS (SELECT tenant_id, coalesce(documents, 0)::BIGINT AS documents, coalesce(bytes, 0)::BIGINT AS bytes, coalesce(tokens, 0)::BIGINT AS tokens FROM a FULL JOIN b USING (tenant_id))"


@query(_SNAPSHOT + " SELECT * FROM s")
def tenant_snapshot(spark, d):
    return ST.tenant_snapshot(_documents(spark, d), _records(spark, d))


@query(_SNAPSHOT + " SELECT tenant_id, concat_ws(',', CASE WHEN documents >= 30 THEN 'documents' END, CASE WHEN tokens >= 100000 THEN 'tokens' END) AS exceeded FROM s WHERE documents >= 30 OR tokens >= 100000")
def quota_violations(spark, d):
    none = spark.createDataFrame([], "tenant_id string, max_documents long, max_bytes long, max_tokens long")
    return ST.over_quota(tenant_snapshot(spark, d), none, {"documents": 30, "bytes": None, "tokens": 100000}).select("tenant_id", "exceeded")


@query(f"WITH c AS (SELECT id, json_extract_string(CASE WHEN json_valid(metadata) THEN metadata END, '$.document_id') AS document_id FROM {_CHUNKS}) SELECT id, document_id FROM c WHERE document_id IS NULL OR document_id NOT IN (SELECT id FROM rag_documents WHERE id IS NOT NULL)")
def reconcile_orphans(spark, d):
    owner = F.try_variant_get(F.try_parse_json("metadata"), "$.document_id", "string")
    return ST.orphan_vectors(_chunks(spark, d).select("id", owner.alias("document_id")), _documents(spark, d)).select("id", "document_id")


@query(f"WITH c AS (SELECT json_extract_string(CASE WHEN json_valid(metadata) THEN metadata END, '$.document_id') AS document_id FROM {_CHUNKS}) SELECT id AS chunk_id FROM {_DOCUMENTS} WHERE id NOT IN (SELECT document_id FROM c WHERE document_id IS NOT NULL)")
def reconcile_missing(spark, d):
    owner = F.try_variant_get(F.try_parse_json("metadata"), "$.document_id", "string")
    held = _chunks(spark, d).select(owner.alias("id")).where("id is not null")
    return ST.missing_vectors(_documents(spark, d).select(F.col("id").alias("chunk_id"), F.lit(False).alias("is_parent")), held).select("chunk_id")


def _actions(spark, d):
    return table(spark, d, "events").select(F.concat(F.lit("user-"), F.col("user_id") % 200).alias("tenant_id"), F.col("event_type").alias("action"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("created"), F.col("event_id").alias("id"), F.concat(F.lit("u"), F.col("user_id")).alias("actor"), F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("doc-"), F.col("event_id"))).alias("target"), F.concat(F.lit('{"n":'), F.col("event_id") % 10, F.lit("}")).alias("context"))


_AUDIT = """WITH RECURSIVE e AS MATERIALIZED (SELECT 'user-' || (user_id % 200) AS tenant_id, 'u' || user_id AS actor, event_type AS action, CASE WHEN event_id % 3 > 0 THEN 'doc-' || event_id END AS target, '{"n":' || (event_id % 10) || '}' AS context, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS created, event_id FROM events), n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY created, event_id) AS seq FROM e), c AS (SELECT tenant_id, seq, actor, action, target, context, created, NULL::VARCHAR AS hash_prev, sha256('|' || seq || '|' || tenant_id || '|' || actor || '|' || action || '|' || coalesce(target, '') || '|' || context || '|' || created) AS hash FROM n WHERE seq = 1 UNION ALL SELECT n.tenant_id, n.seq, n.actor, n.action, n.target, n.context, n.created, c.hash, sha256(c.hash || '|' || n.seq || '|' || n.tenant_id || '|' || n.actor || '|' || n.action || '|' || coalesce(n.target, '') || '|' || n.context || '|' || n.created) FROM c JOIN n ON n.tenant_id = c.tenant_id AND n.seq = c.seq + 1) SELECT tenant_id, seq::BIGINT AS seq, actor, action, target, context, created, hash_prev, hash FROM c"""


@query(_AUDIT)
def audit_chain(spark, d):
    return ST.audit_chain(_actions(spark, d))


@query("SELECT 'user-' || (user_id % 200) AS tenant_id, count(*) AS entries, (user_id % 200) % 7 <> 0 AS valid FROM events GROUP BY user_id % 200")
def audit_verify(spark, d):
    """The first entry of every seventh tenant names another actor than was hashed."""
    entries = ST.audit_chain(_actions(spark, d))
    number = F.regexp_extract("tenant_id", r"(\d+)$", 1).cast("int")
    changed = entries.withColumn("actor", F.when((number % 7 == 0) & (F.col("seq") == 1), F.lit("someone")).otherwise(F.col("actor")))
    return ST.audit_verify(changed, ST.anchors(entries))


@query("SELECT doc_id, sha256(text) AS hash, true AS changed, true AS guarded FROM documents WHERE text IS NOT NULL")
def encrypt_roundtrip(spark, d):
    key, other = ST.data_key(F.lit("master"), F.col("source"), F.lit(1)), ST.data_key(F.lit("master"), F.col("source"), F.lit(2))
    sealed = _docs(spark, d).where("text is not null").withColumn("key", key).withColumn("other", other).withColumn("sealed", ST.encrypt(F.col("text").cast("binary"), F.col("key")))
    return sealed.select("doc_id", T.text_hash(ST.decrypt(F.col("sealed"), F.col("key"))).alias("hash"), (F.col("sealed") != F.col("text")).alias("changed"), ST.decrypt(F.col("sealed"), F.col("other")).isNull().alias("guarded"))


@query(f"SELECT tenant_id, count(*) AS documents FROM {_DOCUMENTS} WHERE tenant_id IS NULL OR tenant_id NOT LIKE 'v%' GROUP BY 1")
def tenant_shred(spark, d):
    docs = _documents(spark, d)
    left = ST.shred({"documents": docs}, docs.where("tenant_id like 'v%'"))["documents"]
    return left.groupBy("tenant_id").agg(F.count("*").alias("documents"))


# --- rows as documents --------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey::BIGINT AS key, CASE WHEN c_custkey % 11 = 0 THEN 'forget' WHEN c_custkey % 7 = 0 THEN 'add' ELSE 'update' END AS change FROM customer WHERE (c_custkey % 11 = 0 AND c_custkey % 7 <> 0) OR (c_custkey % 11 <> 0 AND (c_custkey % 7 = 0 OR c_custkey % 5 = 0))")
def model_sync_diff(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("key"), F.col("c_name").alias("content"))
    now = rows.where("key % 11 <> 0")
    before = rows.where("key % 7 <> 0").select("key", T.text_hash(F.when(F.col("key") % 5 == 0, F.lit("old")).otherwise(F.col("content"))).alias("content_hash"))
    return ST.sync_changes(now, before)


# --- streams -------------------------------------------------------------------------------------------------------------------


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS records, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_usage_hourly(spark, d):
    from .streaming import incremental as I

    stream = I.file_stream(spark, f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = _once(spark, I.windowed(stream, "ts", "1 hour", ["event_type"], "value"), "complete")
    return rows.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "records", F.round("total", 4).alias("total"))


@query("SELECT sha256(text) AS content_hash, count(DISTINCT sha256(text)) AS kept FROM documents WHERE text IS NOT NULL GROUP BY 1")
def stream_dedup(spark, d):
    from .streaming import incremental as I

    stream = I.file_stream(spark, f"{d}/documents.parquet").where("text is not null")
    fresh = I.new_texts(stream.select("text", "ingested_at"), "text", "ingested_at", "3650 days")
    return _once(spark, fresh.select("content_hash"), "append").groupBy("content_hash").agg(F.count("*").alias("kept"))


def _once(spark: SparkSession, result: DataFrame, mode: str) -> DataFrame:
    """The stream's result over what is there now, written by one run into the shared folder and read back."""
    import uuid

    shared = shared_folder(spark)
    at = f"{shared}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        run = result.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
        run.awaitTermination()
        return spark.read.schema(result.schema).parquet(f"{at}/out")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    run = result.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    out = spark.read.parquet(f"{at}/out")
    last = out.agg(F.max("batch").alias("last"))
    return out.join(F.broadcast(last), out["batch"] == last["last"]).drop("batch", "last")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve_pipeline_full(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import catalogue_write  # noqa: F401 - registers its queries here

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import catalogue_write  # noqa: F401

    return dict(_SQL)
