"""Queries of the training-data operators, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import duplicates, language, leakage, neighbours, packing, personal, quality, scans
from .common import read


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return language.detect_languages(read(spark, d, "rag_pgvectors")).where("is_case").select("id", "seg", "lang")


def p1_segments(spark: SparkSession, d: str) -> DataFrame:
    return language.detect_languages(read(spark, d, "rag_pgvectors"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.found(read(spark, d, "rag_pgvectors"))


def p2_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scans.repaired(read(spark, d, "rag_pgvectors"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.found(read(spark, d, "rag_pgvectors"), read(spark, d, "rag_vector_namespaces"), read(spark, d, "vector_probes"))


def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    vectors = read(spark, d, "rag_pgvectors")
    return neighbours.nearest(vectors, read(spark, d, "rag_vector_namespaces"), neighbours.every_hundredth(vectors))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return personal.found(read(spark, d, "rag_pgvectors"))


def p4_sanitised(spark: SparkSession, d: str) -> DataFrame:
    return personal.sanitise(read(spark, d, "rag_pgvectors"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.found(read(spark, d, "rag_pgvectors"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.groups(read(spark, d, "rag_pgvectors"))


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(read(spark, d, "documents"), read(spark, d, "context_windows"))


def p6_used_space(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(read(spark, d, "documents"), read(spark, d, "context_windows"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(read(spark, d, "documents"), read(spark, d, "eval_items")).where("kind = 'passage'").select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(read(spark, d, "documents"), read(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.found(read(spark, d, "documents"))


def p8_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.quality(read(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit()}


# Similar pairs by all runs of three words that two texts share. Words are runs of letters and digits, as in TERM of the core.
_WORDS = r"list_filter(regexp_split_to_array(lower(content), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_SIMILAR = (
    "w AS MATERIALIZED (SELECT id, {words} AS w FROM (SELECT DISTINCT id, content FROM rag_pgvectors WHERE id IS NOT NULL AND content IS NOT NULL)), "
    "t AS MATERIALIZED (SELECT id, w, min(id) OVER (PARTITION BY array_to_string(w, ' ')) AS class FROM w WHERE len(w) >= {least}), "
    "r AS MATERIALIZED (SELECT id, unnest(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS run FROM t WHERE id = class), "
    "n AS MATERIALIZED (SELECT id, count(*) AS n FROM r GROUP BY id), "
    "p AS MATERIALIZED (SELECT a.id AS a, b.id AS b, count(*) AS shared FROM r a JOIN r b ON a.run = b.run AND a.id < b.id GROUP BY 1, 2), "
    "s AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE shared / (x.n + y.n - shared)::DOUBLE >= 0.6 - 1e-9)"
)


def oracle_sql() -> dict[str, str]:
    pairs, groups = (_SIMILAR.replace("{words}", _WORDS).replace("{least}", str(n)) for n in (30, 3))
    return {
        # No text of the small tables has more than 32 copies: classes are written out in full.
        "p5_found": f"WITH {pairs} SELECT least(x.id, y.id) AS id_a, greatest(x.id, y.id) AS id_b FROM s JOIN t x ON x.class = s.a JOIN t y ON y.class = s.b UNION SELECT x.id, y.id FROM t x JOIN t y ON x.class = y.class AND x.id < y.id",
        "p5_groups": f"WITH RECURSIVE {groups}, e AS MATERIALIZED (SELECT a, b FROM s UNION ALL SELECT b, a FROM s), reach AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a), g AS (SELECT a, least(a, min(b)) AS g FROM reach GROUP BY a), l AS (SELECT a, count(*) AS links FROM e GROUP BY a) SELECT t.id, class, coalesce(g.g, class) AS \"group\", coalesce(links, 0)::BIGINT AS links FROM t LEFT JOIN g ON g.a = class LEFT JOIN l ON l.a = class",
    }
