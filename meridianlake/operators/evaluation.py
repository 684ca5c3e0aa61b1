"""Retrieval quality: hit rate, recall, precision and reciprocal rank at k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_case(hits: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """One row per case (qid): found, recall, precision (over k, however few hits there are) and reciprocal rank.

    hits: qid, id, rank and, where labels may name documents, document_id; relevant: qid, id of a chunk or document. A case without relevant ids has a recall of 0. Cases come from `relevant`.
    """
    wanted = relevant.select("qid", "id").distinct()
    top = hits.where(F.col("rank") <= k)
    named = top.select("qid", "id", "rank")
    if "document_id" in hits.columns:
        named = named.unionByName(top.select("qid", F.col("document_id").alias("id"), "rank"))
    met = named.join(wanted, ["qid", "id"], "left_semi").groupBy("qid").agg(F.countDistinct("id").alias("found"), F.min("rank").alias("first"))
    sizes = relevant.groupBy("qid").agg(F.countDistinct("id").alias("wanted"))
    got = F.coalesce("found", F.lit(0))
    return sizes.join(met, "qid", "left").select(
        "qid",
        got.cast("bigint").alias("found"),
        F.round(F.when(F.col("wanted") > 0, got / F.col("wanted")).otherwise(0.0), 6).alias("recall"),
        F.round(got / F.lit(float(k)), 6).alias("precision"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"),
    )


def summary(cases: DataFrame) -> DataFrame:
    return cases.agg(
        F.count("*").alias("cases"),
        F.round(F.avg(F.when(F.col("found") > 0, 1.0).otherwise(0.0)), 6).alias("hit_rate"),
        F.round(F.avg("recall"), 6).alias("recall"),
        F.round(F.avg("precision"), 6).alias("precision"),
        F.round(F.avg("reciprocal_rank"), 6).alias("mrr"),
    )
