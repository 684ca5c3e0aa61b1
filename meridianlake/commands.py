"""Administration from the command line: python -m meridianlake.commands COMMAND --tables FOLDER. The exit code tells the outcome.

Tables are Parquet files or folders FOLDER/NAME.parquet; commands that change a table write FOLDER/NAME.parquet.next beside it
and leave the swap to the caller, so that a failed run changes nothing.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import embedding as EM
from .operators import evaluation as E
from .operators import security as SEC
from .operators import store as ST

OK, FAILED, USAGE = 0, 1, 2


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def next(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}.parquet.next")


def show(rows: DataFrame, most: int = 1000) -> None:
    """Prints the first rows of a report; reports have a row per status or tenant."""
    print("\t".join(rows.columns))
    for r in rows.limit(most).collect():
        print("\t".join("" if x is None else str(x) for x in r))


def status(t: Tables, a) -> int:
    show(ST.status_counts(t("rag_documents").dropDuplicates(["id"])).orderBy("status"))
    return OK


def tenant(t: Tables, a) -> int:
    rows = ST.tenant_snapshot(t("rag_documents").dropDuplicates(["id"]), t("rag_usage_records").dropDuplicates(["id"])).where(F.col("tenant_id") == a.tenant)
    if rows.isEmpty():
        print(f"no tenant {a.tenant}")
        return FAILED
    show(rows)
    return OK


def reconcile(t: Tables, a) -> int:
    """Failure if a document has no chunk or a chunk's document isn't there."""
    owner = F.try_variant_get(F.try_parse_json("metadata"), "$.document_id", "string")
    docs = t("rag_documents").dropDuplicates(["id"])
    chunks = t("rag_pgvectors").select("id", "tenant_id", owner.alias("document_id")).dropDuplicates(["id"])
    if a.tenant:
        docs, chunks = docs.where(F.col("tenant_id") == a.tenant), chunks.where(F.col("tenant_id") == a.tenant)
    lost = ST.orphan_vectors(chunks, docs).count()
    bare = docs.join(chunks.select(F.col("document_id").alias("id")), "id", "left_anti").count()
    print(f"orphan vectors\t{lost}\ndocuments without vectors\t{bare}")
    return OK if lost == bare == 0 else FAILED


def evaluate(t: Tables, a) -> int:
    """Failure if the recall is below the gate. Tables: hits (qid, id, rank), relevant (qid, id)."""
    rows = E.summary(E.by_case(t("hits"), t("relevant"), a.k))
    show(rows)
    recall = rows.first()["recall"]
    return OK if recall is not None and recall >= a.least_recall else FAILED


def clear_cache(t: Tables, a) -> int:
    t.next("embedding_cache", EM.clear_cache(t("embedding_cache"), a.tenant))
    return OK


def rotate(t: Tables, a) -> int:
    """A new version of the tenant's key; its payloads' keys are wrapped again. Failure if some can't be opened."""
    keys = SEC.Keys(SEC.FileStore(t.spark, a.keys, a.master))
    if not keys.exists(a.tenant):
        print(f"no key of {a.tenant}")
        return FAILED
    number = keys.rotate(a.tenant)
    rows = t("payloads")
    good, failed = SEC.rewrap(rows.where(F.col("tenant_id") == a.tenant), keys.table(t.spark))
    t.next("payloads", rows.where(~F.col("tenant_id").eqNullSafe(F.lit(a.tenant))).unionByName(good).unionByName(failed))
    n = failed.count()
    print(f"version\t{number}\nfailed\t{n}")
    return OK if n == 0 else FAILED


def shred(t: Tables, a) -> int:
    if not a.yes:
        print("shredding can't be undone: repeat with --yes")
        return USAGE
    keys = SEC.Keys(SEC.FileStore(t.spark, a.keys, a.master)) if a.keys else None
    named = t.spark.createDataFrame([(a.tenant,)], "tenant_id string")
    for name, rows in SEC.shred_tenants({n: t(n) for n in ("rag_documents", "rag_pgvectors", "rag_usage_records")}, named, keys, a.reason).items():
        t.next(name, rows)
    return OK


COMMANDS = {"status": status, "tenant": tenant, "reconcile": reconcile, "evaluate": evaluate, "clear-cache": clear_cache, "rotate": rotate, "shred": shred}


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="meridianlake")
    p.add_argument("command", choices=sorted(COMMANDS))
    p.add_argument("--tables", required=True)
    p.add_argument("--tenant")
    p.add_argument("--keys")
    p.add_argument("--master")
    p.add_argument("--reason")
    p.add_argument("--yes", action="store_true")
    p.add_argument("--k", type=int, default=5)
    p.add_argument("--least-recall", type=float, default=0.0)
    try:
        a = p.parse_args(argv)
    except SystemExit as e:
        return USAGE if e.code else OK
    if a.command in ("tenant", "rotate", "shred") and not a.tenant or a.command == "rotate" and not a.keys:
        print(f"{a.command} needs --tenant" + (" and --keys" if a.command == "rotate" else ""))
        return USAGE
    return COMMANDS[a.command](Tables(spark or SparkSession.builder.getOrCreate(), a.tables), a)


if __name__ == "__main__":
    sys.exit(main())
