"""Writing: generations of a table, of which readers see the last complete one, partitioned for the filters of searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, a folder that all executors share. A session on a cluster that names none is refused; on one machine a temporary one will do."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        named = tempfile.mkdtemp(prefix="shared-")  # one machine, as in tests
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def settled(rows: DataFrame) -> DataFrame:
    """rows written once, to go on from the written copy: a reliable checkpoint in the shared folder, where a plan is used more than once."""
    sc = rows.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(rows.sparkSession))
    return rows.checkpoint(eager=True)


def write_generation(rows: DataFrame, path: str, number: int, partition_by: tuple[str, ...] = (), bucket_rows: int | None = None) -> None:
    """A whole new generation beside the old ones. It counts from the moment its files are committed; a failed write leaves none."""
    writer = rows.write.mode("overwrite")
    if bucket_rows:
        writer = writer.option("maxRecordsPerFile", bucket_rows)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{path}/generation={number:08d}")


def generations(spark: SparkSession, path: str) -> list[str]:
    """Folders of complete generations, oldest first. Names only; their number is that of writes kept."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found = [s.getPath() for s in fs.listStatus(root) if s.isDirectory() and s.getPath().getName().startswith("generation=")]
    return sorted(p.toString() for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def read_current(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(generations(spark, path)[-1])


def replace_documents(spark: SparkSession, path: str, changed: DataFrame, key: str = "document_id") -> DataFrame:
    """Current rows with all rows of the changed documents replaced: the input of the next generation."""
    if not generations(spark, path):
        return changed
    held = read_current(spark, path)
    return held.join(changed.select(key).distinct(), key, "left_anti").unionByName(changed, allowMissingColumns=True)


def drop_older(spark: SparkSession, path: str, keep: int = 2) -> None:
    for old in generations(spark, path)[: -max(1, keep)]:
        p = spark._jvm.org.apache.hadoop.fs.Path(old)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def clustered(rows: DataFrame, keys: list[str], partitions: int) -> DataFrame:
    """Rows laid out by key ranges, so that filters on the keys skip files; hot keys spread over several partitions."""
    return rows.repartitionByRange(partitions, *keys, F.xxhash64(*rows.columns[:1]).alias("_salt")).sortWithinPartitions(*keys)
