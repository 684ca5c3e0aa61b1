"""Incremental ingest and usage with Structured Streaming over files: exactly once per file, state bounded by watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def file_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """New Parquet files in a folder (or of a name or pattern in one), with the schema of those that are there."""
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    if root.getFileSystem(spark._jsc.hadoopConfiguration()).isDirectory(root):
        return stream.parquet(path)
    folder, _, name = path.rpartition("/")
    return stream.option("pathGlobFilter", name).parquet(folder)


def first_deliveries(stream: DataFrame, keys: list[str], time: str, late: str = "7 days") -> DataFrame:
    """Rows without those delivered again within the watermark; state older than it is dropped."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def new_texts(stream: DataFrame, text: str, time: str, late: str = "7 days") -> DataFrame:
    return first_deliveries(stream.withColumn("content_hash", T.text_hash(F.col(text))), ["content_hash"], time, late)


def windowed(stream: DataFrame, time: str, width: str, keys: list[str], value: str, late: str = "1 day") -> DataFrame:
    """Count and sum of a value by window and keys; windows close behind the watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("records"), F.sum(value).alias("total"))


def run_once(result: DataFrame, name: str, checkpoint: str, mode: str = "append"):
    """Process what is there into an in-memory table and stop: for tests and small jobs."""
    query = result.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return result.sparkSession.table(name)


def upsert_into(path: str, keys: list[str], newest: str):
    """foreachBatch writer of versions: each batch becomes a folder of its own number, so a repeated batch overwrites itself."""
    from ..operators.store import latest

    def write(batch: DataFrame, number: int) -> None:
        latest(batch, keys, [F.desc(newest)]).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def current(spark: SparkSession, path: str, keys: list[str], newest: str) -> DataFrame:
    from ..operators.store import latest

    return latest(spark.read.parquet(path), keys, [F.desc(newest), F.desc("batch")]).drop("batch")
