"""Structured Streaming: deduplication, windows and counts over a growing table.

All run with ``availableNow``: what is there is processed once, and the
checkpoint remembers it, so that a second run takes up where the first ended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder as they come; a single file's path is its folder and a pattern."""
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if name.endswith(".parquet") and not _is_folder(spark, path):
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(at).isDirectory()


def windowed_counts(events: DataFrame, time: str, kind: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts and sums per window and kind; rows later than the watermark are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def distinct_within(events: DataFrame, keys: list[str], time: str, late: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def run_once(rows: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there into Parquet, exactly once over all runs."""
    query = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()


def counts_once(rows: DataFrame, keys: list[str], out: str, checkpoint: str) -> None:
    """Total counts per key, replaced as a whole by each batch: running a batch again changes nothing."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"))

    def replace(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    counts.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
