"""Parquet shards that are pinned by name, size and number of rows.

Pins are a table with a row for each file.  Only pinned files are opened;
what isn't as it was pinned is an error before any row is handed out.  A
row's index counts through all shards in the order of their names: the
shards' rows before it, and its place in its own file, so that no sort and no
window is needed.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.keyed import broadcast_if_small
from ..session import cut
from .files import write_jsonl

PINS = "name string, size long, rows long"


def _counted(rows: DataFrame) -> DataFrame:
    """Name, size and rows of each file; no column is read, the numbers stand in the files' footers."""
    return rows.select(F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_size").alias("size")).groupBy("name", "size").agg(F.count("*").alias("rows"))


def pin(spark: SparkSession, folder: str) -> DataFrame:
    """``name, size, rows`` of each Parquet file of a folder that has rows."""
    return _counted(spark.read.parquet(folder))


def write_pins(pins: DataFrame, path: str) -> int:
    """Pins as JSON lines; gives the number of shards."""
    return write_jsonl(pins, path)


def read_pins(spark: SparkSession, path: str) -> DataFrame:
    """Pins that ``write_pins`` wrote; a bad line fails."""
    return spark.read.schema(PINS).option("mode", "FAILFAST").json(path)


def _names(pins: DataFrame) -> list[str]:
    """Shards in order.  The driver lists all files of a scan, so their names fit there too."""
    names = [r["name"] for r in pins.select("name").orderBy("name").collect()]
    if not names:
        raise ValueError("no shard is pinned")
    if len(set(names)) < len(names):
        raise ValueError("a shard is pinned twice")
    return names


def _opened(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    try:
        return spark.read.parquet(*[f"{folder}/{name}" for name in names])
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"a pinned shard isn't there: {e.getMessageParameters().get('path')}") from e
        raise


def check(rows: DataFrame, pins: DataFrame) -> None:
    """Fail, naming shards, unless all pinned ones have their size and number of rows."""
    found = _counted(rows).select("name", F.col("size").alias("_size"), F.col("rows").alias("_rows"))
    wrong = pins.join(found, "name", "left").where(~(F.col("size").eqNullSafe(F.col("_size")) & F.col("rows").eqNullSafe(F.col("_rows"))))
    if bad := wrong.orderBy("name").limit(5).collect():
        raise ValueError("shards aren't as they were pinned: " + ", ".join(f"{r['name']} ({r['size']} bytes, {r['rows']} rows; now {r['_size']}, {r['_rows']})" for r in bad))


def _indexed(rows: DataFrame, pins: DataFrame) -> DataFrame:
    """``rows`` with ``source_row_index``."""
    # one row a shard, in one task
    before = Window.orderBy("name").rowsBetween(Window.unboundedPreceding, -1)
    starts = broadcast_if_small(cut(pins.select(F.col("name").alias("_shard"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("_start"))), 256)
    placed = rows.select("*", F.col("_metadata.file_name").alias("_shard"), F.col("_metadata.row_index").alias("_row")).join(starts, "_shard")
    return placed.withColumn("source_row_index", F.col("_start") + F.col("_row")).drop("_shard", "_row", "_start")


def read_pinned(spark: SparkSession, folder: str, pins: DataFrame) -> DataFrame:
    """Rows of the pinned shards with ``source_row_index`` (from 0); other files of the folder aren't opened."""
    rows = _opened(spark, folder, _names(pins))
    check(rows, pins)
    return _indexed(rows, pins)


def stream_pinned(spark: SparkSession, folder: str, pins: DataFrame, shards_per_batch: int = 100) -> DataFrame:
    """The same as a stream of whole shards, some in each micro-batch."""
    names = _names(pins)
    rows = _opened(spark, folder, names)
    check(rows, pins)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", shards_per_batch).option("pathGlobFilter", "{" + ",".join(names) + "}").parquet(folder)
    return _indexed(stream, pins)
