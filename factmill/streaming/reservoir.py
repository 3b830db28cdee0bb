"""A sample of bounded size for each kind of a stream's rows, the same however the stream is cut into batches.

The sample are the rows whose keyed hashes are lowest, so that a batch only
has to be merged with the sample so far: a limit that Spark applies before
its shuffle.  Each batch commits the sample behind it and how many rows it saw.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.mixture import sample_per_kind
from .ledger import Ledger


def sample(spark: SparkSession, folder: str) -> DataFrame:
    """The sample behind the last committed batch; fails before the first one."""
    ledger = Ledger(spark, folder)
    last = ledger.entries().agg(F.max("batch")).first()[0]
    return ledger.rows().where(F.col("batch") == F.lit(last)).drop("batch")


def sample_stream(rows: DataFrame, kind: str, most: int, seed: int, id_column: str, folder: str) -> Ledger:
    """Take in what the stream ``rows`` has; run it again after a stop, or when there is more.

    Rows of a null kind are a kind of their own, and ids tell rows apart.
    """
    spark = rows.sparkSession
    ledger = Ledger(spark, folder)

    def commit(batch: DataFrame, number: int) -> None:
        if ledger.has(number):  # what it led to is no part of it
            return
        both = batch.withColumn("_new", F.lit(True))
        if number:
            both = both.unionByName(sample(spark, folder).withColumn("_new", F.lit(False)))
        ledger.write(both, number, lambda seen: sample_per_kind(seen, kind, most, seed, id_column).drop("_new"), {"seen": F.count_if("_new")})

    rows.writeStream.foreachBatch(commit).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return ledger
