"""What a stream has committed, batch by batch.

A micro-batch writes its rows to a folder of its own and then one entry with
its counts.  Only batches with an entry count: a batch that was stopped before
its entry is written again as a whole, one that was stopped behind it is
passed over.  So rows and counts are committed together, once, however often a
run is stopped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.keyed import broadcast_if_small

_ENTRY = "counts map<string,bigint>, batch long"


class Ledger:
    """Entries of one folder, an entry a file: it is there as a whole or not at all."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _there(self, path: str) -> bool:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(target)

    def entries(self) -> DataFrame:
        """``batch, counts`` of all committed batches."""
        if not self._there(f"{self.folder}/ledger"):
            return self.spark.createDataFrame([], _ENTRY).select("batch", "counts")
        return self.spark.read.schema(_ENTRY).json(f"{self.folder}/ledger").select("batch", "counts")

    def clear(self) -> None:
        """Forget all batches: nothing is committed any more."""
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/ledger")
        target.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)

    def has(self, batch: int) -> bool:
        return self._there(f"{self.folder}/ledger/batch={batch}/_SUCCESS")

    def add(self, batch: int, counts: dict[str, int]) -> None:
        entry = F.create_map(*[F.lit(x).cast("string" if i % 2 == 0 else "long") for i, x in enumerate(y for kv in counts.items() for y in kv)])
        self.spark.range(1).select(entry.alias("counts")).coalesce(1).write.mode("overwrite").json(f"{self.folder}/ledger/batch={batch}")

    def totals(self) -> DataFrame:
        """``name, n``: counts of all committed batches."""
        return self.entries().select(F.explode("counts").alias("name", "n")).groupBy("name").agg(F.sum("n").alias("n"))

    def rows(self) -> DataFrame:
        """Rows of committed batches, with ``batch``; fails before the first one."""
        batches = broadcast_if_small(self.entries().select(F.col("batch").alias("_batch")), 16)
        written = self.spark.read.parquet(f"{self.folder}/rows").withColumn("batch", F.col("batch").cast("long"))
        return written.join(batches, F.col("batch") == F.col("_batch"), "left_semi")

    def write(self, rows: DataFrame, batch: int, keep: Callable[[DataFrame], DataFrame], counts: dict[str, Column], more: Callable[[dict], dict] | None = None) -> None:
        """Commit a batch unless it is: what ``keep`` makes of the rows, and ``counts`` (aggregates) of all of them, seen while those are written.

        ``more`` makes further counts of these.
        """
        if self.has(batch):
            return
        seen = Observation()
        keep(rows.observe(seen, *[c.alias(name) for name, c in counts.items()])).write.mode("overwrite").parquet(f"{self.folder}/rows/batch={batch}")
        found = {name: int(n or 0) for name, n in seen.get.items()}
        self.add(batch, found | (more(found) if more else {}))
