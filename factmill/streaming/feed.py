"""An endless feed of records, in an order of its own each epoch, that is taken up where it ended.

The stream itself only counts: Spark's own source of consecutive numbers,
whose offsets its checkpoint keeps.  A number is an epoch and a position in
it, and a keyed bijection on row numbers says which row stands at a position,
so that no epoch is ever sorted or held.  Rows are fetched by their number and
committed batch by batch with the counts of usable and of refused ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.keyed import BROADCAST_BYTES
from .ledger import Ledger

#: Rounds of the bijection; more mix better.
ROUNDS = 32
_PRIME = (1 << 31) - 1


def round_keys(n: int, seed: int, epoch: int, rounds: int = ROUNDS) -> list[tuple[int, int, int]]:
    """For each round: the pivot below ``n``, and two numbers that choose who is swapped."""
    out = []
    for r in range(rounds):
        h = hashlib.sha256(f"{seed}|{epoch}|{r}".encode()).hexdigest()
        out.append((int(h[:15], 16) % n, int(h[15:22], 16), int(h[22:29], 16)))
    return out


def row_at(position: Column, epoch: Column, n: int, seed: int, epochs: Iterable[int], rounds: int = ROUNDS) -> Column:
    """The row at a position of one of ``epochs``: a bijection of 0 to ``n - 1`` for each.

    Swap-or-not: in each round a number and its mirror image about the pivot
    change places, or don't, by a bit that both of them share.
    """
    number = lambda x: F.lit(x).cast("long")
    keys = F.create_map(*[c for e in epochs for c in (number(e), F.array(*[F.struct(number(p).alias("pivot"), number(a).alias("a"), number(b).alias("b")) for p, a, b in round_keys(n, seed, e, rounds)]))])

    def swap(x: Column, key: Column) -> Column:
        mirror = (key["pivot"] + number(n) - x) % number(n)
        chosen = (F.greatest(x, mirror) + key["a"]) % _PRIME
        bit = F.shiftright((chosen * chosen + key["b"]) % _PRIME, 10).bitwiseAND(number(1))
        return F.when(bit == 1, mirror).otherwise(x)

    return F.aggregate(F.element_at(keys, epoch), position.cast("long"), swap)


def _places(batch: DataFrame, n: int, seed: int, shuffle: bool) -> DataFrame:
    """``place, epoch, position, row`` of a micro-batch of consecutive numbers."""
    placed = batch.select(F.col("value").alias("place"), F.floor(F.col("value") / n).cast("long").alias("epoch"), (F.col("value") % n).alias("position"))
    if not shuffle:
        return placed.withColumn("row", F.col("position"))
    ends = placed.agg(F.min("epoch"), F.max("epoch")).first()
    return placed.withColumn("row", row_at(F.col("position"), F.col("epoch"), n, seed, range(ends[0], ends[1] + 1)))


def run(records: DataFrame, usable: Column, folder: str, batch_rows: int, until: int, seed: int, shuffle: bool = True) -> Ledger:
    """Feed until ``until`` batches are committed in all; another run goes on behind the last one.

    ``records`` have a dense ``row`` from 0 on.  Those that aren't ``usable``
    (null counts as not) are refused and counted.  ``Ledger.rows`` gives
    records with ``place`` (of all that was fed), ``epoch`` and ``position``;
    one batch more may be there already when a run ends.  Each batch reads the
    records once, and its places are broadcast below a size: at scale, a
    batch should be a good part of an epoch.  An empty table is an error, as
    are records, a seed or a size of batches other than a folder was begun with.
    """
    spark = records.sparkSession
    n = records.count()
    if not n:
        raise ValueError("nothing to feed")
    setting = {"records": n, "seed": seed, "batch_rows": batch_rows, "shuffle": int(shuffle)}
    ledger = Ledger(spark, folder)
    begun = ledger.entries().orderBy("batch").first()
    if begun and {k: begun["counts"][k] for k in setting} != setting:
        raise ValueError(f"the feed was begun with { {k: begun['counts'][k] for k in setting} }, not {setting}")
    flagged = records.withColumn("_usable", F.coalesce(usable, F.lit(False)))

    def commit(batch: DataFrame, number: int) -> None:
        places = _places(batch, n, seed, shuffle)
        places = F.broadcast(places) if batch_rows * 48 <= BROADCAST_BYTES else places.hint("shuffle_hash")
        counts = {"delivered": F.count_if("_usable"), "refused": F.count_if(~F.col("_usable"))}
        ledger.write(flagged.join(places, "row"), number, lambda rows: rows.where("_usable").drop("_usable"), counts, lambda found: setting)

    source = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", batch_rows).option("numPartitions", spark.sparkContext.defaultParallelism).option("startTimestamp", 0).load()
    query = source.writeStream.foreachBatch(commit).option("checkpointLocation", f"{folder}/checkpoint").start()
    try:
        while not ledger.has(until - 1):
            query.awaitTermination(0.1)  # raises what ended it
    finally:
        query.stop()
    return ledger


def state(spark: SparkSession, folder: str) -> dict[str, int]:
    """Where the feed stands behind its last committed batch: ``epoch, position, refused``."""
    entries = Ledger(spark, folder).entries()
    at = entries.agg(F.max("batch").alias("batch"), F.max(F.col("counts")["records"]).alias("n"), F.max(F.col("counts")["batch_rows"]).alias("size"), F.sum(F.col("counts")["refused"]).alias("refused")).first()
    if at["batch"] is None:
        return {"epoch": 0, "position": 0, "refused": 0}
    place = (at["batch"] + 1) * at["size"]
    return {"epoch": place // at["n"], "position": place % at["n"], "refused": at["refused"]}


def training_batches(spark: SparkSession, folder: str, size: int) -> DataFrame:
    """What was fed with ``number``: usable records in their order, ``size`` to a number.

    Batches are numbered apart from what their ledger says was delivered before.
    """
    ledger = Ledger(spark, folder)
    # one row a batch, in one task
    before = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)
    starts = ledger.entries().select("batch", F.coalesce(F.sum(F.col("counts")["delivered"]).over(before), F.lit(0)).alias("_start"))
    nth = F.row_number().over(Window.partitionBy("batch").orderBy("place"))
    return ledger.rows().join(starts, "batch").withColumn("number", F.floor((F.col("_start") + nth - 1) / size)).drop("_start")
