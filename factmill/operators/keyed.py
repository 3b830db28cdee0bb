"""Joins and set operations by key, with a defined winner where keys repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Sides below this many bytes are broadcast; the size is that of counted rows.
BROADCAST_BYTES = 16 << 20


def broadcast_if_small(df: DataFrame, row_bytes: int = 64) -> DataFrame:
    """A broadcast hint, if the counted rows stay below the bound; beyond it a plain join."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def first_per_key(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in a total order.  For the last one, order descending."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_nth = 1").drop("_nth")


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with one key, the last one in ``order``."""
    return first_per_key(df, keys, [F.desc(c) for c in order])


def later_wins_union(tables: list[DataFrame], keys: list[str], order: list[str]) -> DataFrame:
    """All rows of all tables, later tables replacing earlier ones by key."""
    stacked = tables[0].withColumn("_table", F.lit(0))
    for i, t in enumerate(tables[1:], 1):
        stacked = stacked.unionByName(t.withColumn("_table", F.lit(i)))
    return last_wins(stacked, keys, ["_table", *order]).drop("_table")


def attach_elements(records: DataFrame, aligned: DataFrame, order: str) -> DataFrame:
    """Records with their aligned elements; the record's own table wins if it isn't empty."""
    own = last_wins(aligned, ["record_id"], [order]).select("record_id", F.col("elements").alias("_elements"), F.col("table").alias("_table"))
    joined = records.join(own, "record_id")
    table = F.coalesce(F.when(F.coalesce(F.size("table.rows"), F.lit(0)) > 0, F.col("table")), F.col("_table"), F.col("table"))
    return joined.withColumn("elements", F.col("_elements")).withColumn("table", table).drop("_elements", "_table")


def attach_plans(records: DataFrame, plans: DataFrame | None, order: str = "line") -> DataFrame:
    """Records with the last plan of their id, where there is one; no plans leave them as they are."""
    if plans is None:
        return records
    own = last_wins(plans, ["record_id"], [order]).select("record_id", F.col("plan").alias("_plan"), F.lit(True).alias("_has"))
    joined = records.join(own, "record_id", "left")
    return joined.withColumn("plan", F.when(F.col("_has"), F.col("_plan")).otherwise(F.col("plan"))).drop("_plan", "_has")


def without_held_out(records: DataFrame, held_out: DataFrame, key: str) -> DataFrame:
    """Records whose key isn't among the held-out ones; a null key stays."""
    return records.join(held_out.select(key).distinct(), key, "left_anti")


def held_out_hashes(records: DataFrame, splits: list[str], key: str) -> DataFrame:
    """Distinct keys of the named splits."""
    return records.where(F.col("split").isin(*splits)).select(key).distinct()


def slice_in_order(records: DataFrame, ids: DataFrame) -> DataFrame:
    """The records of a list ``position, record_id``, with their positions.

    An id without a record comes back with a null ``_found``; see ``require_all``.
    """
    return ids.join(records.withColumn("_found", F.lit(True)), "record_id", "left")


def require_all(sliced: DataFrame) -> DataFrame:
    """The slice without its flag, failing where an id has no record."""
    return sliced.withColumn("position", F.when(F.col("_found"), F.col("position")).otherwise(F.raise_error(F.concat(F.lit("no record "), "record_id")).cast("int"))).drop("_found")


def zip_by_position(left: DataFrame, right: DataFrame, order_left: str, order_right: str) -> DataFrame:
    """Rows paired by their place in either order.

    Places come from range partitions and prefix sums of their sizes, so that
    no task sees all rows.
    """
    return numbered(left, order_left).join(numbered(right, order_right), "_place").drop("_place")


def numbered(df: DataFrame, order: str, start: int = 0) -> DataFrame:
    """A dense ``_place`` in the order of a column, without one window over all rows.

    Equal values are ordered, and dealt out, by a hash of the whole row, so
    that places are the same in every run and a very common value is many
    tasks' work.
    """
    tie = F.xxhash64(*df.columns)
    ranged = df.repartitionByRange(df.sparkSession.sparkContext.defaultParallelism, order, tie).sortWithinPartitions(order, tie)
    # both uses below must see the same partitions
    placed = cut(ranged.withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    local = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("_place", F.col("_before") + local + start).drop("_part", "_id", "_before")
