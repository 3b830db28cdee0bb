"""Entity resolution: records with one key are merged, or set aside if they contradict.

Groups are made by (split, key).  Only training groups are merged; answers
that differ (beyond case and spacing) set the whole group aside, as do tables
or plans that differ.  Groups of one, by far the most, take the same
aggregate, so a plan has one shuffle by key and nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import union_boxes
from ..functions.text import answer_key
from ..operators.clusters import merge_by_clusters
from ..operators.elements import merge_groups
from ..session import cut
from .keyed import broadcast_if_small

#: Better sources first; what a user's own sources are called is theirs to say.
SOURCES = ("annotated", "annotated_extra", "grounded", "synthetic")


def source_rank(source: Column, sources: tuple[str, ...] = SOURCES) -> Column:
    """Smaller is better; unknown sources come last."""
    rank = F.lit(99)
    for i, name in reversed(list(enumerate(sources))):
        rank = F.when(source == name, F.lit(i)).otherwise(rank)
    return rank


def grouped(records: DataFrame, key: str = "key", sources: tuple[str, ...] = SOURCES) -> DataFrame:
    """One row per (split, key) with the merged record and what contradicts.

    ``records``: ``split``, the key, ``record_id``, ``source``, ``row``,
    ``answer``, ``table``, ``plan`` (canonical text) and ``boxes``.  Copies
    of boxes and ids are dropped before the shuffle; the merged row itself
    lists a group's ids, so it is as long as the group has ids.
    """
    order = F.struct(source_rank(F.col("source"), sources).alias("rank"), "record_id", "row")
    known = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct(order.alias("order"), F.col(c).alias("value"))))
    differ = lambda c: F.count_distinct(c) > 1
    return records.withColumn("_answer", answer_key(F.col("answer"))).groupBy("split", key).agg(
        F.count("*").alias("n"),
        F.min("row").alias("first_row"),
        F.min(F.struct(order.alias("order"), "record_id", "source")).alias("_primary"),
        known("answer")["value"].alias("answer"),
        known("table")["value"].alias("table"),
        known("plan")["value"].alias("plan"),
        union_boxes(F.flatten(F.collect_set("boxes"))).alias("boxes"),
        F.array_sort(F.collect_set("source")).alias("merged_from"),
        F.array_sort(F.collect_set("record_id")).alias("merged_record_ids"),
        F.coalesce(F.when(differ("_answer"), "answer"), F.when(differ("table"), "table"), F.when(differ("plan"), "plan")).alias("conflict"),
    ).withColumn("record_id", F.col("_primary.record_id")).withColumn("source", F.col("_primary.source")).drop("_primary")


def deduplicate(records: DataFrame, key: str = "key") -> DataFrame:
    """Merged training records without contradiction, and all records of other splits, in input order by ``first_row``."""
    train = grouped(records.where(F.col("split") == "train"), key).where(F.col("conflict").isNull())
    columns = ["split", key, "record_id", "source", "first_row", "answer", "table", "plan", "boxes", "merged_from", "merged_record_ids"]
    rest = records.where(F.col("split") != "train").withColumns({"first_row": F.col("row"), "merged_from": F.array("source"), "merged_record_ids": F.array("record_id")})
    return train.select(*columns).unionByName(rest.select(*columns))


def report(records: DataFrame, key: str = "key") -> DataFrame:
    """One row of counters.  Input = output + removed + set aside."""
    groups = grouped(records, key)
    train = F.col("split") == "train"
    bad = train & F.col("conflict").isNotNull()
    n = F.col("n")
    return groups.agg(
        F.sum("n").alias("input_rows"),
        F.count_if(n > 1).alias("duplicate_groups"),
        F.coalesce(F.sum(F.when(n > 1, n)), F.lit(0)).alias("duplicate_rows"),
        F.count_if(bad).alias("conflict_groups"),
        F.coalesce(F.sum(F.when(bad, n)), F.lit(0)).alias("quarantined_rows"),
        F.coalesce(F.sum(F.when(train & ~bad, n - 1)), F.lit(0)).alias("duplicates_removed"),
        F.coalesce(F.sum(F.when(bad, F.lit(0)).when(train, F.lit(1)).otherwise(n)), F.lit(0)).alias("output_rows"),
    )


def conflicts(records: DataFrame, key: str = "key") -> DataFrame:
    """Groups set aside: key, record ids and what contradicts."""
    return grouped(records.where(F.col("split") == "train"), key).where(F.col("conflict").isNotNull()).select(key, F.col("merged_record_ids").alias("record_ids"), F.col("conflict").alias("reason"))


def cross_split(records: DataFrame, key: str = "key") -> DataFrame:
    """Keys that stand in several splits: each pair of neighbours among a key's sorted splits."""
    splits = records.groupBy(key).agg(F.array_sort(F.collect_set("split")).alias("splits")).where(F.size("splits") > 1)
    pairs = F.zip_with(F.slice("splits", F.lit(1), F.size("splits") - 1), F.slice("splits", F.lit(2), F.size("splits") - 1), lambda a, b: F.struct(a.alias("split_a"), b.alias("split_b")))
    return splits.select(key, F.explode(pairs).alias("p")).select(key, "p.split_a", "p.split_b")


#: Records of one key that one task folds, at most; those of keys with more are folded by clusters.
MANY_RECORDS = 20_000


def merge_elements(records: DataFrame, key: str = "key", many: int = MANY_RECORDS) -> DataFrame:
    """One element list and remapped evidence for each (split, key) whose records carry elements.

    ``elements`` is JSON text of a list of objects, ``evidence`` an array of
    positions in it.  A group's records are folded in order of source, id and
    row: read as a stream by one task, which Spark sorts them for; records of a
    key that has more than ``many`` are taken apart into clusters of elements
    that can't touch each other, which many tasks fold or add up.
    """
    ranked = records.select("split", key, source_rank(F.col("source")).alias("rank"), "record_id", "row", "elements", "evidence")
    order = [F.col(c).asc_nulls_last() for c in ("split", key, "rank", "record_id", "row")]
    schema = f"split string, {key} string, elements string, evidence array<int>, conflict string"
    fold = lambda rows: rows.repartition("split", key).sortWithinPartitions(*order).mapInArrow(lambda batches: merge_groups(batches, key), schema)
    large = cut(ranked.groupBy("split", key).count().where(F.col("count") > max(many, 1)).select(F.col("split").alias("_split"), F.col(key).alias("_large")))
    if not large.take(1):
        return fold(ranked)
    large = broadcast_if_small(large)
    same = F.col("split").eqNullSafe(F.col("_split")) & F.col(key).eqNullSafe(F.col("_large"))
    taken_apart = merge_by_clusters(ranked.join(large, same, "left_semi").withColumnRenamed(key, "_key")).withColumnRenamed("_key", key)
    return fold(ranked.join(large, same, "left_anti")).unionByName(taken_apart)
