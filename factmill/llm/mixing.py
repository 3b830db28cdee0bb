"""Mixing sources to target weights, with DataFrame operations only.

Each document gets a hash-random key.  Within a source, documents are ordered
by that key; the running sum of their sizes decides how often each is taken:
whole epochs first, then a prefix of the order up to the source's exact
budget.  The order of a source is cut into key ranges, so that a source with a
third of all rows is summed by many tasks: sums per range, prefix sums of
these few, then running sums inside each range.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, free_name, small_or_not

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
_KEY_SPACE = float(1 << 60)


def count_words(text: str) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+`` in a text column, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def random_key(id_column: str, seed: int) -> Column:
    """60 bits of the md5 of seed and id: the same in any engine and in any run."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most_epochs: float = 2.0) -> DataFrame:
    """Targets of sources from their sizes (``source, source_size``).

    Sources in code point order, null last, take the weights in turn and share
    ``share`` times all words.  A target stops at ``most_epochs`` times its
    source's size and the excess is shared again by weight.  The fixed point
    is found at once: sources fill up in the order of limit over weight, so
    running sums in that order tell which are full when it settles.
    One row per source is all that this window sees, in one task: sources are
    names of collections, of which there may be millions, not one per document.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    limited = sizes.withColumn("weight", weight).withColumn("_limit", F.col("source_size") * F.lit(float(most_epochs)))
    limited = limited.withColumn("_ratio", F.col("_limit") / F.col("weight"))
    everything = Window.partitionBy()
    before = Window.orderBy("_ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    left = total - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))
    heavy = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    full = F.col("_ratio") <= left / heavy
    # levels rise up to the first source that isn't full, and fall behind it
    level = F.max(F.when(~F.col("_full"), F.col("_level"))).over(everything)
    settled = limited.withColumn("_level", left / heavy).withColumn("_full", full)
    return settled.select("source", "source_size", "weight", F.when(F.col("_full"), F.col("_limit")).otherwise(level * F.col("weight")).alias("target"))


def mix_sources(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most_epochs: float = 2.0, seed: int = 20250824, range_rows: int | None = None) -> DataFrame:
    """How many words of each document the mixture takes.

    Returns ``id, source, size, source_size, target, taken``: ``taken`` counts
    repeated words; a source's taken words add up to the whole part of its
    target, and the document at the cut is taken in part.

    Null text has size 0 and is never taken; a null source is a source of its
    own, the last one; a null id gets the key of empty text.  Repeated rows are
    rows of their own; rows with equal keys are ordered by id and size.  An
    empty table gives no rows.  Other columns are not looked at.
    """
    # ``range_rows``: rows of one key range, about; as many as there are ranges, if they are many
    narrow = cut(docs.select(F.col(id_column).alias("id"), F.col(source_column).alias("source"), count_words(text_column).alias("size"), random_key(id_column, seed).alias("_key")))
    n = narrow.count()
    ranges = max(1, -(-n // (range_rows or max(512, isqrt(n)))))
    # a source as a non-null key
    narrow = narrow.withColumn("_source", F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), "source")))
    narrow = narrow.withColumn("_range", F.floor(F.col("_key") / F.lit(_KEY_SPACE) * F.lit(ranges)).cast("int"))
    by_range = narrow.groupBy("_source", "_range").agg(F.sum("size").alias("_words"), F.first("source").alias("source"))
    sizes = by_range.groupBy("_source").agg(F.sum("_words").alias("source_size"), F.first("source").alias("source"))
    targets = source_targets(sizes.select("source", "source_size"), weights, share, most_epochs)
    targets = targets.withColumn("_source", F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), "source"))).drop("source")
    earlier = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_range.select("_source", "_range", F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_offset")).join(targets, "_source")
    # one shuffle of the rows by source and range serves the running sums and the join
    inside = Window.partitionBy("_source", "_range").orderBy("_key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = narrow.withColumn("_before", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, ["_source", "_range"])
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("_offset") - F.col("_before")))
    return placed.select("id", "source", "size", "source_size", "target", (epochs * F.col("size") + part).alias("taken"))


def mixed_documents(docs: DataFrame, columns: list[str], **options) -> DataFrame:
    """The mixture's documents: each row as often as it is taken.

    A document at a source's cut is kept whole.  ``options`` go to
    ``mix_sources``; ``columns`` are returned.  Rows that share an id share
    its count, and an id's repeats differ in no column.
    """
    taken = mix_sources(docs, **options)
    key = options.get("id_column", "doc_id")
    # the ids' counts are narrow; rows without words are never taken
    own, often, copy = (free_name(docs, name) for name in ("_id", "_times", "_copy"))
    times = taken.where("taken > 0").groupBy(F.col("id").alias(own)).agg(F.max(F.ceil(F.col("taken") / F.col("size"))).cast("int").alias(often))
    times = small_or_not(times, 64)
    joined = docs.join(times, F.col(key).eqNullSafe(F.col(own)))
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(often)))).select(*columns)
