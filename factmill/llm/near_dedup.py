"""Near-duplicate groups from bottom-k sketches and exact Jaccard similarity.

One hash function orders all shingles; a document keeps its ``k`` smallest
hashes.  Equal shingle sets are one class from there on.  Of a class's
retained values the rarest ``p`` go into inverted lists: two sets with the
wanted similarity share so many retained values that, in one order of all
values, they must meet in a list (prefix filtering).  Pairs from the lists
must agree in most ranges of two signatures (two bits of the smallest hash in each
of 64 ranges), pass a filter on the sketch of their union, and what is
left is verified on the full sets.

A list never yields all its pairs.  First every class is compared with the
smallest class of each of its lists; the links found make components.  Only
classes that may be similar to one of another component are looked at after
that: an exact prefix and position filter on their full sets gives the pairs
that are left to verify, so that the final components are those of all links.

No key meets in one task: the centre of a large group is copied to as many
salts as its pairs need, and a list or shingle with many members is compared
in blocks.  What is written on the way is deleted as soon as nothing reads it.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import LOWER, cut, drop, free_name, hash_words, lists, mix, small_or_not, text_slices, word_bounds

SKETCH = 32
#: Values that are ordered as frequent ones, at most; all others count as equally rare.
FREQUENT = 1 << 18
#: Ranges of hashes that a signature has two bits for.
BITS = 64
#: A link at exactly the wanted similarity is missed with this chance at most, at each of three steps (overlap of
#: retained values, signature, union sketch): of ten billion links at the very threshold thirty may go, of those above it far fewer.
MISS = 1e-9
#: Members of a list that one task compares with all of it, and pairs of a class that one task gets, about.
BLOCK = 4096
BLOCK_PAIRS = 256
_STEP = np.uint64(0xD6E8FEB86659FD93)


def certain_overlap(k: int, percent: int, miss: float = MISS) -> int:
    """Retained values that two sets of the wanted similarity share but for a chance of ``miss``.

    Each of the k smallest hashes of a union is one of the intersection with
    the probability of the similarity.
    """
    p, tail = percent / 100, 0.0
    for t in range(k + 1):
        tail += comb(k, t) * p**t * (1 - p) ** (k - t)
        if tail > miss:
            return t
    return k


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of ``width`` words and how many each row has.

    A row with fewer words has its whole sequence as one shingle, a row
    without words has none.
    """
    data = LOWER[data]
    starts, ends, words = word_bounds(data, offsets)
    single = hash_words(data, starts, ends)
    first = np.concatenate(([0], np.cumsum(words)))[:-1]
    count = np.where(words >= width, words - width + 1, np.minimum(words, 1))
    total = int(count.sum())
    at = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    span = np.repeat(np.minimum(words, width), count)
    out = np.full(total, np.uint64(width), np.uint64)
    for i in range(width):
        use = span > i
        word = single[np.minimum(at + i, max(len(single) - 1, 0))] if len(single) else out
        out = np.where(use, mix(out * _STEP + word), out)
    # 63 bits: the order is the same in numpy and in Spark
    return out >> np.uint64(1), count


def row_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, ascending, and their number."""
    values, count = shingle_hashes(data, offsets, width)
    rows = np.repeat(np.arange(len(count)), count)
    order = np.lexsort((values, rows))
    values = values[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    return values[new], np.bincount(rows[new], minlength=len(count))


def signatures(values: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Two bits of the smallest hash in each of 64 ranges, for rows of ascending hashes: a word of first bits, one of second bits."""
    rows = np.repeat(np.arange(len(size)), size)
    bins = values >> np.uint64(63 - 6)
    first = np.ones(len(values), dtype=bool)
    first[1:] = (bins[1:] != bins[:-1]) | (rows[1:] != rows[:-1])
    start, mixed, words = np.cumsum(size) - size, mix(values), []
    for bit in (0, 1):
        bits = np.where(first, (mixed >> np.uint64(bit) & np.uint64(1)) << bins, np.uint64(0))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(bits, dtype=np.uint64)))
        words.append((sums[start + size] - sums[start]).view(np.int64))
    return words


def _sketch(batches: Iterator[pa.RecordBatch], width: int, k: int) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches):
        values, size = row_sets(part.data, part.offsets, width)
        start = np.cumsum(size) - size
        inside = np.arange(len(values)) - np.repeat(start, size)
        kept = values[inside < k]
        sums = np.concatenate(([0], np.cumsum(mix(values), dtype=np.uint64)))
        other = np.concatenate(([0], np.cumsum(mix(values ^ _STEP), dtype=np.uint64)))
        # two 64-bit sums over the whole set tell sets apart
        sign = [(s[start + size] - s[start]).view(np.int64) for s in (sums.astype(np.uint64), other.astype(np.uint64))]
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id").cast(pa.int64()), pa.array(size.astype(np.int64)), pa.array(sign[0]), pa.array(sign[1]), *map(pa.array, signatures(values, size)), lists(kept.view(np.int64), np.minimum(size, k))],
            names=["doc_id", "n", "sign_a", "sign_b", "bits", "bits2", "sketch"],
        )


def _full_sets(batches: Iterator[pa.RecordBatch], width: int, name: str = "doc_id") -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches):
        values, size = row_sets(part.data, part.offsets, width)
        yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), lists(values.view(np.int64), size)], names=[name, "shingles"])


def similar(values_a: np.ndarray, size_a: np.ndarray, values_b: np.ndarray, size_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether the sets of each row have the wanted Jaccard similarity."""
    rows = np.concatenate((np.repeat(np.arange(len(size_a)), size_a), np.repeat(np.arange(len(size_b)), size_b)))
    values = np.concatenate((values_a, values_b))
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    twice = np.flatnonzero((values[1:] == values[:-1]) & (rows[1:] == rows[:-1]))
    both = np.bincount(rows[twice], minlength=len(size_a))
    return both * 100 >= (size_a + size_b - both) * percent


def _compare(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows ``a, b, text_a, text_b`` whose full shingle sets are similar: ``a, b``."""
    for part in text_slices(batches, "text_b"):
        set_b = row_sets(part.data, part.offsets, width)
        at = 0
        for other in text_slices(iter([part.rows]), "text_a"):
            values, size = row_sets(other.data, other.offsets, width)
            own = slice(at, at + other.n)
            first = int(set_b[1][:at].sum())
            good = similar(values, size, set_b[0][first : first + int(set_b[1][own].sum())], set_b[1][own], percent)
            at += other.n
            yield other.rows.select(["a", "b"]).filter(pa.array(good))


def _need(n: Column, k: int, percent: int) -> Column:
    """Retained values that a class of ``n`` shingles shares with any similar one."""
    sure, least = certain_overlap(k, percent), F.ceil(n * F.lit(percent) / F.lit(100))
    # only against sets that may exceed the sketch is the overlap a matter of chance
    return F.when(n * F.lit(100) < F.lit(k * percent), least).otherwise(F.least(F.lit(sure), least))


def inverted_lists(classes: DataFrame, k: int, percent: int, frequent: int) -> tuple[DataFrame, DataFrame]:
    """``value, rep, n, bits, bits2``: each class under the rarest of its retained values; and ``value, parts`` of long lists."""
    values = cut(classes.select(F.explode("sketch").alias("value")).groupBy("value").count().where("count > 1"))
    steps = values.groupBy(F.floor(F.log2("count") * 4).alias("step")).count().orderBy(F.desc("step")).collect()
    reach, least = 0, 1 << 62
    for step in steps:
        reach += step["count"]
        if reach > frequent:
            break
        least = step["step"]
    hot = values.where(F.floor(F.log2("count") * 4) >= F.lit(least)).toArrow()
    keys = hot.column("value").to_numpy()
    rank = np.argsort(keys)
    held = classes.sparkSession.sparkContext.broadcast((keys[rank], hot.column("count").to_numpy()[rank]))

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent_keys, often = held.value
        for b in batches:
            sizes = np.diff(b.column(5).offsets.to_numpy())
            flat = b.column(5).flatten().to_numpy()
            rows = np.repeat(np.arange(b.num_rows), sizes)
            count = np.zeros(len(flat), np.int64)
            if len(frequent_keys):
                slot = np.minimum(np.searchsorted(frequent_keys, flat), len(frequent_keys) - 1)
                count = np.where(frequent_keys[slot] == flat, often[slot], 0)
            order = np.lexsort((flat, count, rows))
            place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            keep = place < np.repeat(sizes - b.column(4).to_numpy() + 1, sizes)
            chosen = order[keep]
            yield pa.RecordBatch.from_arrays([pa.array(flat[chosen]), *(pa.array(b.column(i).to_numpy()[rows[chosen]]) for i in range(4))], names=["value", "rep", "n", "bits", "bits2"])

    index = classes.select("rep", "n", "bits", "bits2", _need(F.col("n"), k, percent).cast("int").alias("need"), "sketch").mapInArrow(rarest, "value bigint, rep bigint, n bigint, bits bigint, bits2 bigint")
    # lists that may have more members than one task compares with each other
    return cut(index), small_or_not(values.where(F.col("count") > BLOCK).select("value", F.ceil(F.col("count") / F.lit(BLOCK)).cast("int").alias("parts")), 32)


def _may_be_similar(a: str, b: str, percent: int) -> Column:
    """What sizes and signatures of two sets allow; ranges with different smallest hashes agree by chance in a quarter of cases."""
    n_a, n_b = F.col(f"{a}.n"), F.col(f"{b}.n")
    sizes = (F.least(n_a, n_b) * F.lit(100)) >= (F.greatest(n_a, n_b) * F.lit(percent))
    differ = lambda c: F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))
    apart = F.bit_count(differ("bits").bitwiseOR(differ("bits2")))
    return sizes & (apart <= F.lit(BITS - certain_overlap(BITS, percent + (100 - percent) // 4)))


def _with_sides(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs ``a, b`` with what the tables ``a`` and ``b`` hold of either.

    A class ``b`` has few pairs, but one that stands for a list or a large
    group may be ``a`` in very many: its row is copied to as many salts as
    there are blocks of its pairs.
    """
    busy = small_or_not(pairs.groupBy("a").count().where(F.col("count") > BLOCK_PAIRS).select("a", F.ceil(F.col("count") / F.lit(BLOCK_PAIRS)).cast("int").alias("_salts")), 32)
    salted = pairs.join(busy, "a", "left").withColumn("_salt", F.pmod(F.xxhash64("b"), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    copied = a.join(busy, "a", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return salted.join(b, "b").join(copied, ["a", "_salt"]).drop("_salt")


def _ends(pairs: DataFrame) -> DataFrame:
    """``node``: every class that stands in a pair, written out."""
    return small_or_not(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct(), 64)


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, k: int, percent: int) -> DataFrame:
    """Pairs ``a, b`` that the sketch of their union allows and whose full shingle sets have the wanted similarity."""
    ends = _ends(pairs)
    asked = classes.join(ends, F.col("rep") == F.col("node"), "left_semi")
    side = lambda x: asked.select(F.col("rep").alias(x), F.col("sketch").alias(f"sketch_{x}"))
    joined = _with_sides(pairs, side("a"), side("b"))
    union = F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, k)
    joined = joined.select("a", "b", union.alias("_union"), F.array_intersect("sketch_a", "sketch_b").alias("_both"))
    shared, seen = F.size(F.array_intersect("_union", "_both")), F.size("_union")
    least = F.when(seen < k, F.ceil(seen * F.lit(percent) / F.lit(100))).otherwise(F.lit(certain_overlap(k, percent)))
    # an id with several texts has a sketch for each of them; its texts are compared once
    likely = cut(joined.where(shared >= least).select("a", "b").distinct())
    drop(ends)
    # texts travel to where their pair is checked: compressed, they are smaller than their sets of hashes
    ends = _ends(likely)
    # any one text of an id that stands in several rows: their links are found through either
    texts = docs.select("doc_id", "text").join(ends, F.col("doc_id") == F.col("node"), "left_semi")
    side = lambda x: texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}"))
    pairs_of = _with_sides(likely, side("a"), side("b")).select("a", "b", "text_a", "text_b")
    links = cut(pairs_of.mapInArrow(lambda batches: _compare(batches, width, percent), "a bigint, b bigint").distinct())
    drop(ends, likely)
    return links


def _blocked(rows: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two sides of a join of ``rows`` with themselves by ``value``: a long list is dealt to parts on one and copied to all of them on the other."""
    dealt = rows.join(parts, "value", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    one = dealt.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    return one.alias("x"), dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("y")


def _short_and_long(rows: DataFrame, long: DataFrame) -> list[tuple[DataFrame, bool]]:
    """Rows of short lists, dealt out by their list once for all that follows, and rows of long ones, left where they are."""
    short = rows.join(long, "value", "left_anti").repartition("value")
    return [(short, False), (rows.join(long, "value", "left_semi"), True)] if long.take(1) else [(rows.repartition("value"), False)]


def _prefix_pairs(left: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs ``a, b`` of different components among ``left`` that their full sets allow.

    Exact prefix and position filtering: shingles in one order, rare ones
    first; similar sets share one among their first few, and behind the first
    shared one both must have enough left for the overlap that is needed.
    """
    wanted = small_or_not(left.select(F.col("rep").alias("doc_id")), 64)
    sets = cut(docs.join(wanted, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(lambda b: _full_sets(b, width, "rep"), "rep bigint, shingles array<bigint>"))
    rows = sets.select("rep", F.explode("shingles").alias("value"))
    often = cut(rows.groupBy("value").count().where("count > 1"))
    small = small_or_not(left, 64)
    shared = rows.join(often, "value").join(small, "rep")
    order = Window.partitionBy("rep").orderBy("count", "value")
    # shingles that no other set has come first; their number follows from those that remain
    alone = F.col("n") - F.count("*").over(Window.partitionBy("rep"))
    placed = shared.withColumn("place", alone + F.row_number().over(order) - 1)
    placed = cut(placed.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * F.lit(percent) / F.lit(100))).drop("count"))
    drop(sets, wanted, small)
    long = small_or_not(often.where(F.col("count") > BLOCK).select("value", F.ceil(F.col("count") / F.lit(BLOCK)).cast("int").alias("parts")), 32)
    drop(often)
    x, y = _blocked(placed, long)
    most = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    enough = most * F.lit(100 + percent) >= (F.col("x.n") + F.col("y.n")) * F.lit(percent)
    pairs = x.join(y, (F.col("x.value") == F.col("y.value")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.component") != F.col("y.component")) & enough & _may_be_similar("x", "y", percent))
    pairs = cut(pairs.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct())
    drop(placed, long)
    return pairs


def components(links: DataFrame) -> DataFrame:
    """``node, component``: the smallest node that each linked node can reach.

    Alternating large-star and small-star steps: every step joins nodes to
    their smallest neighbour, so that hubs never meet in one task.
    """
    def sign(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    last = None
    while (now := sign(edges)) != last:
        last, before = now, edges
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = cut(small)
        drop(before)
    found = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    roots = edges.select(F.col("v").alias("node")).distinct().join(edges.select(F.col("u").alias("node")).distinct(), "node", "left_anti").withColumn("component", F.col("node"))
    nodes = small_or_not(found.union(roots), 64)
    drop(edges)
    return nodes


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, k: int = SKETCH, frequent: int = FREQUENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs``.

    Texts are linked where 100 times the intersection of their shingle sets
    is at least ``percent`` times the union; ``component_id`` is the smallest
    doc_id that links reach, and ``kept`` marks the document that has it.

    Null and empty texts have no shingles and no links; texts with fewer than
    ``width`` words are one shingle.  Repeated rows are returned each; rows
    that share an id are one node of the links.  A null id takes no part in
    links: its component is null and it is kept.  An empty table gives no
    rows; other columns are ignored.
    """
    signed = cut(docs.select("doc_id", "text").mapInArrow(lambda b: _sketch(b, width, k), "doc_id bigint, n bigint, sign_a bigint, sign_b bigint, bits bigint, bits2 bigint, sketch array<bigint>"))
    sign = ["n", "sign_a", "sign_b"]
    linked = signed.where("n > 0 and doc_id is not null")
    classes = cut(linked.groupBy(*sign).agg(F.min("doc_id").alias("rep"), F.first("bits").alias("bits"), F.first("bits2").alias("bits2"), F.first("sketch").alias("sketch")))
    # the result needs no sketches
    narrow, names = cut(signed.select("doc_id", *sign)), cut(classes.select("rep", *sign))
    drop(signed)
    index, long = inverted_lists(classes, k, percent, frequent)
    table, index = index, index.where(" and ".join(f"{c} is not null" for c in index.columns))  # what joins would ask of either side: one shuffle serves both
    # the smallest class of a list stands for it
    star = None
    for rows, is_long in _short_and_long(index, long):
        low = rows.groupBy("value").agg(F.min(F.struct("rep", "n", "bits", "bits2")).alias("low")).select("value", "low.*")
        x, y = (small_or_not(low, 64) if is_long else low).alias("x"), rows.alias("y")
        met = x.join(y, (F.col("x.value") == F.col("y.value")) & (F.col("x.rep") < F.col("y.rep")) & _may_be_similar("x", "y", percent)).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
        star = met if star is None else star.union(met)
    tried = cut(star.distinct())
    links = _verified(tried, classes, docs, width, k, percent)
    found = components(links)
    # sets of one list that the links so far don't connect, though they may be similar
    named = index.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("value", "rep", "n", "bits", "bits2", F.coalesce("component", "rep").alias("component"))
    left = None
    for rows, is_long in _short_and_long(named, long):
        mixed = rows.groupBy("value").agg(F.min("component").alias("_low"), F.max("component").alias("_high")).where("_low < _high").select("value")
        open_ = rows.join(small_or_not(mixed, 32) if is_long else mixed, "value")
        x, y = _blocked(open_, long) if is_long else (open_.alias("x"), open_.alias("y"))
        same = (F.col("x.value") == F.col("y.value")) & ((F.col("x.part") == F.col("y.part")) if is_long else F.lit(True))
        met = x.join(y, same & (F.col("x.rep") != F.col("y.rep")) & (F.col("x.component") != F.col("y.component")) & _may_be_similar("x", "y", percent), "left_semi").select("rep", "n", "bits", "bits2", "component")
        left = met if left is None else left.union(met)
    left = cut(left.groupBy("rep").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("bits2").alias("bits2"), F.first("component").alias("component")))
    drop(table, long)
    final = found
    if left.take(1):
        pairs = _prefix_pairs(left, docs, width, percent)
        more = _verified(pairs.join(tried, ["a", "b"], "left_anti"), classes, docs, width, k, percent)
        if more.take(1):
            final = components(links.union(more))
            drop(found)
        drop(pairs, more)
    drop(left, tried, links, classes)
    # classes of one id are one node already: equal ids
    named = names.join(final.withColumnRenamed("node", "rep"), "rep", "left").select(*sign, F.coalesce("component", "rep").alias("_component"))
    out = narrow.join(named, sign, "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("_component", "doc_id")).cast("long")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stand for their group.

    Of rows with the id and the text of a kept document one stays, by the
    order of all columns; rows without an id are copies where their texts are
    equal, and one of each stays.
    """
    gone = small_or_not(near_duplicates(docs, **options).where("not kept").select("doc_id").distinct(), 64)
    stay = docs.join(gone, "doc_id", "left_anti")
    # ids are narrow; texts are only moved where an id is missing or stands in several rows
    own, nth = free_name(docs, "_id"), free_name(docs, "_nth")
    again = small_or_not(docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").select(F.col("doc_id").alias(own)), 64)
    if not again.take(1):
        return stay
    same = F.col("doc_id").eqNullSafe(F.col(own))
    first = Window.partitionBy("doc_id", F.xxhash64("text"), "text").orderBy(*[c for c in docs.columns if c not in ("doc_id", "text")] or ["doc_id"])
    few = stay.join(again, same, "left_semi").withColumn(nth, F.row_number().over(first)).where(F.col(nth) == 1).drop(nth)
    return stay.join(again, same, "left_anti").unionByName(few)
