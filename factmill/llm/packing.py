"""Best-fit packing of documents into bins, with conflicts.

Documents are cut into pieces of at most a bin's capacity; full pieces are
bins of their own.  The other pieces are dealt to groups by a hash of their
id, so that one source or one group of copies never meets in one task, and
each group packs largest first: bins stand ordered by what is left in them
and carry a bitmap of sources and one of duplicate clusters; the search goes
on from the tightest bin that the piece fits to the next, until one has
neither the piece's source nor its cluster.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mixing import count_words
from .shared import cut

#: Words of a bin, and pieces of a packing group, about.
CAPACITY = 1024
GROUP_ROWS = 2048


def best_fit(pieces: Iterable[tuple[int, int, int]], capacity: int, one_per_source: bool = True) -> list[int]:
    """The bin of each piece ``(size, source, cluster)``, in the order given.

    ``source`` and ``cluster`` number the group's sources and clusters; a
    negative one conflicts with nothing.
    """
    order: list[tuple[int, int]] = []  # (left, bin), ascending
    sources: list[int] = []
    clusters: list[int] = []
    out = []
    for size, source, cluster in pieces:
        s = 1 << source if source >= 0 and one_per_source else 0
        c = 1 << cluster if cluster >= 0 else 0
        at = bisect_left(order, (size, -1))
        while at < len(order) and (sources[order[at][1]] & s or clusters[order[at][1]] & c):
            at += 1
        if at < len(order):
            left, b = order.pop(at)
        else:
            left, b = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        sources[b] |= s
        clusters[b] |= c
        insort(order, (left - size, b))
        out.append(b)
    return out


def pack_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", capacity: int = CAPACITY, group_rows: int = GROUP_ROWS, one_per_source: bool = True, cluster_column: str | None = None) -> DataFrame:
    """One row per piece: ``doc_id, copy, piece, first_word, n_words, source, bin_id, bin_words``.

    A bin holds at most ``capacity`` words, at most one piece of each source
    (if ``one_per_source``) and of each duplicate cluster: documents with the
    same text, or with the same value of ``cluster_column``, such as the
    components of near-duplicates; a null one is a cluster by its text.
    ``copy`` numbers the repeated rows of a document from 0.

    Documents without words (null or empty text) come back with a null
    ``bin_id``.  A null source conflicts with no other.  Ties between pieces
    go to the smaller id, piece and copy.  An empty table gives no rows;
    other columns are ignored.
    """
    cluster = F.xxhash64(text_column)
    if cluster_column:
        cluster = F.when(F.col(cluster_column).isNull(), cluster).otherwise(F.xxhash64(F.lit("cluster"), F.col(cluster_column)))
    narrow = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(source_column).cast("string").alias("source"), count_words(text_column).alias("size"), cluster.alias("cluster"))
    # repeated rows are numbered from their count, so that none of them needs to meet another
    narrow = cut(narrow.groupBy("doc_id", "source", "size", "cluster").count())
    narrow = narrow.withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("count") - 1).cast("int")))).drop("count")
    last = F.greatest(F.ceil(F.col("size") / F.lit(capacity)).cast("int") - 1, F.lit(0))
    pieces = narrow.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    pieces = pieces.withColumn("first_word", F.col("piece").cast("long") * capacity).withColumn("n_words", F.least(F.lit(capacity).cast("long"), F.col("size") - F.col("first_word")))
    whole = F.col("n_words") == capacity
    columns = ["doc_id", "copy", "piece", "first_word", "n_words", "source"]
    name = F.concat_ws("-", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.hex("cluster"), "copy", "piece")
    alone = pieces.where(whole | (F.col("n_words") == 0)).select(*columns, F.when(whole, F.concat(F.lit("full-"), name)).alias("bin_id"), F.when(whole, F.col("n_words")).alias("bin_words"))
    part = pieces.where(~whole & (F.col("n_words") > 0)).select(*columns, "cluster")
    groups = max(1, -(-narrow.count() // group_rows))
    part = part.withColumn("_group", F.pmod(F.xxhash64("doc_id", "copy", "piece", F.lit(29)), F.lit(groups)).cast("int"))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n_words", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("copy", "ascending"), ("cluster", "ascending"), ("source", "ascending")])
        sources, clusters = {}, {}
        number = lambda known, x: -1 if x is None else known.setdefault(x, len(known))
        sizes = table.column("n_words").to_pylist()
        rows = [(n, number(sources, s), number(clusters, c)) for n, s, c in zip(sizes, table.column("source").to_pylist(), table.column("cluster").to_pylist(), strict=True)]
        bins = best_fit(rows, capacity, one_per_source)
        used = [0] * (max(bins, default=-1) + 1)
        for b, n in zip(bins, sizes, strict=True):
            used[b] += n
        group = table.column("_group")[0].as_py()
        table = table.select(columns)
        return table.append_column("bin_id", pa.array([f"bin-{group}-{b}" for b in bins], pa.string())).append_column("bin_words", pa.array([used[b] for b in bins], pa.int64()))

    schema = "doc_id bigint, copy int, piece int, first_word bigint, n_words bigint, source string, bin_id string, bin_words bigint"
    return part.groupBy("_group").applyInArrow(pack, schema).unionByName(alone)
