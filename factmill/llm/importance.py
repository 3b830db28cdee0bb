"""Importance resampling towards a target distribution.

Features are hashed to buckets.  Counts of buckets by document are a sparse
matrix, persisted as compressed sparse rows, so that each Arrow batch of them
is a block in CSR form: column sums of the two corpora's blocks give their
distributions, the logarithms of their ratio are the buckets' gains, and each
block times the gains gives its documents' weights.  Weights with Gumbel
noise, in descending order, draw without replacement.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import LOWER, cut, drop, lists, long_word_bounds, text_slices

#: Bytes and rows of texts that are counted together, about, and words of one piece of them.
BLOCK_BYTES, BLOCK_ROWS, PIECE = 1 << 18, 1024, 1 << 17
#: Bytes of a row group of the matrix: a reader's batch of rows ends with it.  In memory, entries take about five times their bytes there.
GROUP_BYTES = 8 << 20

#: True for the bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``: digits, small letters, all beyond ASCII.
WORD_BYTES = np.zeros(256, dtype=bool)
WORD_BYTES[0x30:0x3A] = WORD_BYTES[0x61:0x7B] = WORD_BYTES[0x80:] = True

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, _CRC >> 1 ^ np.uint32(0xEDB88320), _CRC >> 1)
_START = np.uint32(0xFFFFFFFF)


def crc_on(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """States of crc32 carried on over byte ranges: byte by byte for all ranges at once, long ones' rest one by one."""
    sizes = ends - starts
    order = np.argsort(-sizes, kind="stable")
    out, first, size = state[order], starts[order], sizes[order]
    longest = min(int(size[0]), 64) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(longest), side="left")  # ranges longer than k come first
    for k in range(longest):
        own = out[: live[k]]
        own[:] = _CRC[(own ^ data[first[: live[k]] + k]) & 255] ^ own >> 8
    for i in range(int(np.searchsorted(-size, -64, side="left"))):
        out[i] = zlib.crc32(data[first[i] + 64 : first[i] + size[i]], int(out[i] ^ _START)) ^ 0xFFFFFFFF
    back = np.empty_like(out)
    back[order] = out
    return back


def bucket_counts(data: np.ndarray, offsets: np.ndarray, buckets: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A slice's texts as CSR rows: words of each row, entries of each row, their buckets (ascending) and counts."""
    low = LOWER[data] if len(offsets) > 2 else data
    table = WORD_BYTES if len(offsets) > 2 else WORD_BYTES[LOWER]
    starts, ends, words = long_word_bounds(low, offsets, table)
    row_of = np.repeat(np.arange(len(words)), words)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(starts), PIECE):
        end = min(at + PIECE, len(starts))
        stop = min(end + longest - 1, len(starts))
        base, piece = starts[at], LOWER[data[starts[at] : ends[stop - 1]]]
        own = (starts[at:stop] - base, ends[at:stop] - base)
        state = crc_on(np.full(end - at, _START), piece, own[0][: end - at], own[1][: end - at])
        rows, first = row_of[at:end], np.arange(end - at)
        keys = [rows * buckets + (state ^ _START) % np.uint32(buckets)]
        for more in range(1, longest):
            # runs of one word more: a blank, then the next word of the same row
            inside = at + first + more < len(starts)
            inside[inside] = row_of[at + first[inside] + more] == row_of[at + first[inside]]
            first, state = first[inside], state[inside]
            state = _CRC[(state ^ np.uint32(0x20)) & 255] ^ state >> 8
            state = crc_on(state, piece, own[0][first + more], own[1][first + more])
            keys.append(row_of[at + first] * buckets + (state ^ _START) % np.uint32(buckets))
        found.append(np.unique(np.concatenate(keys), return_counts=True))
    keys = np.concatenate([k for k, _ in found]) if found else np.zeros(0, np.int64)
    counts = np.concatenate([c for _, c in found]) if found else np.zeros(0, np.int64)
    if len(found) > 1:
        keys, where = np.unique(keys, return_inverse=True)
        counts = np.bincount(where, counts, len(keys)).astype(np.int64)
    return words, np.bincount(keys // buckets, minlength=len(words)), keys % buckets, counts


def count_blocks(docs: DataFrame, id_column: str, text_column: str = "text", buckets: int = 10000, longest: int = 1) -> DataFrame:
    """The document-by-bucket matrix, ``doc_id, words, buckets, counts``: a row for each document, with the counts of its buckets (ascending).

    Spark's reader holds thousands of rows of a row group at once, whatever
    their length.  So a row is one document, with an entry a bucket at most,
    and blocks of rows are only what Arrow makes of them, up to its own bounds.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, most=BLOCK_BYTES, most_rows=BLOCK_ROWS):
            words, entries, bucket, counts = bucket_counts(part.data, part.offsets, buckets, longest)
            columns = [part.column("_id").cast(pa.int64()), pa.array(words.astype(np.int64)), lists(bucket.astype(np.int32), entries), lists(counts.astype(np.int64), entries)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "words", "buckets", "counts"])

    narrow = docs.select(docs[id_column].alias("_id"), docs[text_column].alias("text"))
    return narrow.mapInArrow(count, "doc_id bigint, words bigint, buckets array<int>, counts array<bigint>")


def column_sums(blocks: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket, of all documents; a task hands on one row per bucket at most."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            bucket, counts = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (0, 1))
            np.add.at(sums, bucket, counts)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(sums[used])], names=["bucket", "n"])

    found = blocks.select("buckets", "counts").mapInArrow(add, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    sums = np.zeros(buckets, np.int64)
    sums[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return sums


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of target over source share, each count one more; floors, in doubles."""
    n, all_source, all_target = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (all_source + n) / ((s + 1.0) * (all_target + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weights(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """``doc_id, n_words, n_features, weight``: the matrix times the gains, block by block."""
    held = blocks.sparkSession.sparkContext.broadcast(gain)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, words, bucket, counts = batch.columns
            edges = np.concatenate(([0], np.cumsum(bucket.value_lengths().to_numpy(), dtype=np.int64)))
            bucket, counts = (x.flatten().to_numpy(zero_copy_only=False) for x in (bucket, counts))
            features, weight = (np.diff(np.concatenate(([0], np.cumsum(x)))[edges]) for x in (counts, counts * held.value[bucket]))
            yield pa.RecordBatch.from_arrays([ids, words, pa.array(features.astype(np.int64)), pa.array(weight.astype(np.int64))], names=["doc_id", "n_words", "n_features", "weight"])

    return blocks.mapInArrow(multiply, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def gumbel(id_column: str, seed: int) -> Column:
    """Thousandths of Gumbel noise, from 32 bits of the sha256 of seed and id; a null id is empty text."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def drawn(scored: DataFrame, may: Column, percent: int) -> DataFrame:
    """``scored`` with a ``rank`` from 1 for the share of rows ``may`` with the highest ``score``, ties by ``doc_id``; null for others.

    Ranges of scores are sorted apart and their sizes summed up, so that no
    task sees all rows.
    """
    few = scored.where(may)
    placed = cut(few.repartitionByRange(F.desc("score"), F.asc_nulls_last("doc_id")).sortWithinPartitions(F.desc("score"), F.asc_nulls_last("doc_id")).withColumn("_at", F.monotonically_increasing_id()))
    part, local = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # a row for each partition
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    placed = placed.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("_rank", F.col("_before") + local + 1)
    most = F.floor(F.lit(percent) * F.col("_all") / F.lit(100)).cast("long")
    ranked = placed.select(*scored.columns, F.when(F.col("_rank") <= most, F.col("_rank")).cast("long").alias("rank"))
    return ranked.unionByName(scored.where(~may).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, id_column: str = "doc_id", text_column: str = "text", target_text: str = "text", buckets: int = 10000, longest: int = 1, least_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every document, those drawn with a rank from 1.

    Features are runs of 1 to ``longest`` words.  Of the documents with
    ``least_words`` words or more, ``percent`` in a hundred are drawn, the
    number rounded down.

    Null and empty texts have no features and weight 0; they count for neither
    corpus and aren't drawn unless ``least_words`` is 0.  A null id is empty
    text for the noise and the last one among ties.  Repeated rows count, and
    are drawn, each.  Without target rows all target shares are equal.  An
    empty table gives no rows; other columns are ignored.
    """
    matrix = cut(count_blocks(docs, id_column, text_column, buckets, longest), **{"parquet.block.size": GROUP_BYTES})
    aim = target.select(F.lit(0).cast("long").alias("_nr"), target[target_text].alias("text"))
    gain = gains(column_sums(matrix, buckets), column_sums(count_blocks(aim, "_nr", "text", buckets, longest), buckets))
    scored = cut(weights(matrix, gain).withColumn("score", F.col("weight") + gumbel("doc_id", seed)))
    drop(matrix)
    return drawn(scored, F.col("n_words") >= least_words, percent)
