"""What the operators share: cutting lineage, and numpy views of Arrow text.

Python tasks see text as one flat ``uint8`` array with row offsets, so that
tokenising and hashing are a few numpy passes and never a loop over rows.
Work is done in slices of about ``SLICE_BYTES`` of text and at most
``SLICE_ROWS`` rows, which bounds a task's memory whatever the batch size; one
longer text is a slice of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, drop  # noqa: F401

SLICE_BYTES = 1 << 20
#: Rows of a slice, at most: what a task holds for each row is bounded too.
SLICE_ROWS = 4096
#: Distributed data is only broadcast below this many bytes.
BROADCAST_BYTES = 16 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: True for the bytes of words ``[^\x20\x09-\x0D]+``.
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE_KEYS = np.random.default_rng(20250824).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def small_or_not(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df``, written out, with a broadcast hint if its counted rows are below the bound."""
    table = cut(df)
    found = F.broadcast(table) if table.count() * row_bytes <= BROADCAST_BYTES else table
    found._factmill_path = table._factmill_path
    return found


def crc_mod(column: str, n: int) -> Column:
    """crc32 of an id as text, modulo ``n``; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def crc_of(ids: Iterable) -> np.ndarray:
    """The same crc32 for ids in Python."""
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) for i in ids], dtype=np.int64)


def hash_share(column: str, seed: int) -> Column:
    """A fixed pseudo-random number in [0, 1) of an id."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(column)), 11) / F.lit(float(1 << 53))


def bounded_sample(rows: DataFrame, id_column: str, most: int, seed: int) -> DataFrame:
    """At most ``most`` rows: those whose id hashes lowest, ties by all columns; all if they are fewer.

    Used for fitting only; the bound is the caller's documented parameter.
    """
    n = rows.count()
    if n <= most:
        return rows
    # what the order below has to look at is cut down first; few rows miss a share of twice what is asked for
    likely = rows.where(hash_share(id_column, seed) < 2.0 * most / n + 64.0 / n)
    return likely.orderBy(hash_share(id_column, seed), *rows.columns).limit(most)


def excerpt(text: str, most: int, pieces: int = 8) -> Column:
    """Bytes of a text of at most ``most`` bytes, of a longer one ``most`` bytes from all over it: as many pieces of one size, blanks between.

    For fitting only: long texts stay in the sample, and it stays bounded.
    Just above the bound pieces overlap, so that next to nothing is lost.
    """
    data, n = F.col(text).cast("binary"), F.octet_length(text)
    size = (most - pieces + 1) // pieces
    parts = []
    for i in range(pieces):
        start = F.floor((n - size) * F.lit(i) / F.lit(pieces - 1)).cast("int")
        parts += [F.substring(data, start + 1, F.lit(size)), F.lit(b" ")]
    return F.when(n <= most, data).otherwise(F.concat(*parts[:-1]))


def free_name(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def one_text(rows: DataFrame, *kept: str) -> DataFrame:
    """Of rows that share a ``doc_id``, the one with the smallest text."""
    return rows.groupBy("doc_id").agg(F.min(F.struct("text", *kept)).alias("_row")).select("doc_id", "_row.*")


class Slice:
    """Some rows of a batch: their table, and their texts as one byte array."""

    def __init__(self, rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray):
        self.rows, self.data, self.offsets = rows, data, offsets
        self.n = rows.num_rows

    def column(self, name: str) -> pa.Array:
        return self.rows.column(self.rows.schema.get_field_index(name))

    def per_row(self, positions: np.ndarray) -> np.ndarray:
        """The row of each byte position."""
        return np.searchsorted(self.offsets, positions, side="right") - 1


def text_slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES, most_rows: int = SLICE_ROWS) -> Iterator[Slice]:
    """Cut batches into slices of about ``most`` bytes of text and at most ``most_rows`` rows; null text is empty."""
    for batch in batches:
        at, n = 0, batch.num_rows
        if not n:
            continue
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string()).fill_null("")
        buffers = column.buffers()
        offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + n + 1]
        data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
        while at < n:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
            end = min(end, n, at + most_rows)
            yield Slice(batch.slice(at, end - at), data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
            at = end


def word_bounds(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = NON_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and how many words each row has."""
    inside = is_word[data]
    first, last = inside.copy(), inside.copy()
    if len(data):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        bounds = offsets[1:-1]
        bounds = bounds[(bounds > 0) & (bounds < len(data))]
        first[bounds] = inside[bounds]
        last[bounds - 1] = inside[bounds - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def word_pieces(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = NON_SPACE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Data and offsets of a slice; of one long text piece by piece, each of whole words."""
    if len(offsets) > 2 or len(data) <= 2 * SLICE_BYTES:
        yield data, offsets
        return
    at = 0
    while at < len(data):
        end = min(at + SLICE_BYTES, len(data))
        # up to the end of the word that the piece would cut
        while end < len(data) and is_word[data[end]] and is_word[data[end - 1]]:
            outside = np.flatnonzero(~is_word[data[end : end + SLICE_BYTES]])
            end = end + int(outside[0]) if len(outside) else min(end + SLICE_BYTES, len(data))
        yield data[at:end], np.array([0, end - at])
        at = end


def long_word_bounds(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = NON_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same as ``word_bounds``; a slice of one long text is looked at in stretches."""
    if len(offsets) > 2 or len(data) <= 2 * SLICE_BYTES:
        return word_bounds(data, offsets, is_word)
    starts, ends = [], []
    for at in range(0, len(data), SLICE_BYTES):
        # one byte more on either side; no word goes on beyond the text
        first, last = max(at - 1, 0), min(at + SLICE_BYTES + 1, len(data))
        inside = is_word[data[first:last]]
        begins, stops = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        stops[:-1] &= ~inside[1:]
        begins, stops = np.flatnonzero(begins) + first, np.flatnonzero(stops) + first
        starts.append(begins[(begins >= at) & (begins < at + SLICE_BYTES)])
        ends.append(stops[(stops >= at) & (stops < at + SLICE_BYTES)] + 1)
    starts, ends = np.concatenate(starts), np.concatenate(ends)
    return starts, ends, np.array([len(starts)])


def places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All positions of ranges, one range after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def in_pieces(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last of consecutive ranges that make up about ``SLICE_BYTES`` together."""
    piece = np.cumsum(sizes) // SLICE_BYTES
    edges = np.append(np.flatnonzero(np.diff(piece, prepend=-1)), len(sizes)).tolist()
    yield from zip(edges[:-1], edges[1:], strict=True)


def same_bytes(data: np.ndarray, first: np.ndarray, second: np.ndarray, sizes: np.ndarray) -> bool:
    """Whether ranges that begin at ``first`` and at ``second`` hold the same bytes, all of them; in pieces of bounded size."""
    apart = first != second
    first, second, sizes = first[apart], second[apart], sizes[apart]
    for at, end in in_pieces(sizes):
        if end - at == 1:  # may be long
            if not np.array_equal(data[first[at] : first[at] + sizes[at]], data[second[at] : second[at] + sizes[at]]):
                return False
        elif (data[places(first[at:end], sizes[at:end])] != data[places(second[at:end], sizes[at:end])]).any():
            return False
    return True


def number_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number from 0 on for each byte range, the same exactly where the bytes are, and each number's first range.

    Ranges are told apart by their hashes, and those of one hash are compared
    byte by byte; should two of them differ, a dictionary numbers all.
    """
    _, first, numbers = np.unique(hash_words(data, starts, ends), return_index=True, return_inverse=True)
    sizes, head = ends - starts, first[numbers]
    if (sizes != sizes[head]).any() or not same_bytes(data, starts, starts[head], sizes):
        known: dict[bytes, int] = {}
        numbers = np.array([known.setdefault(data[s:e].tobytes(), len(known)) for s, e in zip(starts, ends, strict=True)], np.int64)
        first = np.unique(numbers, return_index=True)[1]
    return numbers, first


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, SLICE_BYTES + 4096)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _powers["up"] = np.cumprod(np.full(size, _BASE, np.uint64))
        _powers["down"] = np.cumprod(np.full(size, inverse, np.uint64))
    return _powers["up"], _powers["down"]


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges in ascending order: prefix sums of keyed bytes, shifted to each start.

    A long text is taken piece by piece; where a piece begins doesn't matter to the hashes.
    """
    out, at = np.zeros(len(starts), np.uint64), 0
    while at < len(starts):
        base = starts[at]
        end = max(at + 1, int(np.searchsorted(ends, base + SLICE_BYTES, side="right")))
        first, last = starts[at:end] - base, ends[at:end] - base
        part = data[base : ends[end - 1]]
        up, down = _power_tables(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE_KEYS[part] * up[: len(part)], out=sums[1:])
        out[at:end] = mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))
        at = end
    return out


def count_sorted(values: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and how often each occurs (or its sum of weights)."""
    if not len(values):
        return values, np.zeros(0, np.int64)
    if weights is None:
        values = np.sort(values)
    else:
        order = np.argsort(values, kind="stable")
        values, weights = values[order], weights[order]
    edge = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    sums = np.diff(np.append(edge, len(values))) if weights is None else np.add.reduceat(weights, edge)
    return values[edge], sums


class Counts:
    """Counts of 64-bit keys within one task, up to a number of keys: what is beyond is handed on, to be added up by whom it may concern."""

    def __init__(self, most: int = 1 << 20):
        self.most, self.held, self.parts = most, 0, []

    def add(self, keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Take in counts; those of all keys so far, if that are too many to hold."""
        self.parts.append((keys, counts))
        self.held += len(keys)
        if self.held <= 2 * self.most:
            return None
        self.parts = [self.merged()]
        self.held = len(self.parts[0][0])
        return self.drained() if self.held > self.most else None

    def drained(self) -> tuple[np.ndarray, np.ndarray]:
        """All counts; none are left."""
        out = self.merged()
        self.parts, self.held = [], 0
        return out

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(self.parts) == 1:
            return self.parts[0]
        return count_sorted(np.concatenate([k for k, _ in self.parts]), np.concatenate([c for _, c in self.parts]))


def lists(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    """A list column of flat values and each row's length."""
    return pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32), pa.array(values))
