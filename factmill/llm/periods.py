"""Periodic runs of words, from Lyndon words.

A run is a stretch of words with a smallest period that no neighbouring word
extends.  Every run with two periods or more holds, in one of the two orders of
words, a longest Lyndon word as long as its period.  So a scan from right to
left with a stack of Lyndon words, once under either order, names all places
and periods there can be; extending each to both sides gives the runs.  Equal
stretches are measured by binary search over rolling hashes; where a
comparison ends, and in every run that is reported, words themselves are
compared.

All texts of a slice are scanned as one sequence, with a word of its own
behind each text, which no run can cross.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import in_pieces, long_word_bounds, mix, number_words, places, text_slices

#: Two primes below 2^31: products of remainders stay within 64 bits.
PRIMES = (2147483647, 2147483629)
#: Words that are compared one by one before hashes are.
_NEAR = 4

#: From ids and word numbers of rows: where each row begins to repeat, and with which period (0: nowhere).
Remake = Callable[[list, np.ndarray], tuple[np.ndarray, np.ndarray]]


class Stretches:
    """A sequence of numbers whose stretches are compared by rolling hashes modulo two primes."""

    def __init__(self, sequence: np.ndarray, seed: int = 0):
        self.n = len(sequence)
        self.sums, self.powers = [], []
        for k, prime in enumerate(PRIMES):
            keys = mix(sequence.astype(np.uint64) + np.uint64(1 + k + 1000003 * seed)) % np.uint64(prime)
            base = int(mix(np.array([77 + k + 2 * seed], np.uint64))[0] % np.uint64(prime - 3)) + 2
            power = np.ones(1, np.uint64)
            while len(power) <= self.n:
                power = np.concatenate((power, power * np.uint64(pow(base, len(power), prime)) % np.uint64(prime)))
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum(keys * power[: self.n] % np.uint64(prime), out=sums[1:])
            self.sums.append(sums % np.uint64(prime))
            self.powers.append(power[: self.n + 1].copy())
        self._views = [(memoryview(s), memoryview(p), prime) for s, p, prime in zip(self.sums, self.powers, PRIMES, strict=True)]

    def equal(self, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the stretches of ``size`` from ``i`` and from ``j >= i`` on are equal; arrays."""
        same = np.ones(len(i), dtype=bool)
        for s, p, prime in zip(self.sums, self.powers, map(np.uint64, PRIMES), strict=True):
            left, right = s[i + size] + prime - s[i], s[j + size] + prime - s[j]
            same &= left % prime * p[j - i] % prime == right % prime
        return same

    def common(self, i: int, j: int) -> int:
        """How many words from ``i`` and from ``j > i`` on are equal: doubled until they differ, then halved."""
        (s, p, m), (t, q, k) = self._views
        most, d = self.n - j, j - i
        a, b, x, y = s[i], s[j], p[d], q[d]
        c, e = t[i], t[j]

        def same(size: int) -> bool:
            return ((s[i + size] - a) * x - s[j + size] + b) % m == 0 and ((t[i + size] - c) * y - t[j + size] + e) % k == 0

        low, step = 0, 1
        while low + step <= most and same(low + step):
            low += step
            step *= 2
        high = min(low + step - 1, most)
        while low < high:
            middle = (low + high + 1) // 2
            if same(middle):
                low = middle
            else:
                high = middle - 1
        return low

    def extended(self, i: np.ndarray, j: np.ndarray, most: np.ndarray, side: int) -> np.ndarray:
        """How far the words right of (``side`` 1) or left of (-1) ``i`` and ``j`` stay equal, up to ``most``; arrays."""
        low, high = np.zeros(len(i), np.int64), most.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            back = middle if side < 0 else 0
            same = self.equal(i - back, j - back, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low


def lyndon_ends(sequence: np.ndarray, stretches: Stretches) -> np.ndarray:
    """Where the longest Lyndon word from each place on ends: at the next smaller suffix.

    Scanned from right to left.  The stack is a chain: below each place lies
    the one at which its own word ends, and the top is the place scanned last.
    The end of the sequence is smaller than any word.
    """
    n = len(sequence)
    ends = np.full(n, n, np.int64)
    w, below, common = memoryview(np.ascontiguousarray(sequence)), memoryview(ends), stretches.common
    last_top = last_size = 0  # what the place scanned before was measured against first
    for i in range(n - 2, -1, -1):
        word, top, first = w[i], i + 1, 0
        while top < n:
            other = w[top]
            if other < word:
                break
            if other == word:
                # most places differ within a few words; hashes measure the others
                size, near = 1, min(_NEAR, n - top)
                while size < near and w[i + size] == w[top + size]:
                    size += 1
                if size == _NEAR:
                    size = last_size + 1 if last_top == top + 1 else common(i, top)
                    if not first:
                        first, first_size = top, size
                if top + size == n or w[top + size] < w[i + size]:
                    break
            top = below[top]
        below[i] = top
        last_top, last_size = first, first_size if first else 0
    return ends


def runs_of(sequence: np.ndarray, shortest: int = 6, times: int = 4) -> np.ndarray:
    """Rows ``start, length, period`` of all runs of ``shortest`` words and ``times`` (2 or more) periods or more, by start and period.

    Numbers of ``sequence`` are 0 or more.
    """
    sequence = sequence.astype(np.int64)
    n = len(sequence)
    top = int(sequence.max(initial=0))
    for seed in count():
        stretches, found = Stretches(sequence, seed), []
        for ordered in (sequence, top - sequence):
            i, j = np.arange(n), lyndon_ends(ordered, stretches)
            # the first Lyndon word of a run begins within its first period, so that much goes on behind it
            more = (times - 2) * (j - i)
            likely = j + more <= n
            if times > 2:
                likely[likely] = sequence[i[likely]] == sequence[np.minimum(j[likely], n - 1)]
            i, j, more = i[likely], j[likely], more[likely]
            likely = stretches.equal(i, j, more)
            i, j = i[likely], j[likely]
            right, left = stretches.extended(i, j, n - j, 1), stretches.extended(i, j, i, -1)
            found.append(np.stack([i - left, j - i + left + right, j - i], axis=1))
        runs = np.unique(np.concatenate(found), axis=0)
        runs = runs[(runs[:, 1] >= shortest) & (runs[:, 1] >= times * runs[:, 2])]
        runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
        if all(_is_run(sequence, *run) for run in runs.tolist()):
            return runs


def _is_run(sequence: np.ndarray, start: int, length: int, period: int) -> bool:
    """Whether words a period apart are equal, and those just outside aren't; looked up word by word."""
    end = start + length
    if not np.array_equal(sequence[start : end - period], sequence[start + period : end]):
        return False
    return (start == 0 or sequence[start - 1] != sequence[start - 1 + period]) and (end == len(sequence) or sequence[end] != sequence[end - period])


def joined_words(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Strings of ``counts`` words each, joined by one blank, the words being byte ranges in any order."""
    ends = np.cumsum(counts)
    words = np.concatenate(([0], np.cumsum(sizes + 1)))
    # a row of words ends without a blank
    offsets = np.concatenate(([0], np.cumsum(np.diff(words[np.concatenate(([0], ends))]) - (counts > 0))))
    out = np.full(int(offsets[-1]), 0x20, np.uint8)
    target = np.repeat(offsets[:-1] - words[ends - counts], counts) + words[:-1]
    for a, b in in_pieces(sizes):
        out[places(target[a:b], sizes[a:b])] = data[places(starts[a:b], sizes[a:b])]
    return pa.Array.from_buffers(pa.string(), len(counts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)])


def scan_slice(ids: list, data: np.ndarray, offsets: np.ndarray, shortest: int, times: int, remake: Remake | None) -> list[pa.Array]:
    """Word numbers, runs and collapsed texts of a slice's rows."""
    starts, ends, n_words = long_word_bounds(data, offsets)
    sizes, rows = ends - starts, len(n_words)
    first = np.cumsum(n_words) - n_words
    take = np.arange(len(starts))
    if remake:
        begin, period = remake(ids, n_words)
        for r in np.flatnonzero((period > 0) & (n_words > 0)):
            own = take[first[r] + begin[r] : first[r] + n_words[r]]
            own[:] = first[r] + begin[r] + np.arange(len(own)) % period[r]
    numbers, _ = number_words(data, starts, ends)
    n = int(numbers.max(initial=-1)) + 1
    # behind each row stands a number of its own
    sequence = np.empty(len(take) + rows, np.int64)
    own_row = np.repeat(np.arange(rows), n_words)
    sequence[np.arange(len(take)) + own_row] = numbers[take]
    sequence[np.cumsum(n_words) + np.arange(rows)] = n + np.arange(rows)
    del numbers
    runs = runs_of(sequence, shortest, times)
    row = np.searchsorted(first + np.arange(rows), runs[:, 0], side="right") - 1
    # words behind a run's first period go: how many runs such a place lies in
    cover = np.zeros(len(sequence) + 1, np.int32)
    np.add.at(cover, runs[:, 0] + runs[:, 2], 1)
    np.add.at(cover, runs[:, 0] + runs[:, 1], -1)
    keep = np.cumsum(cover)[np.arange(len(take)) + own_row] == 0
    kept = take[keep]
    texts = joined_words(data, starts[kept], sizes[kept], np.bincount(own_row[keep], minlength=rows))
    at = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=rows)))).astype(np.int32)
    structs = pa.StructArray.from_arrays([pa.array(runs[:, 0] - first[row] - row), pa.array(runs[:, 1]), pa.array(runs[:, 2])], names=["start", "length", "period"])
    return [pa.array(n_words.astype(np.int64)), pa.ListArray.from_arrays(at, structs), texts]


def periodic_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shortest: int = 6, times: int = 4, remake: Remake | None = None) -> DataFrame:
    """``doc_id, n_words, runs, text``: all runs of words of every whole text, and the text without their repeats.

    ``runs`` are structs ``start, length, period`` (words from 0), by start
    and period, of ``shortest`` words and ``times`` periods or more.  ``text``
    are the words joined by one blank, without those that any run holds behind
    its first period.  ``remake`` lets words of a row repeat before all that,
    from a word on with a period.

    A null or empty text has no words, no runs and an empty text.  Null ids
    stay null; repeated rows are scanned each; an empty table gives no rows;
    other columns are ignored.  Memory grows with one text, as a run may hold
    all of it; it takes about 20 times a long text's bytes.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            ids = part.column("_id").cast(pa.int64())
            yield pa.RecordBatch.from_arrays([ids, *scan_slice(ids.to_pylist(), part.data, part.offsets, shortest, times, remake)], names=["doc_id", "n_words", "runs", "text"])

    narrow = docs.select(docs[id_column].alias("_id"), docs[text_column].alias("text"))
    return narrow.mapInArrow(scan, "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, text string")
