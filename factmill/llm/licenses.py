"""License scans: exact phrases, and short notices with a bounded number of edits.

The text is normalised to words with single spaces between.  A notice of the
table that may differ in ``e`` places is split into ``e + 1`` parts; whatever
is within ``e`` edits holds one part unchanged (pigeonhole), so exact search
for the parts finds every place where the notice may stand.  There the regex
library's bounded-error matching decides and gives the edits and the span.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .shared import LOWER, text_slices

#: Phrases whose places are counted, and their labels.  Fixed values.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Short notices, as normalised words: label, notice, edits allowed.
NOTICES = (
    ("mit", "released under the mit license", 3),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 5),
    ("apache", "licensed under the apache license version 2 0", 4),
    ("gpl", "licensed under the gnu general public license version 3", 5),
    ("lgpl", "gnu lesser general public license", 3),
    ("bsd", "redistribution and use in source and binary forms", 4),
    ("mpl", "subject to the terms of the mozilla public license", 4),
    ("cc-by", "creative commons attribution", 2),
    ("cc-by-nc", "licensed under cc by nc 4 0", 2),
    ("unlicense", "free and unencumbered software released into the public domain", 4),
    # the phrases themselves, misspelt
    ("mit", "mit license", 1),
    ("apache", "apache license", 2),
    ("gpl", "general public license", 2),
)
#: What must stand unchanged at a notice's beginning, where any change would make it another one: a bit, kit or exit license isn't MIT's.
UNCHANGED = {"mit license": "mit "}

#: True for the bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` once A-Z are lower case.
WORD_BYTES = np.zeros(256, dtype=bool)
WORD_BYTES[0x30:0x3A] = WORD_BYTES[0x61:0x7B] = WORD_BYTES[0x80:] = True
_SPACE, _END = 0x20, 0x01
_CLEAN = np.where(WORD_BYTES[LOWER], LOWER, np.uint8(_SPACE)).astype(np.uint8)

SCAN_SCHEMA = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<label:string,notice:string,first_word:bigint,last_word:bigint,edits:int>>"
_SPAN = pa.struct([("label", pa.string()), ("notice", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32())])


def seeds_of(notice: str, edits: int) -> list[tuple[int, str]]:
    """The notice cut into ``edits + 1`` parts of near-equal length, with their places; or the part that must not change."""
    if head := UNCHANGED.get(notice):
        return [(0, head)]
    parts, size = edits + 1, len(notice)
    bounds = [size * i // parts for i in range(parts + 1)]
    return [(a, notice[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]


@cache
def _matchers(notices: tuple) -> list:
    found = []
    for label, notice, edits in notices:
        head = UNCHANGED.get(notice, "")
        head, body = (regex.escape(x.encode(), special_only=True, literal_spaces=True) for x in (head, notice[len(head) :]))
        # up to a word's end; where it begins is tried at word beginnings
        pattern = rb"(?b)" + head + rb"(?:" + body + rb"){e<=" + str(edits).encode() + rb"}(?= )"
        found.append((label, notice, edits, regex.compile(pattern), [(at, part.encode()) for at, part in seeds_of(notice, edits)]))
    return found


def normalise(data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Lower-case words, each followed by one space; every row ends with an end mark."""
    n = len(offsets) - 1
    spread = np.full(len(data) + 2 * n, _SPACE, np.uint8)
    # each row moves right by two places for every row before it
    place = np.arange(len(data)) + 2 * np.repeat(np.arange(n), np.diff(offsets))
    spread[place] = _CLEAN[data]
    ends = offsets[1:] + 2 * np.arange(n) + 1
    spread[ends] = _END
    keep = spread != _SPACE
    word = spread > _SPACE
    keep[1:] |= (spread[1:] == _SPACE) & word[:-1]
    clean = spread[keep]
    return clean.tobytes(), np.concatenate(([0], np.flatnonzero(clean == _END) + 1))


def _places(text: bytes, part: bytes) -> list[int]:
    found, at = [], text.find(part)
    while at >= 0:
        found.append(at)
        at = text.find(part, at + 1)
    return found


def scan_batch(text: bytes, bounds: np.ndarray, phrases: dict[str, str], notices: tuple) -> tuple[list, list]:
    """Phrase places ``(row, start, label)`` and notice spans ``(row, start, end, edits, label, notice)``."""
    base, spans = [], []
    for phrase, label in phrases.items():
        part = phrase.encode() + b" "
        for at in _places(text, part):
            if at == 0 or text[at - 1] in (_SPACE, _END):
                base.append((int(np.searchsorted(bounds, at, side="right")) - 1, at, label))
    for label, notice, edits, matcher, seeds in _matchers(notices):
        starts = sorted({at - offset for offset, part in seeds for at in _places(text, part)})
        done = -1
        for start in starts:
            # other parts of a notice that was found already
            if start < done - edits:
                continue
            row = int(np.searchsorted(bounds, max(start, 0), side="right")) - 1
            seen = {row, int(np.searchsorted(bounds, min(start + len(notice), len(text) - 1), side="right")) - 1}
            for r in sorted(seen):
                low, high = max(int(bounds[r]), start - edits), min(int(bounds[r + 1]) - 1, start + len(notice) + edits + 1)
                words = [at for at in range(low, min(high, start + edits + 1)) if at == bounds[r] or text[at - 1] == _SPACE]
                tried = [m for at in words if (m := matcher.match(text, at, high))]
                if tried:
                    m = min(tried, key=lambda m: (sum(m.fuzzy_counts), m.start()))
                    spans.append((r, m.start(), m.end(), sum(m.fuzzy_counts), label, notice))
                    done = max(done, m.end())
    return base, sorted(set(spans))


def scan_licenses(docs: DataFrame, phrases: dict[str, str] | None = None, notices: tuple = NOTICES) -> DataFrame:
    """Scan whole texts; one row per row of ``docs`` with counts, labels, score and spans.

    ``n_base`` counts the places of all phrases, ``first_word`` and
    ``last_word`` are their smallest and largest start in words.  ``labels``
    adds the labels of notices found within their edits; ``spans`` reports
    them.  ``score`` is 1 where a phrase stands, else the largest share of a
    notice's characters that matched, and 0 where nothing was found.

    Null and empty texts have no words and no labels.  Repeated rows are
    scanned each.  An empty table gives no rows.  Other columns are ignored.
    """
    phrases = dict(PHRASES if phrases is None else phrases)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            text, bounds = normalise(part.data, part.offsets)
            base, spans = scan_batch(text, bounds, phrases, notices)
            gaps = np.flatnonzero(np.frombuffer(text, np.uint8) == _SPACE)
            before = np.searchsorted(gaps, bounds)
            # words from 0 of the row: the spaces between its start and the place
            word = lambda row, at: int(np.searchsorted(gaps, at)) - int(before[row])
            count, first, last = np.zeros(part.n, np.int64), [None] * part.n, [None] * part.n
            base_labels: list[set] = [set() for _ in range(part.n)]
            score = np.zeros(part.n)
            for row, at, label in base:
                w = word(row, at)
                count[row] += 1
                first[row] = w if first[row] is None else min(first[row], w)
                last[row] = w if last[row] is None else max(last[row], w)
                base_labels[row].add(label)
                score[row] = 1.0
            labels = [set(x) for x in base_labels]
            found: list[list] = [[] for _ in range(part.n)]
            for row, start, end, edits, label, notice in spans:
                labels[row].add(label)
                score[row] = max(score[row], 1.0 - edits / len(notice))
                # an edit may have taken in the space after the last word
                stop = end - 1 if text[end - 1] != _SPACE else end - 2
                found[row].append({"label": label, "notice": notice, "first_word": word(row, start), "last_word": word(row, max(stop, start)), "edits": edits})
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), pa.array(np.diff(before)), pa.array(count), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array([",".join(sorted(x)) for x in base_labels], pa.string()), pa.array([",".join(sorted(x)) for x in labels], pa.string()), pa.array(score), pa.array(found, pa.list_(_SPAN))],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
            )

    return docs.select("doc_id", "text").mapInArrow(scan, SCAN_SCHEMA)
