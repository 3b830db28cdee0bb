"""Periodic runs against their definition."""

import hashlib
import re
import zlib
from random import Random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factmill.llm import periods, queries, shared

from .helpers import documents, empty

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def has_period(w, q):
    return all(w[i] == w[i + q] for i in range(len(w) - q))


def runs_by_definition(w, shortest=6, times=4):
    """Stretches whose words equal those a period later, as long as they get, whose smallest period that is."""
    out = []
    for q in range(1, len(w) // times + 1):
        k = 0
        while k + q < len(w):
            end = k
            while end + q < len(w) and w[end] == w[end + q]:
                end += 1
            length = end + q - k
            if end > k and length >= max(shortest, times * q) and not any(has_period(w[k : k + length], r) for r in range(1, q)):
                out.append((k, length, q))
            k = max(end, k + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


@pytest.mark.parametrize("shortest,times", [(6, 4), (1, 2), (5, 3)])
def test_sequences(shortest, times):
    r = Random(shortest)
    for _ in range(500):
        n, letters = r.randint(0, 60), r.choice([1, 2, 2, 3, 5])
        w = [r.randrange(letters) for _ in range(n)]
        if n and r.random() < 0.5:
            q = r.randint(1, 6)
            for i in range(r.randrange(n) + q, n):
                w[i] = w[i - q]
        assert [tuple(x) for x in periods.runs_of(np.array(w, np.int64), shortest, times).tolist()] == runs_by_definition(w, shortest, times)


def test_fibonacci_and_one_word():
    """Words with as many runs as there can be, and a long text of one word: one run, in no time."""
    a, b = [0], [0, 1]
    while len(b) < 300:
        a, b = b, b + a
    assert [tuple(x) for x in periods.runs_of(np.array(b), 1, 2).tolist()] == runs_by_definition(b, 1, 2)
    assert periods.runs_of(np.zeros(100_000, np.int64)).tolist() == [[0, 100_000, 1]]


def test_words_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(shared, "hash_words", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    data = np.frombuffer(b"ab cd ab cd x", np.uint8)
    starts, ends, _ = shared.word_bounds(data, np.array([0, len(data)]))
    numbers, first = shared.number_words(data, starts, ends)
    assert numbers.tolist() == [0, 1, 0, 1, 2] and first.tolist() == [0, 1, 4]


def test_long_texts_in_stretches(monkeypatch):
    r = Random(9)
    text = "".join(r.choice(["a", "b ", "é", "\n", " "]) for _ in range(5000)).encode()
    want = shared.word_bounds(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    monkeypatch.setattr(shared, "SLICE_BYTES", 37)
    got = shared.long_word_bounds(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert all((x == y).all() for x, y in zip(want, got, strict=True))


def repeating(doc_id, words):
    """The contract's change of documents whose crc32 is divisible by 10."""
    h, n = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]


def test_query(spark, tmp_path):
    r = Random(4)
    extra = [(20_000 + i, " ".join(r.choice("ab") for _ in range(r.randint(0, 80))), None, None, None, None, None) for i in range(60)]
    extra += [(30_000, "x y " * 3 + "z", "en", "a", 1, "x", "y"), (30_001, "x y z w " * 4, "en", "a", 1, "x", "y"), (30_001, "x y z w " * 4, "en", "a", 1, "x", "y")]
    docs, rows = documents(spark, 150, 8, extra)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(queries.op11_periodic_runs(spark, str(tmp_path)).collect(), key=str)
    want = []
    for doc_id, text, *_ in rows:
        w = repeating(doc_id, WORDS.findall(text or ""))
        runs = runs_by_definition(w) if len(w) < 3000 else [(0, len(w), 1)]
        s, n, q = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want.append((doc_id, len(runs), s, n, q, 1000 * n // q if runs else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(collapsed(w, runs))))
    assert [tuple(g) for g in got] == [tuple(g) for g in sorted((type(got[0])(*w) for w in want), key=lambda g: str(got[0].__class__(**dict(zip(got[0].__fields__, g, strict=True)))))]
    assert sum(w[1] > 0 for w in want) > 40


def test_operator(spark):
    docs = spark.createDataFrame([(1, "a b a b a b a b c", 5), (2, None, 5), (None, " ", 5), (3, "no runs here", 5)], "doc_id long, text string, n_words int").withColumn("_id", F.lit("clash"))
    got = {g["doc_id"]: (g["n_words"], [tuple(x) for x in g["runs"]], g["text"]) for g in periods.periodic_runs(docs).collect()}
    assert got == {1: (9, [(0, 8, 2)], "a b c"), 2: (0, [], ""), None: (0, [], ""), 3: (3, [], "no runs here")}
    assert periods.periodic_runs(empty(spark)).count() == 0


def test_joined_words():
    data = np.frombuffer(b"one two three", np.uint8)
    starts, sizes = np.array([8, 0, 4]), np.array([5, 3, 3])
    assert periods.joined_words(data, starts, sizes, np.array([0, 2, 0, 1])).to_pylist() == ["", "three one", "", "two"]
    assert periods.joined_words(data, starts[:0], sizes[:0], np.array([0, 0])).to_pylist() == ["", ""]
    assert isinstance(periods.joined_words(data, starts, sizes, np.array([3])), pa.StringArray)
