"""Bounds that must not show in results: excerpts, counts of one task, pieces of long texts, many languages, odd columns, repeated ids."""

import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factmill.llm import language_id, lm_scoring, mixing, near_dedup, packing, quality, shared, toxicity

from .helpers import documents, prose


def flat(texts):
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])


def test_excerpts_have_no_step(spark):
    """A text at the bound is whole, one byte more loses next to nothing, and a long one keeps as many bytes from all over it."""
    rows = [(n, "é" * (n // 2) + "x" * (n % 2)) for n in (0, 1, 799, 800, 801, 900, 5001, 100_000)]
    docs = spark.createDataFrame([*rows, (-1, None)], "n long, text string")
    got = {r["n"]: r["e"] for r in docs.select("n", shared.excerpt("text", 800).alias("e")).collect()}
    assert got[-1] is None
    for n, text in rows:
        assert got[n] == text.encode() if n <= 800 else 790 < len(got[n]) <= 800
    numbered = spark.createDataFrame([("".join(f"{i:05}" for i in range(20_000)),)], "text string")
    pieces = numbered.select(shared.excerpt("text", 800).alias("e")).first()[0].split(b" ")
    assert len(pieces) == 8 and pieces[0].startswith(b"0000000001") and pieces[-1].endswith(b"19999")


def test_many_languages():
    """Codewords of 1,200 languages stay apart, and decoding takes no room for each language and bit."""
    codes = language_id.codewords(1200)
    assert language_id.least_distance(codes) > 20
    assert len({tuple(c) for c in codes.tolist()}) == 1200
    random_ = np.random.default_rng(1)
    model = language_id.Classifiers([str(i) for i in range(1200)], codes, random_.normal(size=(64, codes.shape[1])), np.zeros(codes.shape[1]))
    x = random_.normal(size=(300, 64))
    tracemalloc.start()
    best, share, _ = model.decode(x)
    assert tracemalloc.get_traced_memory()[1] < 40 << 20
    tracemalloc.stop()
    margins = x @ model.weights
    for i in range(0, 300, 37):
        losses = [np.log1p(np.exp(-np.clip(margins[i] * c, -30, 30))).sum() for c in codes]
        assert best[i] == int(np.argmin(losses)) and share[i] == pytest.approx(1 / sum(np.exp(min(losses) - np.array(losses))))


def test_least_distance():
    codes = language_id.codewords(40)
    assert language_id.least_distance(codes, 7) == min(int((codes[i] != codes[j]).sum()) for i in range(40) for j in range(i))


def test_all_languages_are_learned(spark):
    rows = [(i, f"{chr(0x4E00 + i % 1100)}{chr(0x4E00 + i % 1100)} word", f"l{i % 1100}") for i in range(4400)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), fit_rows=100, rounds=1)
    assert set(model.languages) == {x[2] for x in rows if zlib.crc32(str(x[0]).encode()) % 5} and len(model.languages) > 1090


def test_counts_are_handed_on():
    random_, counts, total, handed = np.random.default_rng(2), shared.Counts(1000), Counter(), Counter()
    for _ in range(60):
        keys, n = np.unique(random_.integers(0, 5000, 300).astype(np.uint64), return_counts=True)
        total.update(dict(zip(keys.tolist(), n.tolist(), strict=True)))
        if (found := counts.add(keys, n)) is not None:
            handed.update(dict(zip(found[0].tolist(), found[1].tolist(), strict=True)))
            assert len(found[0]) > 1000 and counts.held == 0
        assert counts.held <= 2000
    assert handed
    last = counts.drained()
    handed.update(dict(zip(last[0].tolist(), last[1].tolist(), strict=True)))
    assert handed == total and not counts.parts


def test_counting_random_text_takes_bounded_memory():
    """64 MB of text without repeats, in one task."""
    random_ = np.random.default_rng(3)

    def batches():
        for i in range(64):
            yield pa.RecordBatch.from_pydict({"doc_id": [i], "text": [random_.integers(97, 123, 1 << 20).astype(np.uint8).tobytes().decode()]})

    tracemalloc.start()
    n = sum(b.column(2).to_numpy().sum() for b in lm_scoring._count(batches(), 5, 7, 2) if b.num_rows and b.column(0)[0].as_py() > 0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 64 * ((1 << 20) + 1) and peak < 500 << 20


def test_pieces_of_a_long_text(monkeypatch):
    """N-grams, words and features of a text are the same whatever the pieces it is taken in."""
    r = random.Random(4)
    text = " ".join("".join(r.choice("abé") for _ in range(r.choice([1, 3, 9, 200]))) for _ in range(300))
    whole = [lm_scoring._gram_pieces(*flat([text]), 5), shared.word_pieces(*flat([text])), [toxicity.distinct_features(*flat([text]))]]
    grams = Counter(np.concatenate([c for c, _ in whole[0]]).tolist())
    words, features = text.split(" "), set(whole[2][0][0].tolist())
    for size in (7, 64, 1000):
        monkeypatch.setattr(shared, "SLICE_BYTES", size)
        monkeypatch.setattr(lm_scoring, "SLICE_BYTES", size)
        got = list(lm_scoring._gram_pieces(*flat([text]), 5))
        assert Counter(np.concatenate([c for c, _ in got]).tolist()) == grams and len(got) > 1 and all(len(c) == n.sum() for c, n in got)
        pieces = list(shared.word_pieces(*flat([text])))
        assert [w for data, _ in pieces for w in data.tobytes().decode().split()] == words and len(pieces) > 1
        keys, counts = toxicity.distinct_features(*flat([text]))
        assert set(keys.tolist()) == features and counts.tolist() == [len(features)]


NAMES = ("_id", "_times", "_nth", "_copy", "_salt", "_key", "_source", "_range", "rep", "value", "size", "id", "taken", "component_id", "kept")


def test_columns_of_any_name(spark):
    docs, rows = documents(spark, 60, 2, [(3, "the same id again", "en", "a", 1, "x", "y"), (3, "the same id again", "en", "a", 1, "x", "y")])
    odd = docs
    for name in NAMES:
        odd = odd.withColumn(name, F.lit("clash"))
    labels = spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    stages = [
        lambda d: quality.accepted(d, labels),
        lambda d: toxicity.accepted(d, labels),
        lambda d: near_dedup.deduplicated(d, width=5, percent=80),
        lambda d: mixing.mixed_documents(d, d.columns),
    ]
    for stage in stages:
        plain, named = stage(docs), stage(odd)
        assert named.columns == odd.columns
        shown = lambda d: sorted(map(str, d.select(*docs.columns).collect()))
        assert shown(named) == shown(plain)
    assert packing.pack_documents(odd).count() == packing.pack_documents(docs).count()


def test_ids_with_many_near_copies(spark):
    """Two ids with many different near copies each, and links between them, in about the time of any other table."""
    r = random.Random(6)
    base = [prose(r, "en", 60).split() for _ in range(2)]
    rows = []
    for i in range(100):
        words = list(base[0])
        words[r.randrange(60)] = f"x{i}"
        rows.append((i % 2, " ".join(words)))
    rows += [(i, prose(r, "fr", 50)) for i in range(2, 40)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(rows) and {g["component_id"] for g in got if g["doc_id"] < 2} == {0}
    assert all(g["component_id"] == g["doc_id"] for g in got if g["doc_id"] >= 2)
