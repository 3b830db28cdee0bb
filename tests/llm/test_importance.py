"""Importance resampling against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter
from pathlib import Path
from random import Random

import numpy as np
import pyarrow as pa
import pytest
from pyarrow.parquet import ParquetFile
from pyspark.sql import functions as F

from factmill.llm import importance, queries
from factmill.llm.shared import text_slices

from .helpers import documents, empty, prose

LOWER = {i: i + 32 for i in range(65, 91)}
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, buckets=10000, longest=1):
    w = WORDS.findall((text or "").translate(LOWER))
    return w, Counter(zlib.crc32(" ".join(w[k : k + g]).encode()) % buckets for g in range(1, longest + 1) for k in range(len(w) - g + 1))


def by_hand(rows, target, buckets=10000, longest=1, least=20, percent=10, seed=2024):
    """Rows ``doc_id, n_features, weight, score, rank`` as they are defined."""
    own = [features(t, buckets, longest) for _, t in rows]
    s, t = Counter(), Counter()
    for _, c in own:
        s.update(c)
    for text in target:
        t.update(features(text, buckets, longest)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    out = []
    for (doc_id, _), (words, c) in zip(rows, own, strict=True):
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] * n for b, n in c.items())
        out.append([doc_id, sum(c.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    may = sorted((x for x in out if x[5] >= least), key=lambda x: (-x[3], x[0] is None, x[0]))
    for rank, x in enumerate(may[: percent * len(may) // 100], 1):
        x[4] = rank
    return sorted((tuple(x[:5]) for x in out), key=str)


@pytest.mark.parametrize("longest", [1, 3])
def test_counts(longest, monkeypatch):
    """Blocks of counts for awkward texts, whatever the pieces they are counted in."""
    r = Random(longest)
    for piece in (2, 5, 1 << 17) * 20:
        monkeypatch.setattr(importance, "PIECE", piece)
        texts = ["".join(r.choice(["Ab", "c", "é", " ", ".", "x" * r.randint(1, 100), "12", "_", "Z"]) for _ in range(r.randint(0, 30))) for _ in range(r.randint(1, 9))]
        for part in text_slices(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])])):
            words, entries, bucket, counts = importance.bucket_counts(part.data, part.offsets, 1000, longest)
            ends = np.cumsum(entries)
            for i, text in enumerate(texts):
                w, c = features(text, 1000, longest)
                own = slice(ends[i] - entries[i], ends[i])
                assert words[i] == len(w) and dict(zip(bucket[own].tolist(), counts[own].tolist(), strict=True)) == c


def test_matrix_has_a_row_for_each_document(spark):
    """A reader holds thousands of its rows at once: none is longer than there are buckets, whatever is counted together."""
    docs, rows = documents(spark, 300, 8)
    matrix = importance.count_blocks(docs.coalesce(1), "doc_id", buckets=64, longest=2)
    assert matrix.count() == len(rows) and matrix.agg(F.max(F.size("buckets"))).first()[0] <= 64
    own = [(i, features(t, 64, 2)) for i, t, *_ in rows]
    want = sorted(str((i, len(w), sorted(c.items()))) for i, (w, c) in own)
    assert sorted(str((x.doc_id, x.words, list(zip(x.buckets, x.counts, strict=True)))) for x in matrix.collect()) == want


def test_row_groups_of_the_matrix_are_small(spark, monkeypatch):
    """A reader's batch of rows ends with a row group, so that long documents are few in it."""
    r = Random(9)
    rows = [(i, prose(r, "en", 200)) for i in range(1000)]
    docs, kept = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), []
    monkeypatch.setattr(importance, "GROUP_BYTES", 1 << 16)
    monkeypatch.setattr(importance, "drop", kept.append)
    got = importance.resample(docs, docs.limit(5)).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted((tuple(g) for g in got), key=str) == by_hand(rows, [t for _, t in rows[:5]])
    groups = [m.row_group(i).num_rows for f in Path(kept[0]._factmill_path).glob("*.parquet") for m in [ParquetFile(f).metadata] for i in range(m.num_row_groups)]
    assert sum(groups) == 1000 and max(groups) < 500


def test_query(spark, tmp_path):
    docs, rows = documents(spark, 300, 5)
    r = Random(6)
    target = [prose(r, "fr", 60) for _ in range(10)] + [None, ""]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(target)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = queries.op12_importance_resampling(spark, str(tmp_path))
    assert dict(got.dtypes) == {"doc_id": "bigint", "n_features": "bigint", "weight": "bigint", "score": "bigint", "rank": "bigint"}
    want = by_hand([x[:2] for x in rows], target)
    assert sorted((tuple(g) for g in got.collect()), key=str) == want
    assert max(x[4] or 0 for x in want) > 15


def test_options_and_clashing_names(spark):
    r = Random(7)
    rows = [(i % 50, prose(r, "en", r.randint(0, 30))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("_id", "_at", "_part", "_rank", "words", "ids", "score", "rank", "weight"):
        docs = docs.withColumn(name, F.lit("clash"))
    options = dict(buckets=64, longest=2, percent=50, seed=1)
    got = importance.resample(docs, docs.limit(5), least_words=0, **options)
    plain = by_hand(rows, [t for _, t in rows[:5]], least=0, **options)
    shown = sorted((tuple(g) for g in got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)
    # rows that share id and score may swap ranks
    assert [x[:4] for x in shown] == [x[:4] for x in plain] and sorted(x[4] or 0 for x in shown) == sorted(x[4] or 0 for x in plain)


def test_empty_tables(spark):
    assert importance.resample(empty(spark), empty(spark)).count() == 0
    docs, rows = documents(spark, 40, 3)
    got = importance.resample(docs, empty(spark)).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted((tuple(g) for g in got), key=str) == by_hand([x[:2] for x in rows], [])
