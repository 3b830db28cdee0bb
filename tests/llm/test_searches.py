"""Vector searches and packing against brute force."""

import itertools
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from factmill.llm import ann, packing, topk

from .helpers import documents, empty

DATA = os.environ.get("FACTMILL_DATA", "/root/testdata")
VECTORS = "vec_id long, embedding array<float>, label int, score string"


def vectors(spark, n=400, size=8, seed=0):
    random = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in random.normal(size=size).astype(np.float32)], 0, "clash") for i in range(n)]
    # a vector with very many copies, and two that tie
    rows += [(1000 + i, rows[3][1], 1, None) for i in range(150)] + [(2000, rows[5][1], 1, None)]
    odd = [(3000, None), (3100, []), (3200, [None] * size), (3300, [float("nan")] * size), (3400, [float("inf")] * size), (None, rows[0][1]), (3500, [0.0] * size), (4000, [1.0, 2.0])]
    rows += [(i, v, None, None) for i, v in odd] + [rows[7]]
    return spark.createDataFrame(rows, VECTORS).repartition(4), rows


def usable(rows, nonzero=False):
    good = {}
    for i, v, *_ in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and not (nonzero and not any(v)):
            good[i] = np.array(v, np.float64)
    return good


def test_top_k(spark):
    table, rows = vectors(spark)
    whole = {i: np.floor(256 * v).astype(np.int64) for i, v in usable(rows).items()}
    want = set()
    for q, x in whole.items():
        if q % 50 == 0:
            best = sorted((-int(x @ y), i) for i, y in whole.items() if i != q and len(x) == len(y))[:5]
            want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    for sizes in ({}, {"block_rows": 30, "block_queries": 3}):
        got = topk.top_inner_products(table, **sizes)
        assert {tuple(r) for r in got.collect()} == want
    assert topk.top_inner_products(spark.createDataFrame([], VECTORS)).count() == 0


def test_bounds_hold():
    random = np.random.default_rng(1)
    block, queries = random.integers(-300, 300, (500, 16)), random.integers(-300, 300, (20, 16))
    queries[3] = 0
    for kind in (np.float64, object):
        for q, (near, score, read) in zip(queries, topk.no_random_access(queries.astype(kind), topk.Lists(block.astype(kind)), 4), strict=True):
            exact = block @ q
            assert (score == exact[near]).all() and 0 < read <= 500
            assert set(np.flatnonzero(exact >= np.sort(exact)[-4])) <= set(near)
    huge = block.astype(np.int64) << 40
    assert topk.exact(huge, huge)[0].dtype == object and topk.exact(block, queries)[0].dtype == np.float64


def test_stops_early(spark):
    """Where a few components decide, few entries are read, and short vectors aren't looked at."""
    random = np.random.default_rng(5)
    rows = [(i, [float(x) for x in random.normal(size=6) * np.array([1000, 300, 1, 1, 0.5, 0.5]) * (0.001 if i % 3 else 1)], 0, None) for i in range(1500)]
    table = spark.createDataFrame(rows, VECTORS).repartition(4)
    whole = np.floor(256 * np.array([np.array(v, np.float32) for _, v, *_ in rows], np.float64)).astype(np.int64)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_inner_products(table, block_rows=400).collect()}
    for q in range(0, 1500, 50):
        best = sorted((-int(whole[q] @ whole[i]), i) for i in range(1500) if i != q)[:5]
        assert [got[q, r + 1] for r in range(5)] == [(i, -s) for s, i in best]
    shares = [r["share"] for r in topk.shares_read(table, block_rows=400).collect()]
    assert len(shares) == 30 and np.median(shares) < 0.5 and max(shares) < 0.9
    # scores beyond 64 bits are an error, not a wrong number
    wide = spark.createDataFrame([(i, [1e16, 1e16], 0, None) for i in (0, 1)], "vec_id long, embedding array<double>, label int, score string")
    with pytest.raises(Exception, match="(?i)overflow|too large"):
        topk.top_inner_products(wide).collect()


def test_neighbours(spark):
    table, rows = vectors(spark, 600, 16)
    good = usable(rows, nonzero=True)
    want = {}
    for q, x in good.items():
        if q % 100 == 0:
            want[q] = sorted((float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in good.items() if i != q and len(x) == len(y))[:10]
    got = {}
    for r in ann.nearest_neighbours(table).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(got[r["query_id"]])
    assert {q: len(x) for q, x in got.items()} == {q: len(x) for q, x in want.items() if x}
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in got)
    assert hits / sum(len(x) for x in got.values()) >= 0.9
    for q, found in got.items():
        assert found == sorted(found)
        for score, i in found:
            assert score == pytest.approx(float(np.sqrt(((good[q] - good[i]) ** 2).sum())))
    # with few probes some queries must see all candidates
    few = ann.nearest_neighbours(table, setting=ann.Setting(1, 4, 0.2, 1))
    assert few.groupBy("query_id").count().where("count < 10").count() == 0
    assert ann.nearest_neighbours(spark.createDataFrame([], VECTORS)).count() == 0


def test_recall_on_the_shipped_table(spark):
    """64 dimensions, near-uniform: recall, and that blocks of rows and of queries change nothing."""
    table = spark.read.parquet(f"{DATA}/sf0.01/embeddings.parquet")
    good = usable([(r["vec_id"], r["embedding"]) for r in table.collect()], nonzero=True)
    ids, v = np.array(list(good)), np.array(list(good.values()))
    got = {}
    rows = ann.nearest_neighbours(table).collect()
    for r in rows:
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = total = 0
    for q in (i for i in good if i % 100 == 0):
        order = np.lexsort((ids, ((v - good[q]) ** 2).sum(1)))
        near = [int(i) for i in ids[order] if i != q][:10]
        hits, total = hits + len(got[q] & set(near)), total + len(near)
    assert hits / total >= 0.9
    again = ann.nearest_neighbours(table, part_rows=40, part_queries=2).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_probes_in_order():
    """The likeliest buckets come first: against all steps of one, ranked one by one."""
    random = np.random.default_rng(7)
    for hashes in (2, 3):
        at = random.uniform(-3, 3, (20, 2, hashes))
        for row, codes in zip(at, ann.probe_codes(at, 6), strict=True):
            for position, found in zip(row, codes, strict=True):
                cell = np.floor(position)
                ranked = sorted((sum((p - c) ** 2 if s < 0 else (1 - p + c) ** 2 if s else 0 for s, p, c in zip(step, position, cell, strict=True)), step) for step in itertools.product((-1, 0, 1), repeat=hashes))
                assert list(found) == [ann.bucket_codes(cell + np.array(step)) for _, step in ranked[:6]]


def brute_fit(pieces, capacity):
    bins, out = [], []
    for size, source, cluster in pieces:
        fits = [(left, b) for b, (left, s, c) in enumerate(bins) if left >= size and source not in s - {-1} and cluster not in c - {-1}]
        b = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append((capacity, set(), set()))
        left, s, c = bins[b]
        bins[b] = (left - size, s | {source}, c | {cluster})
        out.append(b)
    return out


def test_best_fit():
    random = np.random.default_rng(2)
    for _ in range(20):
        pieces = [(int(a), int(b), int(c)) for a, b, c in zip(np.sort(random.integers(1, 100, 200))[::-1], random.integers(-1, 6, 200), random.integers(-1, 40, 200), strict=True)]
        assert packing.best_fit(pieces, 100) == brute_fit(pieces, 100)


def test_packing(spark):
    docs, rows = documents(spark, 300, 3, [(800, "same text here", None, "b", None, None, None), (801, "same text here", None, "a", None, None, None)])
    packed = packing.pack_documents(docs, capacity=64, group_rows=50)
    got = packed.collect()
    words = sum(len((r[1] or "").split()) for r in rows)
    assert sum(g["n_words"] for g in got) == words
    bins = {}
    for g in got:
        assert 0 <= g["n_words"] <= 64
        assert (g["bin_id"] is None) == (g["n_words"] == 0)
        bins.setdefault(g["bin_id"], []).append(g)
    text_of = {r[0]: r[1] for r in rows}
    for b, own in bins.items():
        if b is not None:
            assert sum(g["n_words"] for g in own) == own[0]["bin_words"] <= 64
            sources, texts = [g["source"] for g in own if g["source"] is not None], [text_of[g["doc_id"]] for g in own]
            assert len(set(sources)) == len(sources) and len(set(texts)) == len(texts)
    assert len({(g["doc_id"], g["copy"], g["piece"]) for g in got}) == len(got)
    assert packed.where(F.col("doc_id").isNull()).count() == 1
    assert packing.pack_documents(empty(spark)).count() == 0


def clustered(n, size=16):
    """Groups of forty near vectors."""
    random = np.random.default_rng(5)
    return np.repeat(random.normal(size=(n // 40, size)), 40, axis=0) + 0.1 * random.normal(size=(n // 40 * 40, size))


def test_rows_met_grow_slower_than_the_table():
    """Four times the rows, in as large clusters: the settings chosen by true neighbours reach them in less than twice the rows."""
    met = []
    for n in (10_000, 40_000):
        v = clustered(n)
        sample, asked = v[:: n // 4000], v[:: n // 100]
        near = [v[found[0]] for found in ann.nearest(asked, v, 10)]
        setting = ann.tuned(sample, asked, near, n)
        functions = ann.Hashes(16, ann.spread(sample), setting)
        own, probed = ann.bucket_codes(np.floor(functions.positions(v))), ann.probe_codes(functions.positions(asked), setting.probes)
        seen = np.stack([np.isin(own[:, t], codes[t]) for codes in probed for t in range(setting.tables)]).reshape(len(asked), setting.tables, -1).any(1)
        hits = [np.mean([seen[q, i] for i in ann.nearest(asked[q : q + 1], v, 11)[0][0]]) for q in range(len(asked))]
        assert np.mean(hits) >= 0.9
        met.append(seen.sum(1).mean())
    assert met[1] < 2 * met[0] and met[1] < 0.05 * 40_000


def test_true_neighbours(spark):
    """One pass over rows in any partitions finds what a sort of all distances finds; equal vectors are left out."""
    v = np.random.default_rng(3).normal(size=(300, 4))
    v[7] = v[3]
    rows = spark.createDataFrame([(4, [float(c) for c in x]) for x in v] + [(2, [1.0, 2.0])], "size int, v array<double>").repartition(5)
    asked = {4: v[[3, 50]], 2: np.array([[1.0, 2.0]])}
    got = ann.true_neighbours(rows, asked, 5)
    for q, near in zip(asked[4], got[4], strict=True):
        apart = ((v - q) ** 2).sum(1)
        want = v[[i for i in np.argsort(apart) if apart[i] > 0][:5]]
        assert sorted(map(tuple, near)) == sorted(map(tuple, want))
    assert len(got[2][0]) == 0
