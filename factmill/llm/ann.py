"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table has a few hash functions ``floor((a . x + b) / w)`` with normal
``a``; their values together name a bucket.  A query visits its own bucket
and those one step away, in the order of how likely a neighbour lies there,
which falls with the summed squared distances to the crossed borders.  All
candidates in the visited buckets are ranked by their exact distance.

How many hash functions, how wide, and how many probes is tried out: one
pass over all rows finds the true neighbours of a few sampled vectors, and of
the settings that reach the wanted share of them the one is taken that meets
fewest rows, counted on a bounded sample and projected to the table's size.
More hash functions are tried for larger tables, so that buckets needn't grow
with them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded_sample, cut, drop, small_or_not
from .vectors import distinct_vectors, matrix, ranked, usable

#: Share of the sample's nearest neighbours that a setting must find.
RECALL = 0.95
#: Rows that the settings are tried on, at most, and how many of them ask (one at least of each length); every row is indexed.
FIT_ROWS, FIT_QUERIES = 4000, 200
#: Hash functions beyond eight are tried up to the logarithm of the number of rows.
TABLES, HASHES, WIDTHS, PROBES = (2, 3), (2, 3, 4, 6, 8, 12, 16), (0.5, 1.0, 2.0, 4.0), (1, 2, 4, 8, 16, 32)
#: What a visit to a bucket costs, in rows.
PROBE_COST = 16
#: Larger buckets are dealt into parts of about so many rows, and their queries into parts of theirs.
PART_ROWS, PART_QUERIES = 4096, 1024


class Setting(NamedTuple):
    tables: int
    hashes: int
    width: float
    probes: int


class Hashes:
    """The tables' hash functions for vectors of one length; ``scale`` is the spread of a projection."""

    def __init__(self, size: int, scale: float, setting: Setting, seed: int = 23):
        random, (tables, hashes, width, _) = np.random.default_rng([seed, size]), setting
        self.tables, self.hashes = tables, hashes
        self.direction = random.normal(size=(size, tables * hashes)) / (scale * width)
        self.shift = random.uniform(0, 1, tables * hashes)

    def positions(self, v: np.ndarray) -> np.ndarray:
        return (v @ self.direction + self.shift).reshape(len(v), self.tables, self.hashes)


def bucket_codes(cells: np.ndarray) -> np.ndarray:
    """One number for each row of hash values."""
    code = np.zeros(cells.shape[:-1], np.int64)
    for i in range(cells.shape[-1]):
        code = code * np.int64(1_000_003) + cells[..., i].astype(np.int64)
    return code


@cache
def _steps(hashes: int) -> np.ndarray:
    """Moves to buckets one step away in at most four hashes: further ones are never among the likeliest."""
    moves = [np.zeros((1, hashes), int)]
    for n in range(1, min(hashes, 4) + 1):
        for at in combinations(range(hashes), n):
            signs = np.array(list(product((-1, 1), repeat=n)))
            part = np.zeros((len(signs), hashes), int)
            part[:, at] = signs
            moves.append(part)
    return np.concatenate(moves)


def probe_codes(positions: np.ndarray, probes: int) -> np.ndarray:
    """Codes of the first ``probes`` buckets of each row and table, likeliest first."""
    steps = _steps(positions.shape[-1])
    # many hash functions have many buckets one step away: so many rows at once that their sums stay small
    at_once = max(1, 2**21 // (positions.shape[1] * len(steps)))
    if len(positions) > at_once:
        return np.concatenate([probe_codes(positions[low : low + at_once], probes) for low in range(0, len(positions), at_once)])
    cells = np.floor(positions)
    inside = positions - cells
    down, up = (steps < 0).astype(float), (steps > 0).astype(float)
    total = inside**2 @ down.T + (1 - inside) ** 2 @ up.T
    few = np.argpartition(total, min(probes, total.shape[-1]) - 1, axis=-1)[..., :probes]
    order = np.take_along_axis(few, np.argsort(np.take_along_axis(total, few, -1), axis=-1, kind="stable"), -1)
    return bucket_codes(cells[..., None, :] + steps[order])


def spread(v: np.ndarray) -> float:
    """Root of the summed variances."""
    return float(np.sqrt(np.var(v, axis=0).sum())) or 1.0


def tuned(v: np.ndarray, asked: np.ndarray, near: list[np.ndarray], rows: int, recall: float = RECALL) -> Setting:
    """The setting that finds the share ``recall`` of the neighbours and costs least in a table of so many ``rows``.

    ``v`` is a sample, which says what share of all rows a probe meets;
    ``near`` holds the true neighbours of each of ``asked``.
    """
    scale, most_hashes = spread(v), max(8, int(np.ceil(np.log2(max(rows, 1)))))
    of = np.repeat(np.arange(len(near)), [len(x) for x in near])
    wanted = np.concatenate([v[:0], *near])
    best, least, fallback, most = None, np.inf, None, -1.0
    for tables, hashes, width in product(TABLES, [h for h in HASHES if h <= most_hashes], WIDTHS):
        setting = Setting(tables, hashes, width, max(PROBES))
        functions = Hashes(v.shape[1], scale, setting)
        code = lambda x: bucket_codes(np.floor(functions.positions(x)))  # noqa: E731, B023
        own, target, probed = np.sort(code(v), axis=0), code(wanted), probe_codes(functions.positions(asked), max(PROBES))
        # of the sample, how many rows each probe meets; and which probe is the first to meet a neighbour
        met = np.stack([np.searchsorted(own[:, t], probed[:, t], "right") - np.searchsorted(own[:, t], probed[:, t]) for t in range(tables)], 1)
        hit = probed[of] == target[:, :, None]
        for probes in (p for p in PROBES if p <= probed.shape[2]):
            found = hit[:, :, :probes].any((1, 2)).mean() if len(of) else 1.0
            cost = met[:, :, :probes].sum() / (len(asked) * len(v)) * rows + PROBE_COST * tables * probes
            if found >= recall and cost < least:
                best, least = setting._replace(probes=probes), cost
            if found > most:
                fallback, most = setting._replace(probes=probes), found
    return best or fallback


def true_neighbours(candidates: DataFrame, asked: dict[int, np.ndarray], k: int) -> dict[int, list[np.ndarray]]:
    """The ``k`` vectors nearest to each of a few, by length, among all ``candidates`` but equal ones: one pass, in which a task keeps the best it saw."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {size: (np.full((len(q), k), np.inf), np.zeros((len(q), k, size))) for size, q in asked.items()}
        for batch in batches:
            sizes = batch.column(batch.schema.get_field_index("size")).to_numpy()
            for size in set(np.unique(sizes).tolist()) & set(asked):
                rows, q = matrix(batch.filter(pa.array(sizes == size)).column(batch.schema.get_field_index("v"))), asked[size]
                for low in range(0, len(rows), 4096):
                    block, (old, vectors) = rows[low : low + 4096], best[size]
                    weight = (block**2).sum(1) + (q**2).sum(1)[:, None]
                    apart = weight - 2 * (q @ block.T)
                    apart[apart <= 1e-9 * weight] = np.inf
                    few = np.argpartition(apart, min(k, len(block)) - 1, axis=1)[:, :k]
                    both = np.concatenate([old, np.take_along_axis(apart, few, 1)], 1)
                    keep = np.argpartition(both, k - 1, axis=1)[:, :k]
                    best[size] = np.take_along_axis(both, keep, 1), np.take_along_axis(np.concatenate([vectors, block[few]], 1), keep[..., None], 1)
        for size, (apart, vectors) in best.items():
            at = np.argwhere(apart < np.inf)
            if len(at):
                chosen = vectors[at[:, 0], at[:, 1]]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * size), pa.array(chosen.reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), size, np.int32)), pa.array(at[:, 0].astype(np.int32)), pa.array(apart[at[:, 0], at[:, 1]]), lists], names=["size", "asked", "apart", "v"])

    seen = candidates.select("size", "v").mapInArrow(scan, "size int, asked int, apart double, v array<double>")
    order = Window.partitionBy("size", "asked").orderBy("apart", "v")
    out = {size: [np.zeros((0, size)) for _ in q] for size, q in asked.items()}
    for row in seen.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k).groupBy("size", "asked").agg(F.collect_list("v").alias("near")).toArrow().to_pylist():
        out[row["size"]][row["asked"]] = np.array(row["near"])
    return out


def nearest(queries: np.ndarray, block: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query, rows of ``block`` that hold its ``k`` nearest (and all ties), and their distances."""
    size = (block**2).sum(1)
    rough = size - 2 * (queries @ block.T) + (queries**2).sum(1)[:, None]
    if len(block) > k:
        limit = np.partition(rough, k - 1, axis=1)[:, k - 1]
    else:
        limit = np.full(len(queries), np.inf)
    slack = 1e-9 * (1 + size.max(initial=0) + (queries**2).sum(1))
    out = []
    for q, r, most in zip(queries, rough, limit + slack, strict=True):
        near = np.flatnonzero(r <= most)
        out.append((near, np.sqrt(((block[near] - q) ** 2).sum(1))))
    return out


def nearest_neighbours(vectors: DataFrame, k: int = 10, query_mod: int = 100, recall: float = RECALL, setting: Setting | None = None, part_rows: int = PART_ROWS, part_queries: int = PART_QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each query, by Euclidean distance.

    Queries are the rows whose id is divisible by ``query_mod``, candidates
    all rows but the query's own; ties go to the smaller id.

    Vectors that are null, empty, zero or hold null or non-finite components
    take no part, nor do rows without an id; of rows that share an id the
    smallest vector counts.  Vectors of different lengths don't meet.  A
    query may find fewer than ``k`` if the visited buckets hold fewer; it
    then visits all buckets, so that it gets ``k`` or all candidates.  An
    empty table gives no rows; other columns are ignored.
    """
    whole = cut(usable(vectors, nonzero=True, narrow=True).withColumn("size", F.size("v")))
    samples: dict[int, list] = {}
    for row in bounded_sample(whole, "vec_id", FIT_ROWS, 31).toArrow().column("v").to_pylist():
        samples.setdefault(len(row), []).append(row)
    samples = {n: np.array(v) for n, v in samples.items()}
    candidates = cut(distinct_vectors(whole.select("vec_id", "v"), k + 1).withColumn("size", F.size("v")))
    chosen = dict.fromkeys(samples, setting)
    if setting is None and samples:
        total = sum(map(len, samples.values()))
        asked = {n: v[np.unique(np.linspace(0, len(v) - 1, max(1, min(len(v), FIT_QUERIES * len(v) // total))).astype(int))] for n, v in samples.items()}
        near, rows_of = true_neighbours(candidates, asked, k), dict(candidates.groupBy("size").count().where(F.col("size").isin(list(samples))).toArrow().to_pandas().itertuples(index=False))
        chosen = {n: tuned(v, asked[n], near[n], int(rows_of[n]), recall) for n, v in samples.items()}
    fitted = {n: (spread(v), chosen[n]) for n, v in samples.items()}
    usual = setting or max(fitted.values(), default=(1.0, Setting(2, 4, 2.0, 8)), key=lambda x: x[1].probes)[1]
    make = lambda size: (Hashes(size, *fitted.get(size, (1.0, usual))), fitted.get(size, (1.0, usual))[1])
    queries = whole.where(F.col("vec_id") % query_mod == 0)
    kind = whole.schema["v"].dataType.simpleString()

    def hash_rows(batches: Iterator[pa.RecordBatch], probing: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(batch.schema.get_field_index("size")).to_numpy()
            for size in np.unique(sizes):
                rows = batch.filter(pa.array(sizes == size))
                hashes, own = make(int(size))
                at = hashes.positions(matrix(rows.column(rows.schema.get_field_index("v"))))
                codes = probe_codes(at, own.probes) if probing else bucket_codes(np.floor(at))[..., None]
                n, count = len(rows), codes.shape[1] * codes.shape[2]
                table = np.tile(np.repeat(np.arange(own.tables, dtype=np.int32), codes.shape[2]), n)
                for low in range(0, n, 1024):
                    repeated = rows.slice(low, 1024).take(pa.array(np.repeat(np.arange(min(1024, n - low)), count)))
                    part = slice(low * count, (low + len(repeated) // count) * count)
                    yield pa.RecordBatch.from_arrays([*repeated.columns, pa.array(table[part]), pa.array(codes.reshape(-1)[part])], names=[*repeated.schema.names, "table", "bucket"])

    left = candidates.mapInArrow(lambda b: hash_rows(b, False), f"v {kind}, ids array<bigint>, size int, table int, bucket bigint")
    right = queries.mapInArrow(lambda b: hash_rows(b, True), f"vec_id bigint, v {kind}, size int, table int, bucket bigint")
    left, right = cut(left), cut(right)
    cell = ["size", "table", "bucket"]
    # of all buckets only those count that are too large for one task, for their rows or for their queries: few enough to look up anywhere
    large = lambda rows, most, name: small_or_not(rows.groupBy(*cell).count().where(F.col("count") > most).select(*cell, F.ceil(F.col("count") / F.lit(most)).cast("int").alias(name)), 64)
    parts, turns = large(left, part_rows, "parts"), large(right, part_queries, "turns")

    def dealt(rows: DataFrame, name: str, mine: str, other: str) -> DataFrame:
        split = rows.join(parts, cell, "left").join(turns, cell, "left").na.fill(1, ["parts", "turns"])
        every = F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1))
        return split.withColumn(mine, F.pmod(F.xxhash64(name), F.col(f"{mine}s")).cast("int")).withColumn(other, every).drop("parts", "turns")

    key = [*cell, "part", "turn"]
    mine, asked = dealt(left, "v", "part", "turn"), dealt(right, "vec_id", "turn", "part")
    found = mine.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(lambda a, b: _search(a, b, k), "query_id bigint, vec_id bigint, score double")
    found = cut(ranked(found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")), k, [F.asc("score")]))
    drop(left, right)
    # what the visited buckets couldn't fill: these queries see all candidates, in blocks
    got = found.groupBy("query_id").count()
    everyone = candidates.groupBy("size").agg(F.sum(F.size("ids")).alias("_rows"))
    short = queries.join(got, F.col("vec_id") == F.col("query_id"), "left").join(everyone, "size")
    short = cut(short.where(F.coalesce("count", F.lit(0)) < F.least(F.lit(k), F.col("_rows") - 1)).select("vec_id", "v", "size"))
    if not (n := short.count()):
        return found
    blocks, turn = max(1, -(-candidates.count() // part_rows)), max(1, -(-n // part_queries))
    of = lambda rows, by, count: rows.withColumn("part" if by == "v" else "turn", F.pmod(F.xxhash64(by), F.lit(count)).cast("int"))
    to = lambda rows, name, count: rows.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    key = ["size", "part", "turn"]
    mine, asked = to(of(candidates, "v", blocks), "turn", turn), to(of(short, "vec_id", turn), "part", blocks)
    more = mine.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(lambda a, b: _search(a, b, k), "query_id bigint, vec_id bigint, score double")
    more = ranked(more, k, [F.asc("score")])
    return found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(more)


def _search(mine: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    """The ``k`` best rows of each query among a part's vectors, each of which stands for several ids."""
    query_ids, rows, scores = [], [], []
    if mine.num_rows and asked.num_rows:
        ids = mine.column("ids").combine_chunks()
        first, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
        found = nearest(matrix(asked.column("v")), matrix(mine.column("v")), k + 1)
        for query, (near, distance) in zip(asked.column("vec_id").to_pylist(), found, strict=True):
            size = first[near + 1] - first[near]
            at = np.repeat(first[near] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            vec, distance = flat[at], np.repeat(distance, size)
            other = vec != query
            vec, distance = vec[other], distance[other]
            best = np.lexsort((vec, distance))[:k]
            query_ids.append(np.full(len(best), query))
            rows.append(vec[best])
            scores.append(distance[best])
    whole = lambda x, kind: pa.array(np.concatenate(x).astype(kind) if x else np.zeros(0, kind))
    return pa.table({"query_id": whole(query_ids, np.int64), "vec_id": whole(rows, np.int64), "score": whole(scores, np.float64)})
