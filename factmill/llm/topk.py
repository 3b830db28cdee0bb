"""Exact top-k by inner product with sorted lists and no random access.

A block of candidates keeps one list per dimension: its components in
descending order, each with the candidate it belongs to.  A query reads its
lists from the end that its own component favours, some entries at a time.
What has been read of a candidate adds to its score; what hasn't is bounded:
an unread component is no better than its list's frontier and no worse than
the list's far end.  So every candidate has a lower and an upper bound, kept
up as entries are read.  A query stops when no candidate beyond those that
hold its ``k`` best lower bounds can still reach the ``k``-th of them; only
the scores of the few that are left are then resolved, by reading on.

Blocks hold vectors of like length, and a query knows from a first look at the
block of the longest vectors what score it has for certain.  A block whose
longest vector is too short to reach that score isn't read for it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut
from .vectors import distinct_vectors, matrix, ranked, usable

#: Candidates and queries of one block, about.
BLOCK_ROWS = 32768
BLOCK_QUERIES = 8192
#: Depths, as shares of a list, at which the bounds are looked at.
DEPTHS = (1 / 8, 3 / 8, 1.0)
#: Rows and queries whose bounds a task holds at once.
_ROWS, _QUERIES = 4096, 256


def exact(queries: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles if these hold every sum of products exactly, else as Python's whole numbers."""
    most = [float(np.abs(x.astype(np.float64)).max(initial=0)) for x in (queries, block)]
    kind = np.float64 if max(1, block.shape[1]) * most[0] * most[1] * 4 < 2.0**53 else object
    return queries.astype(kind), block.astype(kind)


class Lists:
    """A block as sorted lists: for each dimension the candidates in descending order of their component, and these components."""

    def __init__(self, block: np.ndarray):
        self.n, self.size = block.shape
        self.order = np.argsort(-block, axis=0, kind="stable").T
        self.values = np.take_along_axis(block.T, self.order, axis=1)
        self.worst, self.best = self.values[:, -1], self.values[:, 0]
        self._steps: dict = {}

    def step(self, read: int, reach: int) -> tuple[np.ndarray, ...]:
        """What reading on from ``read`` to ``reach`` entries says of each candidate, from a list's top and from its end.

        How much better than the list's far end its component is, where it
        was read in this step, and where it is still unread after it.  A
        step is made once for all queries that take it.
        """
        if (read, reach) not in self._steps:
            d, made = np.arange(self.size)[:, None], []
            for entries, far, seen in ((slice(read, reach), self.worst, slice(0, reach)), (slice(self.n - reach, self.n - read), self.best, slice(self.n - reach, self.n))):
                gain = np.zeros((self.n, self.size), self.values.dtype)
                gain[self.order[:, entries], d] = self.values[:, entries] - far[:, None]
                unread = np.ones((self.n, self.size))
                unread[self.order[:, seen], d] = 0
                made += [gain, unread]
            self._steps[read, reach] = tuple(made)
        return self._steps[read, reach]


def no_random_access(queries: np.ndarray, lists: Lists, k: int, depths: tuple = DEPTHS) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """For each query, candidates that hold its ``k`` best (and all ties), their exact scores, and how deep its lists were read."""
    n, values = lists.n, lists.values
    done: list = [None] * len(queries)
    active, read = np.arange(len(queries)), 0
    # a query reads from the top where its component is positive, from the end where it is negative
    plus, minus = np.where(queries > 0, queries, 0).T, np.where(queries < 0, queries, 0).T
    # nothing read: every component is as bad as its list allows
    lower = np.repeat((plus * lists.worst[:, None] + minus * lists.best[:, None]).sum(0)[None], n, axis=0)
    for depth in depths:
        reach = max(read, min(n, int(np.ceil(depth * n))))
        top, unread_top, end, unread_end = lists.step(read, reach)
        lower = lower + top @ plus + end @ minus
        read, upper = reach, lower
        if read < n:
            # what is unread is no better than the frontier
            upper = lower + unread_top @ ((values[:, read - 1] - lists.worst)[:, None] * plus) + unread_end @ ((values[:, n - read] - lists.best)[:, None] * minus)
        kth = np.partition(lower, n - k, axis=0)[n - k] if n > k else np.full(len(active), -np.inf)
        in_play = upper >= kth
        stop = (in_play.sum(0) <= 4 * k) | (read == n)
        for i in np.flatnonzero(stop):
            rows = np.flatnonzero(in_play[:, i])
            done[active[i]] = (rows, _resolved(lists, queries[active[i]], rows, lower[rows, i], read), read)
        active, lower, plus, minus = active[~stop], lower[:, ~stop], plus[:, ~stop], minus[:, ~stop]
        if not len(active):
            break
    return done


def _resolved(lists: Lists, query: np.ndarray, rows: np.ndarray, lower: np.ndarray, read: int) -> np.ndarray:
    """The scores of the candidates that are left: lists are read on, and what belongs to others is passed over."""
    place = np.full(lists.n, -1)
    place[rows] = np.arange(len(rows))
    score = lower.copy()
    for d in np.flatnonzero(query != 0) if read < lists.n else ():
        rest = slice(read, None) if query[d] > 0 else slice(None, lists.n - read)
        at = place[lists.order[d, rest]]
        far = lists.worst[d] if query[d] > 0 else lists.best[d]
        # a candidate stands in a list once
        score[at[at >= 0]] += (lists.values[d, rest][at >= 0] - far) * query[d]
    return score


def _searched(mine: pa.Table, asked: pa.Table, k: int, depths: tuple) -> pa.Table:
    """Each query's best among a block's vectors, each of which stands for several ids, and the entries read of a list."""
    query_ids, rows, scores, reads = [], [], [], []
    if mine.num_rows and asked.num_rows:
        whole, asking = matrix(mine.column("v"), np.int64), matrix(asked.column("v"), np.int64)
        asking, whole = exact(asking, whole)
        ids_of = asked.column("vec_id").to_numpy()
        for at in range(0, len(whole), _ROWS):
            lists = Lists(whole[at : at + _ROWS])
            ids = mine.column("ids").slice(at, _ROWS).combine_chunks()
            first, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
            for q in range(0, len(asking), _QUERIES):
                # the k best vectors and the own one hold the k best rows
                found = no_random_access(asking[q : q + _QUERIES], lists, k + 1, depths)
                for query, (near, score, read) in zip(ids_of[q : q + _QUERIES], found, strict=True):
                    size = first[near + 1] - first[near]
                    place = np.repeat(first[near] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                    vec, score = flat[place], np.repeat(score, size)
                    score = np.array([int(x) for x in score], np.int64)  # fails where a score doesn't fit
                    other = vec != query
                    vec, score = vec[other], score[other]
                    best = np.lexsort((vec, -score))[:k]
                    query_ids.append(np.full(len(best) + 1, query))
                    # a row of its own, without a vector, for what was read
                    rows.append(np.append(vec[best], 0))
                    scores.append(np.append(score[best], 0))
                    reads.append(np.append(np.full(len(best), -1), read))
    flat_of = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
    read, of = flat_of(reads), lambda x, kept: pa.array(flat_of(x), mask=~kept)
    return pa.table({"query_id": flat_of(query_ids), "vec_id": of(rows, read < 0), "score": of(scores, read < 0), "read": of(reads, read >= 0)})


def _norm(v: str) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def _whole(vectors: DataFrame, scale: int) -> DataFrame:
    """``vec_id, v``: vectors of whole numbers; one beyond 62 bits fails."""
    big = F.raise_error(F.lit("a component is too large for a 64-bit whole number")).cast("long")
    part = lambda x: F.when(F.abs(x * F.lit(float(scale))) < F.lit(2.0**62), F.floor(x * F.lit(float(scale))).cast("long")).otherwise(big)
    return usable(vectors).select("vec_id", F.transform("v", part).alias("v")).where(F.size("v") > 0)


def _found(vectors: DataFrame, k: int, query_mod: int, scale: int, block_rows: int, block_queries: int, depths: tuple) -> tuple[DataFrame, DataFrame]:
    """``query_id, vec_id, score, read``: what each block gives a query, and rows that say how much was read of it; and the candidates."""
    whole = cut(_whole(vectors, scale))
    queries = whole.where(F.col("vec_id") % query_mod == 0)
    # vectors of like length are a class: four classes to a doubling, a few dozen in all
    kind = F.coalesce(F.floor(F.log2(F.nullif(F.col("norm"), F.lit(0.0))) * 4), F.lit(-1)).cast("int")
    # one id more than asked for: a query's own id may be among them
    candidates = distinct_vectors(whole, k + 1).withColumns({"size": F.size("v"), "norm": _norm("v")})
    candidates = cut(candidates.withColumn("class", kind))
    classes = candidates.groupBy("size", "class").agg(F.count("*").alias("n"), F.max("norm").alias("longest")).toPandas()
    # every core gets some blocks, and no block is larger than the bound
    each = min(block_rows, max(256, -(-int(classes["n"].sum()) // vectors.sparkSession.sparkContext.defaultParallelism)))
    parts = max(1, -(-queries.count() // block_queries))
    table = [(int(s), int(c), max(1, -(-int(n) // each)), float(longest)) for s, c, n, longest in classes.itertuples(index=False)]
    blocks = vectors.sparkSession.createDataFrame(table, "size int, class int, blocks int, longest double")
    key = ["size", "class", "block", "part"]
    left = candidates.join(F.broadcast(blocks.drop("longest")), ["size", "class"]).withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))
    left = left.select("size", "class", "block", "v", "ids", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    right = queries.select("vec_id", "v", F.size("v").alias("size"), _norm("v").alias("norm"), F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("part"))

    def search(mine: DataFrame, asked: DataFrame) -> DataFrame:
        return mine.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(lambda a, b: _searched(a, b, k, depths), "query_id bigint, vec_id bigint, score bigint, read bigint")

    # first a block of the longest vectors: it gives every query a score that it reaches for certain
    top = F.broadcast(blocks.groupBy("size").agg(F.max("class").alias("class")).withColumn("block", F.lit(0)))
    first = cut(search(left.join(top, ["size", "class", "block"]), right.join(top, "size").select("vec_id", "v", *key)))
    sure = ranked(first.where(F.col("vec_id").isNotNull()), k, [F.desc("score")]).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("_sure"))
    # then every block that may hold as high a score: no product is larger than that of the lengths
    may = right.join(sure, "vec_id", "left").join(F.broadcast(blocks), "size").where(F.col("_sure").isNull() | (F.col("norm") * F.col("longest") * F.lit(1 + 1e-9) >= F.col("_sure")))
    may = may.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(top, ["size", "class", "block"], "left_anti")
    return first.unionByName(search(left.join(top, ["size", "class", "block"], "left_anti"), may.select("vec_id", "v", *key))), candidates


def top_inner_products(vectors: DataFrame, k: int = 5, query_mod: int = 50, scale: int = 256, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES, depths: tuple = DEPTHS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` highest integer inner products of each query.

    Components become ``floor(scale * x)``.  Queries are the rows whose id is
    divisible by ``query_mod``, candidates all rows but the query's own; ties
    go to the smaller id, and a query with fewer candidates gets all of them.

    Vectors that are null, empty or hold null or non-finite components take
    no part, nor do rows without an id; of rows that share an id the smallest
    vector counts.  Vectors of different lengths don't meet.  Components and
    scores that don't fit 64 bits are an error.  An empty table gives no
    rows; other columns are ignored.
    """
    found, _ = _found(vectors, k, query_mod, scale, block_rows, block_queries, depths)
    return ranked(found.where(F.col("vec_id").isNotNull()), k, [F.desc("score")])


def shares_read(vectors: DataFrame, k: int = 5, query_mod: int = 50, scale: int = 256, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES, depths: tuple = DEPTHS) -> DataFrame:
    """``query_id, share``: how much of all candidates' lists a query read before it could stop."""
    found, candidates = _found(vectors, k, query_mod, scale, block_rows, block_queries, depths)
    return found.groupBy("query_id").agg((F.sum("read") / F.lit(float(max(1, candidates.count())))).alias("share"))
