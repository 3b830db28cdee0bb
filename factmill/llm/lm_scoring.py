"""LM scoring by partial matching: byte contexts, escapes and exclusion.

Fitting is one distributed pass over all texts: tasks count words and byte
n-grams, Spark adds the counts up.  Every context of up to ``MAX_ORDER`` bytes
that training texts hold is part of the model, however rare.  Contexts of up
to ``BASE_ORDER`` bytes are a trie, bounded by the number of byte triples;
longer ones are dealt out by their nearest bytes, so that a task has an n-gram
and all its shorter forms at hand and gives each its log probability.

Scoring adds up the log probabilities of a text's n-grams.  The ``HOT_GRAMS``
most frequent ones are broadcast as a cache; all others are joined.

The word baseline needs the count of every token.  Words above a count that
at most ``HOT_WORDS`` words reach are broadcast; all others are joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, SLICE_BYTES, Counts, count_sorted, crc_of, cut, hash_words, mix, text_slices, word_bounds, word_pieces

#: With the next byte at most 8 bytes, the key of an n-gram.
MAX_ORDER = 5
BASE_ORDER = 2
HOT_WORDS = 1 << 18
HOT_GRAMS = 1 << 20
#: Rows that a task of the model takes at once, besides the rest of a group.
CHUNK = 1 << 18
#: Stands before a text and after it; no UTF-8 text holds it.
EDGE = 0xFF
#: The token that ends each text, as a hash of its own.
END_TOKEN = np.uint64(0x51A7E0F7EC7)


def padded(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case texts with ``order`` edges before and one after each.

    Also gives the positions to predict (all bytes and the closing edge) and
    the row bounds within these positions.
    """
    n = len(offsets) - 1
    spread = np.full(len(data) + (order + 1) * n, EDGE, np.uint8)
    rows = np.repeat(np.arange(n), np.diff(offsets))
    spread[np.arange(len(data)) + (order + 1) * rows + order] = LOWER[data]
    ask = np.ones(len(spread), dtype=bool)
    heads = offsets[:-1] + (order + 1) * np.arange(n)
    for i in range(order):
        ask[heads + i] = False
    return spread, np.flatnonzero(ask), offsets + np.arange(n + 1)


def gram_codes(spread: np.ndarray, ask: np.ndarray, order: int) -> np.ndarray:
    """The n-gram that ends at each position: the next byte lowest, then its context, nearest first."""
    code = spread[ask].astype(np.uint64)
    for back in range(1, order + 1):
        code |= spread[ask - back].astype(np.uint64) << np.uint64(8 * back)
    return code


def _count(batches: Iterator[pa.RecordBatch], order: int, mod: int, held_out: int) -> Iterator[pa.RecordBatch]:
    held = [Counts(), Counts(), Counts()]

    def rows(kind: int, found: tuple[np.ndarray, np.ndarray] | None) -> Iterator[pa.RecordBatch]:
        keys, counts = found or ((), ())
        for at in range(0, len(keys), 1 << 17):
            k, n = keys[at : at + (1 << 17)], counts[at : at + (1 << 17)]
            k, n = k[n > 0], n[n > 0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int8)), pa.array(k.view(np.int64)), pa.array(n)], names=["kind", "key", "n"])

    for part in text_slices(batches):
        train = crc_of(part.column("doc_id").to_pylist()) % mod != held_out
        for data, offsets in word_pieces(part.data, part.offsets):
            starts, ends, per_row = word_bounds(data, offsets)
            use = np.repeat(train, per_row)
            yield from rows(0, held[0].add(*count_sorted(hash_words(LOWER[data], starts[use], ends[use]))))
        yield from rows(0, held[0].add(np.array([END_TOKEN]), np.array([int(train.sum())], np.int64)))
        for code, counts in _gram_pieces(part.data, part.offsets, order):
            use = np.repeat(train, counts)
            yield from rows(1, held[1].add(*count_sorted(code[use])))
            yield from rows(2, held[2].add(*count_sorted(code[~use])))
    for kind in range(3):
        yield from rows(kind, held[kind].drained())


def _gram_pieces(data: np.ndarray, offsets: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """N-grams of a slice and how many each row has; of one long text piece by piece."""
    if len(offsets) > 2 or len(data) <= 2 * SLICE_BYTES:
        spread, ask, bounds = padded(data, offsets, order)
        yield gram_codes(spread, ask, order), np.diff(bounds)
        return
    for at in range(0, len(data), SLICE_BYTES):
        end = min(at + SLICE_BYTES, len(data))
        # the bytes before a piece are its first ones' context; the closing edge belongs to the last one
        before = LOWER[data[max(at - order, 0) : at]]
        edges = np.full(order - len(before), EDGE, np.uint8), np.full(int(end == len(data)), EDGE, np.uint8)
        spread = np.concatenate((edges[0], before, LOWER[data[at:end]], edges[1]))
        yield gram_codes(spread, np.arange(order, len(spread)), order), np.array([len(spread) - order])


class Trie:
    """Nodes are known contexts, reached by reading bytes backwards from the root.

    ``child[node, byte]`` is the node of the longer context (0: none);
    ``logp[node, byte]`` the log10 probability of the next byte there.
    """

    def __init__(self, child: np.ndarray, logp: np.ndarray, order: int):
        self.child, self.logp, self.order = child, logp, order

    def look_up(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of the n-grams ``codes`` by their longest known context."""
        node, alive = np.zeros(len(codes), np.int64), np.ones(len(codes), dtype=bool)
        byte = lambda back: (codes >> np.uint64(8 * back) & np.uint64(255)).astype(np.int64)
        for back in range(1, self.order + 1):
            longer = self.child[node, byte(back)]
            alive &= longer > 0
            node = np.where(alive, longer, node)
        return self.logp[node, byte(0)]


def build_trie(levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Trie:
    """The trie of ``levels[k]``: codes of k context bytes, next bytes and counts.

    A node that has seen n bytes of d kinds escapes with d / (n + d).  What
    escapes is shared as the next shorter context shares it, without the
    bytes the node has seen (exclusion).  Below the root every byte is
    equally likely.  Context bytes are coded nearest first, lowest first.
    """
    order = len(levels) - 1
    nodes: list[dict[int, int]] = [{0: 0}]
    total = 1
    for k in range(1, order + 1):
        known = np.unique(levels[k][0])
        nodes.append({int(c): total + i for i, c in enumerate(known)})
        total += len(known)
    child = np.zeros((total, 256), np.int32)
    for k in range(1, order + 1):
        for code, node in nodes[k].items():
            child[nodes[k - 1][code & ((1 << 8 * (k - 1)) - 1)], code >> 8 * (k - 1)] = node
    p = np.zeros((total, 256))
    for k in range(order + 1):
        contexts, nexts, counts = levels[k]
        ids = np.array(list(nodes[k].values()), np.int64)
        seen = np.zeros((len(ids), 256))
        slot = np.searchsorted(np.array(list(nodes[k]), np.int64), contexts)
        seen[slot, nexts] = counts
        if k:
            parents = np.array([nodes[k - 1][c & ((1 << 8 * (k - 1)) - 1)] for c in nodes[k]], np.int64)
            lower = p[parents]
        else:
            lower = np.full((1, 256), 1 / 256)
        kinds, n = (seen > 0).sum(1, keepdims=True), seen.sum(1, keepdims=True)
        rest = np.where(seen > 0, 0.0, lower)
        left = rest.sum(1, keepdims=True)
        escape = np.where(left > 0, kinds / (n + kinds), 0.0)
        escape = np.where(n > 0, escape, 1.0)
        p[ids] = (1 - escape) * seen / np.maximum(n, 1) + escape * rest / np.where(left > 0, left, 1.0)
    return Trie(child, np.log10(p), order)


def extend(keys: np.ndarray, n: np.ndarray, base: Trie, order: int) -> np.ndarray:
    """log10 probability of the distinct n-grams ``keys``, seen ``n`` times in training.

    ``keys`` hold all n-grams that end as they do in one byte more than the
    trie's contexts.  A byte seen after a context is seen after its shorter
    forms too, so what a context's seen bytes take from the shorter one, and
    what exclusion leaves there, is the sum of their probabilities.
    """
    form = lambda codes, k: codes & np.uint64((1 << 8 * (k + 1)) - 1)
    shorter = np.unique(form(keys, base.order))
    p = 10.0 ** base.look_up(shorter)
    for k in range(base.order + 1, order + 1):
        grams, at = np.unique(form(keys, k), return_inverse=True)
        seen = np.bincount(at, n, len(grams))
        lower = p[np.searchsorted(shorter, form(grams, k - 1))]
        _, of = np.unique(grams >> np.uint64(8), return_inverse=True)
        total, kinds = np.bincount(of, seen)[of], np.bincount(of, seen > 0)[of]
        left = np.maximum(1 - np.bincount(of, np.where(seen > 0, lower, 0.0))[of], 1e-15)
        escape = kinds / np.maximum(total + kinds, 1)
        p = np.where(seen > 0, (1 - escape) * seen / np.maximum(total, 1), np.where(total > 0, escape / left, 1.0) * lower)
        shorter = grams
    return np.log10(p[np.searchsorted(shorter, form(keys, max(order, base.order)))])


class Cache:
    """Values of some keys: tables with one place a key, whose losers go to the next table."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.tables = []
        while len(keys):
            shift = np.uint64(64 - len(keys).bit_length())
            times = mix(np.array([len(self.tables) + 1], np.uint64)) | np.uint64(1)
            place = keys * times >> shift
            key, value = np.zeros(1 << 64 - int(shift), np.uint64), np.full(1 << 64 - int(shift), np.nan)
            key[place] = keys
            won = key[place] == keys
            value[place[won]] = values[won]
            self.tables.append((times, shift, key, value))
            keys, values = keys[~won], values[~won]

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, NaN where there is none."""
        found = np.full(len(keys), np.nan)
        todo = np.arange(len(keys))
        for times, shift, key, value in self.tables:
            asked = keys[todo]
            place = asked * times >> shift
            found[todo] = np.where(key[place] == asked, value[place], np.nan)
            todo = todo[np.isnan(found[todo])]
            if not len(todo):
                break
        return found


@lru_cache(maxsize=1)
def _cached(held: Broadcast) -> Cache:
    _, _, grams, values = held.value
    return Cache(grams, values)


class Model:
    """A fitted model: all words and n-grams with their values, the hot ones of both, and the two totals."""

    def __init__(self, order: int, words: DataFrame, hot: tuple, grams: DataFrame, hot_grams: tuple, tokens: int, distinct: int):
        self.order, self.words, self.hot, self.grams, self.hot_grams, self.tokens, self.distinct = order, words, hot, grams, hot_grams, tokens, distinct


def _hot(rows: DataFrame, times: str, most: int, least_times: float = 0.0) -> tuple[DataFrame, DataFrame, int]:
    """The rows whose ``times`` reach a step that at most ``most`` rows reach, the others, and that step."""
    at = F.floor(F.log2(times) * 8)
    # how many rows reach each power of 2 ** (1 / 8): a few hundred rows
    steps = rows.where(F.col(times) >= F.lit(least_times)).groupBy(at.alias("step")).count().orderBy(F.desc("step")).collect()
    reach, least = 0, 1 << 62
    for step in steps:
        reach += step["count"]
        if reach > most:
            break
        least = step["step"]
    return rows.where(at >= F.lit(least)), rows.where(at < F.lit(least)), least


def _sorted(table: pa.Table, key: str, value: str) -> tuple[np.ndarray, np.ndarray]:
    keys = table.column(key).to_numpy().view(np.uint64)
    rank = np.argsort(keys)
    return keys[rank], table.column(value).to_numpy()[rank]


def _extended(batches: Iterator[pa.RecordBatch], held: Broadcast, order: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by ``part``, whole parts at a time."""
    base = build_trie(held.value)
    parts: list[pa.RecordBatch] = []

    def made(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        keys = rows.column("key").to_numpy().view(np.uint64)
        logp = extend(keys, rows.column("n").to_numpy(), base, order)
        yield from pa.table({"key": rows.column("key"), "times": rows.column("times"), "logp": logp}).to_batches(1 << 16)

    for batch in batches:
        parts.append(batch)
        if sum(x.num_rows for x in parts) >= CHUNK:
            rows = pa.Table.from_batches(parts)
            part = rows.column("part").to_numpy()
            end = int(np.searchsorted(part, part[-1]))
            if end:
                yield from made(rows.slice(0, end))
            parts = rows.slice(end).combine_chunks().to_batches()
    if sum(x.num_rows for x in parts):
        yield from made(pa.Table.from_batches(parts))


def fit(docs: DataFrame, mod: int = 7, held_out: int = 2, order: int = MAX_ORDER, min_share: float = 0.0, hot_words: int = HOT_WORDS, hot_grams: int = HOT_GRAMS) -> Model:
    """Count words and byte n-grams of all texts whose crc32(id) mod ``mod`` isn't ``held_out``.

    The n-grams of the other texts get their probability too.  ``hot_grams``
    and ``min_share`` (of all positions) bound the n-grams that are
    broadcast; results don't depend on them.
    """
    if not 0 <= order <= 7:
        raise ValueError(f"contexts of {order} bytes: at most 7")
    counts = docs.select("doc_id", "text").mapInArrow(lambda batches: _count(batches, order, mod, held_out), "kind tinyint, key bigint, n bigint")
    counts = cut(counts.groupBy(F.least("kind", F.lit(1).cast("tinyint")).alias("kind"), "key").agg(F.coalesce(F.sum(F.when(F.col("kind") < 2, F.col("n"))), F.lit(0)).alias("n"), F.sum("n").alias("times")))
    words = counts.where("kind = 0").select(F.col("key").alias("word"), "n")
    grams = counts.where("kind = 1").select("key", "n", "times")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("n")).first()
    found, cold, _ = _hot(words, "n", hot_words)
    hot = _sorted(found.toArrow(), "word", "n")
    base, levels = min(order, BASE_ORDER), []
    for k in range(base + 1):
        # the context is what stands above the next byte, cut to its k nearest bytes
        context = F.shiftright(F.col("key"), 8).bitwiseAND(F.lit((1 << 8 * k) - 1))
        level = grams.where("n > 0").groupBy(context.alias("context"), F.col("key").bitwiseAND(F.lit(255)).alias("next")).agg(F.sum("n").alias("n"))
        got = level.toArrow().sort_by([("context", "ascending"), ("next", "ascending")])
        levels.append(tuple(got.column(c).to_numpy() for c in ("context", "next", "n")))
    held = docs.sparkSession.sparkContext.broadcast(levels)
    part = F.shiftright(F.col("key"), 8).bitwiseAND(F.lit((1 << 8 * (BASE_ORDER + 1)) - 1))
    dealt = grams.withColumn("part", part).repartition("part").sortWithinPartitions("part")
    scored = cut(dealt.mapInArrow(lambda batches: _extended(batches, held, order), "key bigint, times bigint, logp double"))
    positions = scored.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    often, rare, _ = _hot(scored, "times", hot_grams, min_share * positions)
    return Model(order, cold, hot, rare, _sorted(often.toArrow(), "key", "logp"), int(total[0]), int(total[1]))


def _distinct(rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of row and key, and how often each occurs."""
    order = np.lexsort((keys, rows))
    keys, rows = keys[order], rows[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
    edge = np.flatnonzero(new)
    return rows[edge], keys[edge], np.diff(np.append(edge, len(keys))).astype(np.int32)


def score(docs: DataFrame, model: Model, mod: int = 7, held_out: int = 2) -> DataFrame:
    """Score whole texts: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    ``docs`` are those that the model was fitted with, held-out ones included.
    ``base_score`` is the smoothed unigram score of the text's tokens and its
    end; ``score`` the log10 probability of the lower-case text and
    its end.  ``bits_per_byte`` follows.

    Null and empty texts are the end token alone.  Rows are told apart by
    their id and a hash of their text, so repeated rows are scored each.  An
    empty table gives no rows; with no training text every count is 0 and
    all bytes are equally likely.  Other columns are ignored.
    """
    context = docs.sparkSession.sparkContext
    held = context.broadcast((*model.hot, *model.hot_grams))
    length = model.order

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, hot_n, _, _ = held.value
        cache = _cached(held)
        hot = np.append(hot, np.uint64(0xFFFFFFFFFFFFFFFF))
        hot_n = np.append(hot_n, 0)
        for part in text_slices(batches):
            starts, ends, per_row = word_bounds(part.data, part.offsets)
            rows = np.repeat(np.arange(part.n), per_row)
            keys = np.concatenate((hash_words(LOWER[part.data], starts, ends), np.full(part.n, END_TOKEN)))
            rows = np.concatenate((rows, np.arange(part.n)))
            slot = np.searchsorted(hot, keys)
            slot[slot == len(hot)] = 0
            n = np.where(hot[slot] == keys, hot_n[slot], 0)
            logs = np.bincount(rows, np.where(n > 0, np.log10(n + 1.0), 0.0), part.n)
            known = np.bincount(rows, n > 0, part.n).astype(np.int64)
            spread, ask, bounds = padded(part.data, part.offsets, length)
            codes = gram_codes(spread, ask, length)
            each = cache.get(codes)
            miss = np.isnan(each)
            score = np.add.reduceat(np.where(miss, 0.0, each), bounds[:-1])
            # the other words and n-grams, once a row with their number
            cold = n == 0
            cold_rows, cold_keys, times = _distinct(rows[cold], keys[cold])
            gram_rows, gram_keys, gram_times = _distinct(np.repeat(np.arange(part.n), np.diff(bounds))[miss], codes[miss])
            kinds = np.repeat(np.array([0, 1], np.int8), [len(cold_rows), len(gram_rows)])
            rows = np.concatenate((cold_rows, gram_rows))
            order = np.argsort(rows, kind="stable")
            keys, times = np.concatenate((cold_keys, gram_keys))[order], np.concatenate((times, gram_times))[order]
            lengths = np.bincount(rows, minlength=part.n)
            items = pa.StructArray.from_arrays([pa.array(kinds[order]), pa.array(keys.view(np.int64)), pa.array(times)], names=["kind", "key", "times"])
            sizes = np.diff(part.offsets)
            ids = part.column("doc_id")
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), pa.array(crc_of(ids.to_pylist()) % mod == held_out), pa.array(per_row + 1), pa.array(sizes), pa.array(known), pa.array(logs), pa.array(score), pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32), items)],
                names=["doc_id", "held_out", "n_tokens", "n_bytes", "known", "logs", "score", "cold"],
            )

    looked = docs.select("doc_id", "text").mapInArrow(look_up, "doc_id bigint, held_out boolean, n_tokens bigint, n_bytes bigint, known bigint, logs double, score double, cold array<struct<kind:tinyint,key:bigint,times:int>>")
    # the row number within its task's output: written once, so both branches below see the same
    looked = cut(looked.withColumn("_row", F.monotonically_increasing_id()))
    known = model.words.select(F.lit(0).cast("tinyint").alias("kind"), F.col("word").alias("key"), F.log10(F.col("n") + 1.0).alias("value"))
    known = known.unionByName(model.grams.select(F.lit(1).cast("tinyint").alias("kind"), "key", F.col("logp").alias("value")))
    cold = looked.select("_row", F.explode("cold").alias("w")).select("_row", "w.*").join(known, ["kind", "key"], "left")
    value = F.when((F.col("kind") == 1) & F.col("value").isNull(), F.raise_error(F.lit("an n-gram that fit() has not seen"))).otherwise(F.col("times") * F.col("value"))
    of = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x))
    cold = cold.groupBy("_row").agg(of(0, value).alias("_logs"), of(0, F.when(F.col("value").isNotNull(), F.col("times"))).alias("_known"), of(1, value).alias("_score"))
    joined = looked.drop("cold").join(cold, "_row", "left").withColumn("score", F.col("score") + F.coalesce("_score", F.lit(0.0)))
    floor = F.log10(F.lit(float(model.tokens + model.distinct + 1)))
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("_known", F.lit(0))).cast("long").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("_logs", F.lit(0.0)) - F.col("n_tokens") * floor).alias("base_score"), "score", (-F.col("score") / F.log10(F.lit(2.0)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )


def score_documents(docs: DataFrame, mod: int = 7, held_out: int = 2, **options) -> DataFrame:
    """Fit on the documents outside the held-out class and score all of them."""
    return score(docs, fit(docs, mod, held_out, **options), mod, held_out)
