"""Toxicity by a classifier chain of linear models.

Categories are predicted one after the other; every model sees the text's
features and the probabilities of the categories before it.  In training
those probabilities are out-of-fold, features selected without the fold
included, so that a later model learns from predictions as they will be.
Features say which of the selected words and word beginnings stand anywhere
in the whole text.

Where the labels name no categories but the last, the earlier ones are kinds
of toxic texts found among the labelled ones: clusters of those that share
telling words, whatever their language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, bounded_sample, crc_mod, crc_of, hash_words, lists, one_text, text_slices, word_bounds, word_pieces

#: Labelled rows of either value of the last category that are fitted on, at most; their texts are read whole.
FIT_ROWS = 2000
FEATURES = 1024
_SPACE_BITS = 20
_PREFIXES = (4, 5, 6)
FOLDS = 3
#: Kinds of toxic texts that are told apart before the last category.
KINDS = ("kind_1", "kind_2", "kind_3")
CATEGORIES = [*KINDS, "toxic"]

_WORD = np.zeros(256, dtype=bool)
_WORD[0x61:0x7B] = _WORD[0x80:] = True
_LETTERS = _WORD[LOWER]


def word_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words and word beginnings, and their rows; a word is letters, lower-cased.

    One long text is taken piece by piece and gives each feature once.
    """
    pieces = [_piece_features(*piece) for piece in word_pieces(data, offsets, _LETTERS)]
    if len(pieces) == 1:
        return pieces[0]
    keys = np.unique(np.concatenate([np.unique(keys) for keys, _ in pieces]))
    return keys, np.zeros(len(keys), np.int64)


def _piece_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = LOWER[data]
    starts, ends, count = word_bounds(low, offsets, _WORD)
    rows = np.repeat(np.arange(len(count)), count)
    keys, owners = [hash_words(low, starts, ends) * np.uint64(2)], [rows]
    for size in _PREFIXES:
        long = ends - starts >= size
        keys.append(hash_words(low, starts[long], starts[long] + size) * np.uint64(2) + np.uint64(1))
        owners.append(rows[long])
    return (np.concatenate(keys) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _SPACE_BITS)).astype(np.int64), np.concatenate(owners)


class Chain:
    """Selected features (``slot``: feature to column), and per category weights over features and earlier probabilities."""

    def __init__(self, names: list[str], slot: np.ndarray, weights: list[np.ndarray], biases: list[float]):
        self.names, self.slot, self.weights, self.biases = names, slot, weights, biases

    def matrix(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        keys, rows = word_features(data, offsets)
        column = self.slot[keys]
        hit = column >= 0
        x = np.zeros((len(offsets) - 1, len(self.weights[0])), np.float32)
        x[rows[hit], column[hit]] = 1
        return x

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probabilities, a column for each category."""
        x, out = self.matrix(data, offsets), []
        for w, b in zip(self.weights, self.biases, strict=True):
            z = x @ w[: x.shape[1]] + b
            for earlier, weight in zip(out, w[x.shape[1] :], strict=True):
                z = z + weight * earlier
            out.append(_sigmoid(z))
        return np.stack(out, axis=1)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 300, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated descent; the classes weigh the same."""
    share = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)).astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    if y.min(initial=1) == y.max(initial=0):
        return w, (-6.0 if not len(y) or y[0] == 0 else 6.0)
    sw, sb = np.zeros_like(w), 0.0
    rate = 4.0 / (1 + float((share @ (x * x)).max()) * 4)
    for _ in range(rounds):
        pull = share * (y - _sigmoid(x @ w + b)).astype(np.float32)
        sw = np.float32(0.9) * sw + (x.T @ pull - np.float32(penalty) * w)
        sb = 0.9 * sb + float(pull.sum())
        w, b = w + np.float32(rate) * sw, b + rate * sb
    return w, b


class Sample:
    """Rows and features of the texts that are fitted on: pairs, each once, by row."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.n, self.rows, self.keys = len(counts), np.repeat(np.arange(len(counts), dtype=np.int32), counts), keys
        self.known = np.unique(keys)

    def telling(self, y: np.ndarray, use: np.ndarray, most: int) -> np.ndarray:
        """Up to ``most`` features that tell the positives among the rows ``use`` best, the most telling first.

        The measure is the difference of shares in units of its spread.  Only
        features that mark positives count: common words tell a text's
        length, and what clean texts have in common must not excuse a toxic one.
        """
        on, off = (y > 0) & use, (y <= 0) & use
        n1, n0 = max(on.sum(), 1), max(off.sum(), 1)
        # of the features that occur; there are far fewer than the space holds
        a = np.bincount(self.keys[on[self.rows]], minlength=1 << _SPACE_BITS)[self.known]
        b = np.bincount(self.keys[off[self.rows]], minlength=1 << _SPACE_BITS)[self.known]
        share = (a + b) / (n1 + n0)
        tell = np.where(a + b >= 3, np.abs(a / n1 - b / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0) + 1e-12), 0)
        tell[np.maximum(a / n1, 0.1 / n1) < 6 * np.maximum(b / n0, 0.1 / n0)] = 0
        best = np.argsort(-tell, kind="stable")[:most]
        return self.known[best[tell[best] > 3]].astype(np.int64)

    def matrix(self, columns: np.ndarray) -> np.ndarray:
        """A row for each text, a column for each of the given features."""
        slot = slots(columns)
        x = np.zeros((self.n, len(columns)), np.float32)
        hit = slot[self.keys] >= 0
        x[self.rows[hit], slot[self.keys[hit]]] = 1
        return x


def distinct_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's features, each once, one text after the other, and how many it has."""
    keys, rows = word_features(data, offsets)
    pairs = np.unique(rows << _SPACE_BITS | keys)
    return (pairs & ((1 << _SPACE_BITS) - 1)).astype(np.int32), np.bincount(pairs >> _SPACE_BITS, minlength=len(offsets) - 1)


def slots(columns: np.ndarray) -> np.ndarray:
    """The column of each feature, or -1."""
    slot = np.full(1 << _SPACE_BITS, -1, np.int32)
    slot[columns] = np.arange(len(columns))
    return slot


def chosen_features(sample: Sample, y: np.ndarray, use: np.ndarray, features: int) -> np.ndarray:
    """Features for all categories, chosen on the rows ``use``; one at least, so that there is a matrix."""
    found = np.unique(np.concatenate([sample.telling(y[:, k], use, max(1, features // y.shape[1])) for k in range(y.shape[1])]))
    return found if len(found) else np.zeros(1, np.int64)


def kinds(sample: Sample, toxic: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """A 0/1 column for each of ``k`` kinds of toxic texts: those nearest to one of ``k`` centres in the telling features.

    Centres begin with the most telling features that seldom stand together
    and settle as the means of their texts; a text without telling features
    has no kind.
    """
    out = np.zeros((len(toxic), k), np.float32)
    columns = sample.telling(toxic, np.ones(len(toxic), dtype=bool), 256)
    if not len(columns):
        return out
    x = sample.matrix(columns)
    x[toxic <= 0] = 0
    size = np.sqrt((x**2).sum(1, keepdims=True))
    unit = x / np.maximum(size, 1)
    together = x.T @ x
    first: list[int] = []
    for _ in range(min(k, len(columns))):
        # how often a feature stands without those that were taken
        alone = np.diag(together) - (together[first].max(0) if first else 0)
        first.append(int(np.argmax(alone)))
    centres = np.eye(len(columns), dtype=np.float32)[first]
    for _ in range(rounds):
        near = unit @ centres.T
        own = np.where(near.max(1) > 0, near.argmax(1), -1)
        for j in range(len(centres)):
            if (own == j).any():
                mean = unit[own == j].mean(0)
                centres[j] = mean / max(float(np.sqrt((mean**2).sum())), 1e-9)
    near = unit @ centres.T
    own = np.where(near.max(1) > 0, near.argmax(1), -1)
    out[np.flatnonzero(own >= 0), own[own >= 0]] = 1
    return out


def train(sample: Sample, y: np.ndarray, names: list[str], features: int = FEATURES, folds: int = FOLDS) -> Chain:
    """Fit the chain on texts and their categories (a column each, in the chain's order)."""
    everything = np.ones(len(y), dtype=bool)
    columns = chosen_features(sample, y, everything, features)
    x = sample.matrix(columns)
    fold = np.random.default_rng(17).permutation(len(y)) % folds
    # what each fold's models see was chosen without the fold; the matrices are made when they are needed
    inner = [chosen_features(sample, y, fold != f, features) for f in range(folds)]
    weights, biases, earlier = [], [], np.zeros((len(y), 0), np.float32)
    for k in range(y.shape[1]):
        w, b = logistic(np.concatenate((x, earlier), axis=1), y[:, k])
        weights.append(w)
        biases.append(b)
        if k + 1 < y.shape[1]:
            out_of_fold = np.zeros((len(y), 1), np.float32)
            for f in range(folds):
                seen = np.concatenate((sample.matrix(inner[f]), earlier), axis=1)
                w, b = logistic(seen[fold != f], y[fold != f, k])
                out_of_fold[fold == f, 0] = _sigmoid(seen[fold == f] @ w + b)
            earlier = np.concatenate((earlier, out_of_fold), axis=1)
    return Chain(names, slots(columns), weights, biases)


def labelled(docs: DataFrame, labels: DataFrame, categories: list[str] | None = None, mod: int | None = 3, held_out: int = 1) -> DataFrame:
    """``doc_id, text`` and the labels of a bounded sample of labelled documents, one row an id.

    ``categories`` are 0/1 columns of ``labels``, the last one ``toxic``.
    ``mod=None`` holds nothing out.
    """
    columns = [*(categories or []), "toxic"] if "toxic" not in (categories or []) else categories
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*[F.coalesce(F.max(c), F.lit(0)).cast("int").alias(c) for c in columns])
    if mod is not None:
        known = known.where(crc_mod("doc_id", mod) != held_out)
    ids = [bounded_sample(known.where(F.col("toxic") == t), "doc_id", FIT_ROWS, 19 + t) for t in (0, 1)]
    rows = docs.where(F.col("text").isNotNull()).join(F.broadcast(ids[0].unionByName(ids[1])), "doc_id")
    return one_text(rows.select("doc_id", "text", *columns), *columns)


def fit(sample: DataFrame, categories: list[str] | None = None) -> Chain | None:
    """Fit on rows with a ``text`` and a 0/1 column for each category; None without rows.

    Without ``categories`` there is ``toxic`` alone, and kinds of toxic texts
    come before it.  Texts stay where they are: what comes to the driver are
    the distinct features of each, a number of four bytes for each of them.
    """
    names = categories or ["toxic"]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            keys, counts = distinct_features(part.data, part.offsets)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), lists(keys, counts), *(part.column(c).cast(pa.float32()) for c in names)], names=["doc_id", "features", *names])

    found = sample.select("doc_id", "text", *names).mapInArrow(features, f"doc_id bigint, features array<int>, {', '.join(f'`{c}` float' for c in names)}")
    rows = found.toArrow()
    if not rows.num_rows:
        return None
    rows = rows.take(pc.sort_indices(rows.column("doc_id"))).combine_chunks()
    column = rows.column("features").combine_chunks()
    texts = Sample(column.flatten().to_numpy(), column.value_lengths().to_numpy())
    y = np.stack([rows.column(c).to_numpy() for c in names], axis=1)
    if not categories:
        y = np.concatenate((kinds(texts, y[:, 0], len(KINDS)), y), axis=1)
    return train(texts, y, categories or CATEGORIES)


def score(docs: DataFrame, chain: Chain | None, categories: list[str] | None = None, mod: int = 3, held_out: int = 1) -> DataFrame:
    """``doc_id, held_out``, a probability for each category, and ``predicted`` (the last one is 0.5 or more).

    Null and empty texts have no features and get the models' bias.  Without
    labels all probabilities are 0.  Repeated rows are scored each; an empty
    table gives no rows; other columns are ignored.
    """
    names = categories or CATEGORIES
    held = docs.sparkSession.sparkContext.broadcast(chain)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        for part in text_slices(batches):
            p = np.zeros((part.n, len(names))) if c is None else c.predict(part.data, part.offsets)
            ids = part.column("doc_id")
            arrays = [ids.cast(pa.int64()), pa.array(crc_of(ids.to_pylist()) % mod == held_out), *(pa.array(p[:, i].astype(np.float64)) for i in range(len(names))), pa.array((p[:, -1] >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", *names, "predicted"])

    return docs.select("doc_id", "text").mapInArrow(predict, f"doc_id bigint, held_out boolean, {', '.join(f'{c} double' for c in names)}, predicted int")


def score_toxicity(docs: DataFrame, labels: DataFrame, categories: list[str] | None = None, mod: int = 3, held_out: int = 1) -> DataFrame:
    """Fit on a bounded sample of labelled documents outside the held-out class and score all documents."""
    return score(docs, fit(labelled(docs, labels, categories, mod, held_out), categories), categories, mod, held_out)


def accepted(docs: DataFrame, labels: DataFrame, most: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose last category stays below ``most``, all columns kept; nothing is held out."""
    held = docs.sparkSession.sparkContext.broadcast(fit(labelled(docs, labels, mod=None)))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        for part in text_slices(batches):
            yield part.rows if c is None else part.rows.filter(pa.array(c.predict(part.data, part.offsets)[:, -1] < most))

    return docs.mapInArrow(keep, docs.schema)
