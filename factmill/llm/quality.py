"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes become rows of learned channels and one fixed channel that
marks bytes repeating what stood a few bytes before.  Learned filters look at
overlapping chunks of 16 bytes, every 4 bytes, over the whole text; they are
max-pooled in segments of 256 bytes, and a text's largest and mean pooled
values are combined into one probability.

Texts lie in one buffer, each from a multiple of a segment on and followed by
zeros, so that a slice of many texts is one matrix product.  A long text goes
through in stretches that overlap by what a window and a repeat reach back;
its largest and mean values are kept up on the way, so that memory doesn't
grow with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_sample, crc_mod, crc_of, excerpt, one_text, text_slices

#: Labelled rows of either class that the network is fitted on, at most, and bytes of each; of longer texts excerpts are taken.
FIT_ROWS = 1500
FIT_BYTES = 8192
#: Bytes that go through the network at once.
STRETCH = 1 << 18
CHANNELS, FILTERS, STRIDE, BLOCKS, SEGMENT, LAGS = 8, 24, 4, 4, 256, 40
_GAP = 64
_PART = CHANNELS * STRIDE


def repeats(x: np.ndarray) -> np.ndarray:
    """True where the last 8 bytes stood the same way up to ``LAGS`` bytes before."""
    found = np.zeros(len(x), dtype=bool)
    for lag in range(3, LAGS + 1):
        if len(x) < lag + 8:
            break
        same = x[lag:] == x[:-lag]
        same = same[1:] & same[:-1]
        same = same[2:] & same[:-2]
        same = same[4:] & same[:-4]
        found[lag + 7 :] |= same
    return found & (x > 0)


def lay_out(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts from multiples of a segment on, zeros between; and each text's number of segments."""
    sizes = np.diff(offsets)
    segments = (sizes + _GAP + SEGMENT - 1) // SEGMENT
    starts = (np.cumsum(segments) - segments) * SEGMENT
    x = np.zeros(int(segments.sum()) * SEGMENT + SEGMENT, np.uint8)
    for i in np.flatnonzero(sizes):
        # zero bytes of a text count as blanks: zeros mark what isn't text
        x[starts[i] : starts[i] + sizes[i]] = np.maximum(data[offsets[i] : offsets[i + 1]], 1)
    return x, segments


class Network:
    """Weights: byte channels, filters and their bias, output weights and bias."""

    def __init__(self, seed: int = 5):
        random = np.random.default_rng(seed)
        self.bytes = random.normal(0, 0.5, (256, CHANNELS)).astype(np.float32)
        self.filters = random.normal(0, 0.12, (BLOCKS * _PART, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = random.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.out_bias = np.zeros(1, np.float32)

    def parts(self) -> list[np.ndarray]:
        return [self.bytes, self.filters, self.bias, self.out, self.out_bias]

    def channels(self, x: np.ndarray, again: np.ndarray) -> np.ndarray:
        table = self.bytes.copy()
        table[:, -1] = 0
        table[0] = 0
        c = table[x]
        c[:, -1] = again
        return c

    def pooled(self, x: np.ndarray, again: np.ndarray, at: bool = False):
        """Each segment's largest filter values; with ``at``, also the windows that hold them and the channels."""
        c = self.channels(x, again)
        blocks = c.reshape(-1, _PART)
        n = len(blocks) - SEGMENT // STRIDE
        side = self.filters.reshape(BLOCKS, _PART, FILTERS).transpose(1, 0, 2).reshape(_PART, BLOCKS * FILTERS)
        g = blocks @ side
        h = g[:n, :FILTERS].copy()
        for i in range(1, BLOCKS):
            h += g[i : n + i, i * FILTERS : (i + 1) * FILTERS]
        h += self.bias
        np.maximum(h, 0, out=h)
        h[x[: n * STRIDE : STRIDE] == 0] = 0  # windows that start behind a text
        h = h.reshape(-1, SEGMENT // STRIDE, FILTERS)
        return (h.max(1), h.argmax(1), c) if at else h.max(1)

    def features(self, pooled: np.ndarray, segments: np.ndarray) -> np.ndarray:
        first = np.cumsum(segments) - segments
        return np.concatenate((np.maximum.reduceat(pooled, first, axis=0), np.add.reduceat(pooled, first, axis=0) / segments[:, None]), axis=1).astype(np.float32)

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The probability of each text; a slice of more than ``STRETCH`` bytes is one text."""
        if len(offsets) == 2 and len(data) > STRETCH:
            f = self.long_features(data)
        else:
            x, segments = lay_out(data, offsets)
            f = self.features(self.pooled(x, repeats(x)), segments)
        return 1 / (1 + np.exp(-np.clip(f @ self.out + self.out_bias, -30, 30).astype(np.float64)))

    def long_features(self, data: np.ndarray) -> np.ndarray:
        """The same features of one long text, stretch by stretch."""
        segments = (len(data) + _GAP + SEGMENT - 1) // SEGMENT
        most, total = np.zeros(FILTERS, np.float32), np.zeros(FILTERS, np.float64)
        for first in range(0, segments, STRETCH // SEGMENT):
            # a segment before, for what repeats, and one behind, for windows that reach over
            last = min(first + STRETCH // SEGMENT, segments)
            start, end = max(first - 1, 0) * SEGMENT, (last + 1) * SEGMENT
            x = np.zeros(end - start, np.uint8)
            part = data[start : min(end, len(data))]
            x[: len(part)] = np.maximum(part, 1)
            own = first * SEGMENT - start
            pooled = self.pooled(x[own:], repeats(x)[own:])
            most = np.maximum(most, pooled.max(0))
            total += pooled.sum(0, dtype=np.float64)
        return np.concatenate((most, total / segments)).astype(np.float32)[None]

    def gradients(self, x: np.ndarray, again: np.ndarray, segments: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean logistic loss, for all parts."""
        pooled, where, c = self.pooled(x, again, at=True)
        f = self.features(pooled, segments)
        p = 1 / (1 + np.exp(-np.clip(f @ self.out + self.out_bias, -30, 30)))
        d = ((p - y) / len(y)).astype(np.float32)
        d_f = d[:, None] * self.out
        text = np.repeat(np.arange(len(segments)), segments)
        d_pooled = d_f[text, FILTERS:] / segments[text][:, None]
        d_pooled += d_f[text, :FILTERS] * (pooled == f[text, :FILTERS])
        d_pooled *= pooled > 0
        flt, seg = np.nonzero(d_pooled.T)  # filter by filter
        g = d_pooled[seg, flt]
        window = seg * (SEGMENT // STRIDE) + where[seg, flt]
        flat = c.ravel()
        seen = flat[window[:, None] * _PART + np.arange(BLOCKS * _PART)]
        d_filters = np.zeros_like(self.filters)
        used, first = np.unique(flt, return_index=True)
        if len(used):
            d_filters[:, used] = np.add.reduceat(seen * g[:, None], first, axis=0).T
        back = (self.filters.T[flt] * g[:, None]).reshape(-1, CHANNELS)
        byte = x[(window[:, None] * STRIDE + np.arange(BLOCKS * STRIDE)).ravel()].astype(np.int64)
        d_bytes = np.stack([np.bincount(byte, back[:, i], 256) for i in range(CHANNELS)], axis=1).astype(np.float32)
        d_bytes[:, -1] = d_bytes[0] = 0  # neither is used
        return [d_bytes, d_filters, np.bincount(flt, g, FILTERS).astype(np.float32), f.T @ d, d.sum(keepdims=True)]


def train(texts: list[bytes], y: np.ndarray, epochs: int = 5, batch: int = 32, rate: float = 0.01, seed: int = 5) -> Network:
    """Fit by Adam on whole texts."""
    net, random = Network(seed), np.random.default_rng(seed)
    laid = []
    for t in texts:
        x, segments = lay_out(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        laid.append((x[: int(segments[0]) * SEGMENT], repeats(x)[: int(segments[0]) * SEGMENT], int(segments[0])))
    tail = np.zeros(SEGMENT, np.uint8)
    m = [np.zeros_like(p) for p in net.parts()]
    v = [np.zeros_like(p) for p in net.parts()]
    step = 0
    for epoch in range(epochs):
        order = random.permutation(len(laid))
        for at in range(0, len(order), batch):
            take = order[at : at + batch]
            x = np.concatenate([laid[i][0] for i in take] + [tail])
            again = np.concatenate([laid[i][1] for i in take] + [tail > 0])
            grads = net.gradients(x, again, np.array([laid[i][2] for i in take]), y[take])
            step += 1
            now = rate * (0.3 if epoch >= epochs * 0.7 else 1.0)
            for p, g, a, b in zip(net.parts(), grads, m, v, strict=True):
                a += np.float32(0.1) * (g - a)
                b += np.float32(0.01) * (g * g - b)
                p -= (now * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def fit(docs: DataFrame, labels: DataFrame, mod: int | None = 3, held_out: int = 1, fit_rows: int = FIT_ROWS) -> Network | None:
    """Fit on a bounded sample of labelled rows outside the held-out class; None without both classes.

    At most twice ``fit_rows`` labelled ids of either class, one row of each,
    are looked at, as not every label has its document.  ``mod=None`` holds
    nothing out.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = docs.where(F.col("text").isNotNull())
    if mod is not None:
        known = known.where(crc_mod("doc_id", mod) != held_out)
    # labels are narrow; which ids to fit on is settled before any text is read
    ids = [bounded_sample(known.where(F.col("quality") == q), "doc_id", fit_rows * 2, 13 + q) for q in (0, 1)]
    ids = ids[0].unionByName(ids[1])
    sample = one_text(rows.join(F.broadcast(ids), "doc_id").select("doc_id", excerpt("text", FIT_BYTES).alias("text"), "quality"), "quality")
    sample = sample.toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    y = np.array(sample.column("quality").to_pylist(), np.float32)
    if len(y) == 0 or y.min() == y.max():
        return None
    # both classes weigh the same
    random, chosen = np.random.default_rng(3), []
    for q in (0, 1):
        own = random.permutation(np.flatnonzero(y == q))[:fit_rows]
        chosen.append(np.resize(own, min(fit_rows, max((y == 0).sum(), (y == 1).sum()))))
    chosen = np.concatenate(chosen)
    column = sample.column("text")
    texts = {i: column[i].as_py() for i in np.unique(chosen).tolist()}
    del sample, column
    return train([texts[i] for i in chosen.tolist()], y[chosen])


def score(docs: DataFrame, network: Network | None, mod: int = 3, held_out: int = 1) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every whole text.

    Null and empty texts are scored as empty texts.  Without a network (no
    labels of both classes) every score is 0.5.  Repeated rows are scored
    each; an empty table gives no rows; other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(network)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = held.value
        for part in text_slices(batches, most=STRETCH):
            ids = part.column("doc_id")
            p = np.full(part.n, 0.5) if net is None else net.predict(part.data, part.offsets)
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(crc_of(ids.to_pylist()) % mod == held_out), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(predict, "doc_id bigint, held_out boolean, score double, predicted int")


def score_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Fit on the labelled documents outside the held-out class and score all documents."""
    return score(docs, fit(docs, labels, **options))


def accepted(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, all columns kept."""
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, mod=None))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = held.value
        for part in text_slices(batches, most=STRETCH):
            if net is None:
                yield part.rows
            else:
                yield part.rows.filter(pa.array(net.predict(part.data, part.offsets) >= least))

    return docs.mapInArrow(keep, docs.schema)
