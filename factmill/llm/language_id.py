"""Language identification by error-correcting output codes.

Every language has a codeword; one binary classifier over hashed byte n-grams
predicts each bit.  Decoding adds up each bit's loss against each codeword and
takes the nearest; two codewords nearly as close make the answer ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import LOWER, SLICE_BYTES, crc_mod, crc_of, hash_share, lists, text_slices

#: Rows that the classifiers are fitted on, as many of each language and one at least; their texts are read whole.
FIT_ROWS = 4000
BUCKETS = 1 << 12
#: Rows whose features a task holds at once.
SLICE_ROWS = 512
UNKNOWN = "und"
_LETTER = r"\pL"


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """``n`` codewords of +1 and -1: all bit columns that tell up to 5 classes apart, else the best of random ones."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        columns = np.arange(1, 1 << (n - 1))
        return np.where((columns[None, :] << 1 >> np.arange(n)[:, None]) & 1, 1.0, -1.0)
    bits, random = int(np.ceil(10 * np.log2(n))), np.random.default_rng(seed)
    best, reached = None, -1
    # of many languages fewer codes are tried: random ones are all alike then
    for _ in range(max(2, min(200, 10**8 // (n * n)))):
        m = np.where(random.random((n, bits)) < 0.5, -1.0, 1.0)
        m = m[:, np.abs(m.sum(0)) < n]
        apart = least_distance(m)
        if apart > reached:
            best, reached = m, apart
    return best


def least_distance(m: np.ndarray, rows: int = 512) -> int:
    """In how many bits the two nearest of all codewords differ; some rows against all at a time."""
    nearest = []
    for at in range(0, len(m), rows):
        differ = (m.shape[1] - m[at : at + rows] @ m.T) / 2
        differ[np.arange(len(differ)), at + np.arange(len(differ))] = np.inf
        nearest.append(differ.min())
    return int(min(nearest))


def gram_features(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Rows of root frequencies of hashed byte 1-, 2- and 3-grams of the lower-case text.

    Bytes are looked at in stretches, so that a long text takes no more memory than a short one.
    """
    n, salt, shift = len(offsets) - 1, np.uint32(0x9E3779B1), np.uint32(32 - int(np.log2(buckets)))
    counts = np.zeros(n * buckets)
    for low in range(0, len(data), SLICE_BYTES):
        # two bytes before the stretch may begin its first grams
        start = max(low - 2, 0)
        x = LOWER[data[start : low + SLICE_BYTES]].astype(np.uint32)
        rows = np.searchsorted(offsets, np.arange(start, start + len(x)), side="right") - 1
        code = np.zeros(len(x), np.uint32)
        for size in range(3):
            # a gram ends in its row: its first byte must stand in the same row
            code = x if size == 0 else np.concatenate((code[:1] * 0, code[:-1])) << np.uint32(8) | x
            keep = slice(max(size, low - start), None)
            same = rows[keep] == rows[keep.start - size : len(rows) - size]
            key = ((code[keep] & np.uint32((1 << 8 * (size + 1)) - 1)) + np.uint32(size << 24)) * salt >> shift
            counts += np.bincount(rows[keep][same] * buckets + key[same], minlength=n * buckets)
    counts = np.sqrt(counts, dtype=np.float32).reshape(n, buckets)
    return counts / np.maximum(np.sqrt((counts**2).sum(1, keepdims=True)), 1e-12)


class Classifiers:
    """Linear classifiers of the code bits, and the codewords of the languages."""

    def __init__(self, languages: list[str], codes: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.languages, self.codes, self.weights, self.bias = languages, codes, weights, bias

    def decode(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest language, its share of the loss-weighted vote, and that share's lead on the next."""
        margins = (features @ self.weights + self.bias).astype(np.float64)
        # a bit's loss is one of two, by its sign in the codeword
        on, off = (np.log1p(np.exp(-np.clip(side * margins, -30, 30))) for side in (1, -1))
        losses = on @ (self.codes > 0).T + off @ (self.codes < 0).T
        vote = np.exp(losses.min(1, keepdims=True) - losses)
        vote /= vote.sum(1, keepdims=True)
        order = np.sort(vote, 1)
        best = vote.argmax(1)
        return best, vote[np.arange(len(best)), best], order[:, -1] - (order[:, -2] if vote.shape[1] > 1 else 0)


def fit(docs: DataFrame, held_out_mod: int = 5, held_out: int = 0, fit_rows: int = FIT_ROWS, buckets: int = BUCKETS, rounds: int = 150) -> Classifiers:
    """Fit on a bounded sample of rows with a language outside the held-out class, as many of each language.

    Of rows that share id and language the one with the smallest text counts.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod("doc_id", held_out_mod) != held_out))
    counts = known.groupBy("lang").agg(F.count("*").alias("_n")).toPandas()
    each = max(1, fit_rows // max(1, len(counts)))
    # what the order below has to look at is cut down first; few rows miss a share of twice what is asked for
    shares = docs.sparkSession.createDataFrame([(lang, 2.0 * each / n + 64.0 / n) for lang, n in zip(counts["lang"], counts["_n"], strict=True)], "lang string, _share double")
    key = hash_share("doc_id", 11)
    likely = known.select(F.col("lang").cast("string").alias("lang"), "doc_id").join(F.broadcast(shares), "lang").where(key < F.col("_share")).select("lang", "doc_id").distinct()
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(key, "doc_id"))
    chosen = likely.withColumn("_nth", nth).where(F.col("_nth") <= each).select("lang", F.col("doc_id").alias("_id"))
    rows = known.join(F.broadcast(chosen), (known["lang"] == chosen["lang"]) & known["doc_id"].eqNullSafe(chosen["_id"]), "left_semi")
    rows = rows.select("doc_id", F.col("lang").cast("string").alias("lang"), "text").groupBy("doc_id", "lang").agg(F.min("text").alias("text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, most_rows=SLICE_ROWS):
            x = gram_features(part.data, part.offsets, buckets)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("lang"), lists(x.ravel(), np.full(part.n, buckets))], names=["doc_id", "lang", "x"])

    # what comes to the driver is one row of features for each text
    sample = rows.mapInArrow(features, "doc_id bigint, lang string, x array<float>").toArrow()
    sample = sample.take(pc.sort_indices(sample, [("doc_id", "ascending"), ("lang", "ascending")])).combine_chunks()
    languages = sorted(set(sample.column("lang").to_pylist()))
    codes = codewords(len(languages))
    bits = codes.shape[1]
    weights, bias = np.zeros((buckets, bits), np.float32), np.zeros(bits, np.float32)
    if len(languages) < 2:
        return Classifiers(languages, codes, weights, bias)
    x = sample.column("x").combine_chunks().flatten().to_numpy().reshape(-1, buckets)
    y = codes[np.searchsorted(np.array(languages), np.array(sample.column("lang").to_pylist()))].astype(np.float32)
    # logistic losses, descent with momentum on all rows; features have length 1
    speed_w, speed_b, rate = np.zeros_like(weights), np.zeros_like(bias), np.float32(20.0)
    for _ in range(rounds):
        pull = y / (1 + np.exp(np.clip(y * (x @ weights + bias), -30, 30))) / np.float32(len(x))
        speed_w = np.float32(0.9) * speed_w + (x.T @ pull - np.float32(1e-5) * weights)
        speed_b = np.float32(0.9) * speed_b + pull.sum(0)
        weights, bias = weights + rate * speed_w, bias + rate * speed_b / 10
    return Classifiers(languages, codes, weights, bias)


def identify(docs: DataFrame, model: Classifiers, lead: float = 0.2, held_out_mod: int = 5, held_out: int = 0) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, ambiguous`` of every whole text.

    Null texts and texts without a letter are ``und`` with score 0, as is
    everything if no language was learned.  An answer whose vote leads the
    next by less than ``lead`` is flagged ambiguous.  Repeated rows are
    predicted each; an empty table gives no rows; other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for part in text_slices(batches, most_rows=SLICE_ROWS):
            ids = part.column("doc_id")
            letters = pc.match_substring_regex(part.column("text"), _LETTER).fill_null(False).to_numpy(zero_copy_only=False) & bool(m.languages)
            if m.languages:
                best, vote, ahead = m.decode(gram_features(part.data, part.offsets, m.weights.shape[0]))
            else:
                best, vote, ahead = np.zeros(part.n, int), np.zeros(part.n), np.zeros(part.n)
            named = [m.languages[b] if k else UNKNOWN for b, k in zip(best, letters, strict=True)]
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(crc_of(ids.to_pylist()) % held_out_mod == held_out), pa.array(named, pa.string()), pa.array(np.where(letters, vote, 0.0)), pa.array(~letters | (ahead < lead))], names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    return docs.select("doc_id", "text").mapInArrow(predict, "doc_id bigint, held_out boolean, lang_pred string, score double, ambiguous boolean")


def identify_languages(docs: DataFrame, **options) -> DataFrame:
    """Fit on the documents outside the held-out class and predict for all of them."""
    return identify(docs, fit(docs, **options))
