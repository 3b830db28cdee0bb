"""Language identification, quality and toxicity: accuracy on what wasn't learned, and awkward rows."""

import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factmill.llm import language_id, quality, toxicity
from factmill.llm.shared import hash_words, text_slices

from .helpers import documents, empty, prose


def test_language(spark):
    docs, rows = documents(spark, 400, 5)
    got = language_id.identify_languages(docs).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r for r in rows}
    seen = right = 0
    for g in got:
        text, lang = truth[g["doc_id"]][1:3]
        assert g["held_out"] == (zlib.crc32(str(g["doc_id"] if g["doc_id"] is not None else "").encode()) % 5 == 0)
        assert 0 <= g["score"] <= 1
        if not any(c.isalpha() for c in text or ""):
            assert g["lang_pred"] == "und" and g["ambiguous"]
        else:
            assert g["lang_pred"] in ("en", "fr", "de")
        if g["held_out"] and lang and len(text.split()) > 5:
            seen, right = seen + 1, right + (g["lang_pred"] == lang)
    assert seen > 30 and right / seen > 0.95
    assert language_id.identify_languages(empty(spark)).count() == 0
    nothing = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_id.identify_languages(nothing).collect()} == {"und"}


def test_codewords():
    for n in (2, 3, 4, 5, 9):
        codes = language_id.codewords(n)
        assert len({tuple(c) for c in codes}) == n and (abs(codes.sum(0)) < n).all()


def labelled(spark):
    r = random.Random(8)
    rows, labels = [], []
    for i in range(500):
        text, bad, toxic = prose(r, "en", r.randint(5, 80)), i % 3 == 0, i % 5 == 0
        if toxic:
            at = text.split()
            at.insert(r.randrange(len(at)), r.choice(["idiot", "moron,", "Trash", "scum", "lostra" + r.choice("abcdef")]))
            text = " ".join(at)
        if bad:
            kind = i % 4
            text += [" ".join(w + "%%%" for w in text.split()), "\n" + text.upper().replace(" ", "!! "), " |".join(text.split(" ")), " " + "same " * 60][kind]
        rows.append((i, text, "en", "a", 1, None, None))
        labels.append((i, int(not bad), int(toxic)))
    labels += [(None, 1, 1), (3, None, None), (99_999, 0, 1), (7, labels[7][1], labels[7][2])]
    docs, all_rows = documents(spark, 0, 1, rows)
    return docs, all_rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: (q, t) for i, q, t in labels[:500]}


def test_quality(spark):
    docs, rows, labels, truth = labelled(spark)
    got = quality.score_quality(docs, labels).collect()
    assert len(got) == len(rows)
    held = [g for g in got if g["held_out"] and g["doc_id"] is not None and g["doc_id"] < 500]
    assert sum(g["predicted"] == truth[g["doc_id"]][0] for g in held) / len(held) > 0.95
    assert all(0 <= g["score"] <= 1 and g["predicted"] == (g["score"] >= 0.5) for g in got)
    alone = {r["doc_id"]: r["score"] for r in quality.score(docs.repartition(7), quality.fit(docs, labels)).collect()}
    assert all(abs(alone[g["doc_id"]] - g["score"]) < 1e-5 for g in held)
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert len(ids & {i for i, (q, _) in truth.items() if q == 0}) < 5
    none = spark.createDataFrame([], labels.schema)
    assert {r["score"] for r in quality.score_quality(docs, none).collect()} == {0.5}
    assert quality.accepted(docs, none).count() == len(rows)
    assert quality.score_quality(empty(spark), labels).count() == 0


def test_toxicity(spark):
    docs, rows, labels, truth = labelled(spark)
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == len(rows)
    held = [g for g in got if g["doc_id"] is not None and g["doc_id"] < 500 and g["held_out"]]
    assert all(g["held_out"] == (zlib.crc32(str("" if g["doc_id"] is None else g["doc_id"]).encode()) % 3 == 1) for g in got)
    assert sum(g["predicted"] == truth[g["doc_id"]][1] for g in held) / len(held) > 0.97
    assert all(g["predicted"] == 0 for g in got if g["doc_id"] is None or g["doc_id"] >= 10_000)
    kept = toxicity.accepted(docs, labels)
    assert kept.columns == docs.columns
    assert sum(truth[r["doc_id"]][1] for r in kept.where("doc_id < 500").collect()) <= 2
    none = spark.createDataFrame([], labels.schema)
    assert toxicity.accepted(docs, none).count() == len(rows)
    assert toxicity.score_toxicity(empty(spark), labels).count() == 0
    # categories that the caller names
    named = labels.withColumn("rude", F.when(F.col("toxic") == 1, (F.col("doc_id") % 2).cast("int")))
    by_name = toxicity.score_toxicity(docs, named, ["rude", "toxic"])
    assert by_name.columns == ["doc_id", "held_out", "rude", "toxic", "predicted"] and by_name.count() == len(rows)


def arrays(texts):
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])


def test_toxicity_chain_by_hand():
    """The chain against plain Python: words and beginnings, one model after the other."""
    r = random.Random(3)
    texts = [prose(r, r.choice(["en", "fr"]), r.randint(0, 40)) + r.choice(["", "", " You IDIOTS, all of you", " quel idiot"]) for _ in range(120)] + ["", "ß1x zz"]
    sample = toxicity.Sample(*toxicity.distinct_features(*arrays(texts)))
    toxic = np.array([float("idiot" in t.lower()) for t in texts], np.float32)
    y = np.stack((np.array([float("IDIOTS" in t) for t in texts], np.float32), toxic), axis=1)
    chain = toxicity.train(sample, y, ["loud", "toxic"])
    got = chain.predict(*arrays(texts))
    lower = {i: i + 32 for i in range(65, 91)}
    for text, row in zip(texts, got, strict=True):
        words = re.findall(rb"[a-z\x80-\xff]+", text.translate(lower).encode())
        seen = set(words) | {w[:n] + b"*" for w in words for n in (4, 5, 6) if len(w) >= n}
        columns = {int(chain.slot[feature_of(x)]) for x in seen} - {-1}
        base, earlier = int(chain.slot.max()) + 1, []
        for w, b in zip(chain.weights, chain.biases, strict=True):
            z = b + sum(float(w[c]) for c in columns) + sum(float(v) * p for v, p in zip(w[base:], earlier, strict=True))
            earlier.append(1 / (1 + math.exp(-z)))
        assert row == pytest.approx(earlier, abs=1e-5)
    assert ((got[:, 1] >= 0.5) == (toxic > 0)).all()


def feature_of(x):
    start = x.endswith(b"*")
    data = np.frombuffer(x.removesuffix(b"*"), np.uint8)
    key = hash_words(data, np.array([0]), np.array([len(data)]))[0]
    return int((int(key) * 2 + start) * 0x9E3779B97F4A7C15 % 2**64 >> 44)


def test_toxicity_folds_do_not_leak():
    """With labels that are noise, out-of-fold selection leaves the chain nothing to lean on."""
    r = random.Random(9)
    texts = [" ".join(f"w{r.randrange(4000)}" + "abcdefgh"[r.randrange(8)] * 4 for _ in range(30)) for _ in range(300)]
    y = np.array([[r.randrange(2), r.randrange(2)] for _ in texts], np.float32)
    chain = toxicity.train(toxicity.Sample(*toxicity.distinct_features(*arrays(texts))), y, ["a", "b"])
    assert abs(chain.weights[1][-1]) < 1.5


def test_kinds():
    texts = ["aaaa bbbb filler"] * 20 + ["cccc dddd other"] * 12 + ["eeee plain"] * 8 + ["clean text here"] * 60
    kinds = toxicity.kinds(toxicity.Sample(*toxicity.distinct_features(*arrays(texts))), np.array([1.0] * 40 + [0.0] * 60), 3)
    assert [len({tuple(k) for k in part}) for part in (kinds[:20], kinds[20:32], kinds[32:40])] == [1, 1, 1]
    assert len({tuple(k) for k in kinds[:40]}) == 3 and not kinds[40:].any()


def naive_network(net, text):
    """One window after the other."""
    data = [max(b, 1) for b in text]
    segments = (len(data) + quality._GAP + quality.SEGMENT - 1) // quality.SEGMENT
    data += [0] * ((segments + 1) * quality.SEGMENT - len(data))
    again = [any(i >= lag + 7 and data[i - 7 : i + 1] == data[i - 7 - lag : i + 1 - lag] for lag in range(3, quality.LAGS + 1)) and data[i] > 0 for i in range(len(data))]
    pooled = []
    for s in range(segments):
        best = np.zeros(quality.FILTERS)
        for at in range(s * quality.SEGMENT, (s + 1) * quality.SEGMENT, quality.STRIDE):
            if data[at] == 0:
                continue
            seen = [[*(net.bytes[data[i]][:-1] if data[i] else np.zeros(quality.CHANNELS - 1)), float(again[i])] for i in range(at, at + quality.BLOCKS * quality.STRIDE)]
            best = np.maximum(best, np.concatenate(seen) @ net.filters + net.bias)
        pooled.append(best)
    f = np.concatenate((np.max(pooled, axis=0), np.mean(pooled, axis=0)))
    return 1 / (1 + math.exp(-float(f @ net.out + net.out_bias[0])))


def test_quality_network_by_hand(monkeypatch):
    r = random.Random(4)
    net = quality.Network(3)
    net.out += np.random.default_rng(1).normal(0, 0.5, len(net.out)).astype(np.float32)
    texts = ["", "a", prose(r, "en", 60), "same same same " * 20, prose(r, "de", 200), "a\x00b"]
    got = net.predict(*arrays(texts))
    for text, p in zip(texts, got, strict=True):
        assert p == pytest.approx(naive_network(net, text.encode()), abs=1e-5)
    # in stretches
    monkeypatch.setattr(quality, "STRETCH", 512)
    assert net.predict(*arrays(texts[4:5]))[0] == pytest.approx(got[4], abs=1e-6)
    assert net.predict(*arrays(["same same same " * 200]))[0] == pytest.approx(naive_network(net, b"same same same " * 200), abs=1e-5)


def test_quality_gradients():
    r = random.Random(6)
    net = quality.Network(2)
    x, segments = quality.lay_out(*arrays([prose(r, "en", 80), prose(r, "fr", 30), "xyz"]))
    y = np.array([1, 0, 1], np.float32)

    def loss():
        f = net.features(net.pooled(x, quality.repeats(x)), segments)
        z = (f @ net.out + net.out_bias).astype(np.float64)
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    grads = net.gradients(x, quality.repeats(x), segments, y)
    for part, grad in zip(net.parts(), grads, strict=True):
        for at in np.argsort(-np.abs(grad.ravel()))[:4]:
            kept, step = part.flat[at], np.float32(2e-3)
            part.flat[at] = kept + step
            up = loss()
            part.flat[at] = kept - step
            down = loss()
            part.flat[at] = kept
            assert grad.flat[at] == pytest.approx((up - down) / (2 * step), rel=0.1, abs=1e-4)


def test_language_by_hand():
    """Grams, margins and loss-weighted decoding, counted one by one."""
    r = random.Random(2)
    texts = ["", "é", *[prose(r, k, 30) for k in ("en", "fr", "de")]]
    got = language_id.gram_features(*arrays(texts), 256)
    for text, row in zip(texts, got, strict=True):
        data = text.encode().lower()
        counts = np.zeros(256)
        for n in (1, 2, 3):
            for i in range(len(data) - n + 1):
                key = int.from_bytes(data[i : i + n], "big") + ((n - 1) << 24)
                counts[key * 0x9E3779B1 % 2**32 >> 24] += 1
        want = np.sqrt(counts)
        assert row == pytest.approx(want / max(np.linalg.norm(want), 1e-12), abs=1e-6)
    random_ = np.random.default_rng(0)
    model = language_id.Classifiers(["a", "b", "c", "d"], language_id.codewords(4), random_.normal(size=(256, 7)), random_.normal(size=7))
    best, vote, lead = model.decode(got)
    for row, b, v, ahead in zip(got, best, vote, lead, strict=True):
        margins = [sum(float(row[i]) * model.weights[i][j] for i in range(256)) + model.bias[j] for j in range(7)]
        losses = [sum(math.log1p(math.exp(-m * c)) for m, c in zip(margins, code, strict=True)) for code in model.codes]
        share = [math.exp(-x) for x in losses]
        share = [x / sum(share) for x in share]
        assert int(b) == losses.index(min(losses)) and v == pytest.approx(max(share)) and ahead == pytest.approx(sorted(share)[-1] - sorted(share)[-2])


def peak_mb(body):
    tracemalloc.start()
    body()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most / 1e6


def test_memory_does_not_grow_with_texts():
    """One very long text, and very many empty ones, stay far below what they'd take if laid out at once."""
    long, bounds = np.frombuffer(b"some words of a text " * 1_000_000, np.uint8), np.array([0, 21_000_000])
    net = quality.Network()
    assert peak_mb(lambda: net.predict(long, bounds)) < 150
    assert peak_mb(lambda: language_id.gram_features(long, bounds)) < 150
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(10_000)), "text": [""] * 9_999 + ["x"]})
    parts = lambda rows: text_slices(iter([batch]), most_rows=rows)
    assert peak_mb(lambda: [net.predict(p.data, p.offsets) for p in parts(4096)]) < 300
    assert peak_mb(lambda: [language_id.gram_features(p.data, p.offsets).shape for p in parts(language_id.SLICE_ROWS)]) < 150


def test_long_texts_stay_in_the_sample(spark):
    """Long texts are fitted on, and a language of few rows is learned among many."""
    r = random.Random(12)
    rows = [(i, prose(r, "en", 20), "en") for i in range(400)] + [(1000 + i, prose(r, "fr", 20_000), "fr") for i in range(6)] + [(7, "zweiter Text", "en")]
    docs = spark.createDataFrame([(i, t, k, "a", 1, None, None) for i, t, k in rows], "doc_id long, text string, lang string, source string, n_chars long, score string, n string")
    model = language_id.fit(docs, fit_rows=40)
    assert model.languages == ["en", "fr"]
    got = language_id.identify(docs, model).collect()
    assert all(g["lang_pred"] == "fr" for g in got if g["doc_id"] >= 1000)
