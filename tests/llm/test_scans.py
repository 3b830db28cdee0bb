"""License scans and LM scoring against plain Python."""

import math
import re
import zlib
from collections import Counter
from random import Random

import numpy as np
import pytest

from factmill.llm import licenses, lm_scoring

from .helpers import documents, empty, prose

LOWER = {i: i + 32 for i in range(65, 91)}
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = ["MIT License", "the MIT\nLicense, mit license. Apache-License 2", "amit license", "mit licenses", "GNU General Public License v3; general public  license", "mit", "license", "Relaesed under the MIT Licence.", "Licensed under teh Apache Licence, Version 2.0!", "Licensed under CC BY-NC 4.0.", "Licensd under CC BY-NC 4.0", "the general public licence", "an MIT licence", "a bit license, permit license", "x " * 500 + "Permission is hereby granted, free of charge, to any person obtaining a copy" + " y" * 500]


def test_licenses(spark):
    docs, rows = documents(spark, 20, 4, [(i + 500, t, None, None, None, None, None) for i, t in enumerate(TEXTS)])
    got = licenses.scan_licenses(docs).collect()
    assert len(got) == len(rows)
    text_of = {r[0]: r[1] for r in rows}
    for g in got:
        words = WORDS.findall((text_of[g["doc_id"]] or "").translate(LOWER))
        found = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        assert g["n_words"] == len(words)
        assert g["n_base"] == len(found)
        assert g["first_word"] == (min(found)[0] if found else None) and g["last_word"] == (max(found)[0] if found else None)
        assert g["base_labels"] == ",".join(sorted({label for _, label in found}))
        assert {label for _, label in found} <= set(g["labels"].split(","))
        assert (g["score"] == 1) >= bool(found) and 0 <= g["score"] <= 1
        for s in g["spans"]:
            shown = " ".join(words[s["first_word"] : s["last_word"] + 1])
            assert edits(shown, s["notice"]) <= s["edits"] + 6
    labels = {g["doc_id"]: g["labels"] for g in got}
    assert labels[507] == "mit" and labels[508] == "apache" and labels[509] == labels[510] == "cc-by-nc" and labels[511] == "gpl" and labels[512] == "mit" and labels[513] == "" and labels[514] == "mit"
    assert licenses.scan_licenses(empty(spark)).count() == 0


def fuzzy(words, notice, most):
    """Whether some run of whole words is within ``most`` edits of the notice, tried one by one."""
    n = len(notice.split())
    head = licenses.UNCHANGED.get(notice, "")
    runs = (" ".join(words[i:j]) for i in range(len(words)) for j in range(i + 1, min(len(words), i + n + most + 1) + 1))
    return any(abs(len(x) - len(notice)) <= most and x.startswith(head) and edits(x[len(head) :], notice[len(head) :]) <= most for x in runs)


def test_labels_against_unseeded_search(spark):
    """Misspelt notices among other words: the labels are those of a search that tries every place."""
    r, texts = Random(11), []
    for i in range(150):
        label, notice, most = licenses.NOTICES[i % len(licenses.NOTICES)]
        for _ in range(r.randint(0, most + 2)):
            at = r.randrange(len(notice))
            notice = r.choice([notice[:at] + notice[at + 1 :], notice[:at] + r.choice("aeq ") + notice[at:], notice[:at] + "x" + notice[at + 1 :]])
        texts.append(f"{prose(r, 'en', r.randint(0, 8))} {notice} {prose(r, 'en', r.randint(0, 8))}")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for g in licenses.scan_licenses(docs).collect():
        words = WORDS.findall(texts[g["doc_id"]].translate(LOWER))
        want = {label for label, notice, most in licenses.NOTICES if fuzzy(words, notice, most)}
        assert g["labels"] == ",".join(sorted(want | set(filter(None, g["base_labels"].split(","))))), texts[g["doc_id"]]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_every_edit_is_found():
    """All single and some double edits of a notice, as pigeonhole promises."""
    label, notice, most = licenses.NOTICES[0]
    for at in range(1, len(notice) - 1):
        for changed in (notice[:at] + "q" + notice[at:], notice[:at] + notice[at + 1 :], notice[:at] + "z" + notice[at + 1 :], notice[: at - 1] + notice[at] + notice[at - 1] + notice[at + 1 :]):
            data = np.frombuffer(f"aa {changed} bb".encode(), np.uint8)
            text, bounds = licenses.normalise(data, np.array([0, len(data)]))
            _, spans = licenses.scan_batch(text, bounds, {}, ((label, notice, most),))
            assert spans, changed


def ppm(counts, context, byte, order):
    """The definition, word by word: escape to the shorter context without the bytes seen."""
    def spread(ctx):
        if ctx is None:
            return {b: 1 / 256 for b in range(256)}
        seen = counts.get(ctx)
        lower = spread(ctx[1:] if ctx else None)
        if not seen:
            return lower
        n, d = sum(seen.values()), len(seen)
        rest = {b: p for b, p in lower.items() if b not in seen}
        left = sum(rest.values())
        escape = d / (n + d) if left > 0 else 0
        return {b: (1 - escape) * seen[b] / n if b in seen else escape * rest[b] / left for b in range(256)}

    return spread(context[-order:])[byte]


@pytest.mark.parametrize("hot_words", [0, 20, 1 << 18])
def test_lm(spark, hot_words):
    docs, rows = documents(spark, 60, 6)
    rows = [r for r in rows if len(r[1] or "") < 2000]
    docs = docs.where("length(text) < 2000 or text is null")
    order = 2
    got = lm_scoring.score_documents(docs, order=order, min_share=0.0, hot_words=hot_words).collect()
    assert len(got) == len(rows)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    words, grams = Counter(), {}
    for r in rows:
        if held(r[0]):
            continue
        words.update([*tokens(r[1]), None])
        data = [255] * order + list((r[1] or "").translate(LOWER).encode()) + [255]
        for i in range(order, len(data)):
            for k in range(order + 1):
                grams.setdefault(tuple(data[i - k : i]), Counter())[data[i]] += 1
    n, v = sum(words.values()), len(words)
    text_of = {r[0]: r[1] for r in rows}
    for g in got:
        own = [*tokens(text_of[g["doc_id"]]), None]
        assert g["held_out"] == held(g["doc_id"]) and g["n_tokens"] == len(own) and g["train_tokens"] == n
        assert g["n_known"] == sum(words[w] > 0 for w in own)
        assert g["base_score"] == pytest.approx(sum(math.log10((words[w] + 1) / (n + v + 1)) for w in own))
    for g in got[:12]:
        data = [255] * order + list((text_of[g["doc_id"]] or "").translate(LOWER).encode()) + [255]
        want = sum(math.log10(ppm(grams, tuple(data[:i]), data[i], order)) for i in range(order, min(len(data), 400)))
        if len(data) <= 400:
            assert g["score"] == pytest.approx(want, rel=1e-4)
    assert lm_scoring.score_documents(empty(spark)).count() == 0


@pytest.mark.parametrize("options", [{}, {"hot_grams": 0}, {"hot_grams": 300, "hot_words": 20}])
def test_lm_keeps_rare_contexts(spark, options):
    """A few rare texts among many common ones, with the production order and no cut."""
    random = Random(3)
    rows = [(i, prose(random, "en", 120)) for i in range(600)] + [(i, prose(random, "de", 12)) for i in range(600, 630)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    order, grams = lm_scoring.MAX_ORDER, {}
    for i, text in rows:
        data = [255] * order + list(text.translate(LOWER).encode()) + [255]
        for at in range(order, len(data) if zlib.crc32(str(i).encode()) % 7 != 2 else 0):
            for k in range(order + 1):
                grams.setdefault(tuple(data[at - k : at]), Counter())[data[at]] += 1
    got = {r["doc_id"]: r for r in lm_scoring.score_documents(docs, **options).collect()}
    assert len(got) == len(rows) and any(got[i]["held_out"] for i, _ in rows[600:])
    for i, text in rows[600:]:
        data = [255] * order + list(text.translate(LOWER).encode()) + [255]
        want = sum(math.log10(ppm(grams, tuple(data[:at]), data[at], order)) for at in range(order, len(data)))
        assert got[i]["score"] == pytest.approx(want, rel=1e-6)


def test_shares_add_up():
    random = np.random.default_rng(0)
    levels = []
    code = random.integers(97, 103, (500, 3))
    for k in range(3):
        context = sum(code[:, 2 - j - 1].astype(np.int64) << 8 * j for j in range(k)) if k else np.zeros(500, np.int64)
        pairs, n = np.unique(np.stack([context, code[:, 2]]), axis=1, return_counts=True)
        levels.append((pairs[0], pairs[1], n))
    trie = lm_scoring.build_trie(levels)
    assert np.allclose((10.0 ** trie.logp.astype(float)).sum(1), 1, atol=1e-4)
