"""Tables with every awkward case: nulls, empty and long texts, ties, repeated rows, odd columns."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, n string"
SYLLABLES = {"en": "the of and th er on an re he in ed nd ha at en".split(), "fr": "le la de ou eau eux ien ré tre men".split(), "de": "der die und ung sch ich ein ver keit zu".split()}


def word(r, lang):
    return "".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 4)))


def prose(r, lang, n):
    return " ".join(word(r, lang) for _ in range(n)).capitalize() + "."


def awkward(first=10_000):
    rows = [(first, None), (first + 1, ""), (first + 2, " \n\t "), (first + 3, "%%% $$$ 12 34"), (first + 4, "x" * 50_000), (first + 5, "Wort " * 30_000), (None, "No id here."), (first + 6, "ÀÉ ß İ 漢字"), (first + 7, "a\u0000b c")]
    out = [(i, t, None, None, None, "x", None) for i, t in rows]
    return out + [out[1], out[4]]


def documents(spark, n=200, seed=1, extra=()):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lang = r.choice(["en", "en", "fr", "de"])
        rows.append((i, prose(r, lang, r.randint(1, 120)), lang, r.choice(["a", "a", "b", None]), 1, "clash", None))
    rows += awkward() + list(extra)
    return spark.createDataFrame(rows, DOCS).repartition(3), rows


def empty(spark):
    return spark.createDataFrame([], DOCS)
