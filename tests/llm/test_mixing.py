import pytest

from factmill.llm import mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string"


def brute_targets(sizes: dict, weights=(3, 1, 2), share=1.5, most=2.0) -> dict:
    order = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = share * sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        free = sum(w[s] for s in order if s not in full)
        target = {s: most * sizes[s] if s in full else left * w[s] / free for s in order}
        over = {s for s in order if s not in full and target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def rows(spark, n=300):
    import random

    r = random.Random(4)
    out = []
    for i in range(n):
        source = r.choice(["a", "a", "a", "b", "c", "d", "é", None])
        out.append((i, " ".join("x" * r.randint(1, 5) for _ in range(r.randint(0, 40))), None, source, None, "clash"))
    out += [(None, None, None, "a", 3, None), (n, "", "en", "e", 0, None), (5, out[5][1], None, out[5][3], None, None)]
    return spark.createDataFrame(out, DOCS), out


@pytest.mark.parametrize("range_rows", [7, 100000])
def test_targets_and_budgets(spark, range_rows):
    docs, raw = rows(spark)
    got = mixing.mix_sources(docs, range_rows=range_rows).collect()
    assert len(got) == len(raw)
    sizes = {}
    for _, text, _, source, _, _ in raw:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    target = brute_targets(sizes)
    taken = {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, n in taken.items():
        assert abs(n - target[s]) < 1.001
    again = mixing.mix_sources(docs.repartition(5), range_rows=11)
    assert sorted(map(str, again.collect())) == sorted(map(str, got))


def test_empty(spark):
    assert mixing.mix_sources(spark.createDataFrame([], DOCS)).count() == 0


def test_documents_repeat(spark):
    docs, raw = rows(spark)
    out = mixing.mixed_documents(docs, docs.columns)
    assert out.columns == docs.columns
    words = sum(len(r["text"].split()) for r in out.collect())
    total = sum(len((t[1] or "").split()) for t in raw)
    assert abs(words - 1.5 * total) < 0.05 * total
