"""Operators that SQL can't say, each against plain Python on small tables."""

import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factmill.functions import geometry, json_tools
from factmill.operators import align, elements, facts, keyed, metrics, mixture
from factmill.plans import mining


def overlap(a, b):
    wide, high = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(0, wide) * max(0, high)
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    return both / (area(a) + area(b) - both)


def test_detections(spark):
    """The greedy match, one detection after the other; of equal overlaps the later truth."""
    r = random.Random(1)
    box = lambda: [float(x := r.randint(0, 6)), float(y := r.randint(0, 6)), float(x + r.randint(3, 6)), float(y + r.randint(3, 6))]
    found = [(i, s, r.choice([0.1, 0.5, 0.9]), box()) for i in range(40) for s in range(r.randint(0, 6))]
    there = [(i, s, box()) for i in range(40) for s in range(r.randint(0, 4))]
    there += [(39, 9, there[-1][2])] if there[-1][0] == 39 else []
    want = set()
    for image in range(40):
        free = {s: b for i, s, b in there if i == image}
        for _, s, score, b in sorted((f for f in found if f[0] == image), key=lambda f: (-f[2], f[1])):
            best = max(free, key=lambda t: (overlap(b, free[t]), t), default=None)
            hit = best is not None and overlap(b, free[best]) >= 0.5
            want.add((image, s, hit))
            if hit:
                del free[best]
    got = metrics.match_detections(spark.createDataFrame(found, "image int, seq long, score double, bbox array<double>"), spark.createDataFrame(there, "image int, seq long, bbox array<double>"))
    assert {(g["image"], g["seq"], g["hit"]) for g in got.collect()} == want


def test_union_of_boxes(spark):
    r = random.Random(2)
    sets = [[[float(r.randint(0, 3)) / 2 + d for d in (0, 0, 5, 5)] for _ in range(r.randint(1, 9))] for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(sets)), "i int, boxes array<array<double>>").select("i", geometry.union_boxes(F.col("boxes")).alias("u"))
    for g in rows.collect():
        kept = []
        for b in sorted(sets[g["i"]]):
            if not any(all(abs(x - y) <= 1 for x, y in zip(b, k, strict=True)) for k in kept):
                kept.append(b)
        assert g["u"] == kept


def test_context(spark):
    """Context elements admitted one by one."""
    r = random.Random(3)
    make = lambda: (r.choice("ab"), r.choice(["s", "t", None]), [float(r.randint(0, 3))] * 4, r.random() < 0.2)
    cases = [([make() for _ in range(r.randint(0, 3))], [make() for _ in range(r.randint(0, 5))]) for _ in range(80)]

    def names(chosen):
        labels = [e[0] for e in chosen]
        return [f"{e[1]} · {e[0]}" if labels.count(e[0]) > 1 and e[1] else e[0] for e in chosen]

    kind = "array<struct<label:string,series:string,bbox:array<double>,conflict:boolean>>"
    rows = spark.createDataFrame([(i, m, c) for i, (m, c) in enumerate(cases)], f"i int, m {kind}, c {kind}")
    for g in rows.select("i", facts.admit_context(F.col("m"), F.col("c")).alias("s")).select("i", "s.*").collect():
        marked, context = cases[g["i"]]
        kept, count = [], [0, 0, 0]
        for e in context:
            if any(m[2] == e[2] for m in marked):
                continue
            trial, before = names(marked + kept + [e]), names(marked + kept)
            n = len(marked)
            bad = 0 if n and trial[:n] != before[:n] else 1 if len(set(trial)) < len(trial) else 2 if e[3] else None
            if bad is None:
                kept.append(e)
            else:
                count[bad] += 1
        assert [(k["label"], k["series"], k["bbox"]) for k in g["kept"]] == [e[:3] for e in kept]
        assert [g["renames"], g["ambiguous"], g["conflicts"]] == count


def test_merging_by_pairs():
    """Elements of two records: every pair at one place becomes one, and nothing else does."""
    r = random.Random(4)
    for _ in range(200):
        sides = [[{"label": r.choice([None, "a"]), "bbox": r.choice([None, [x := r.choice([0.0, 4.0, 8.0]), 0.0, x + 2, 2.0]]), "value_provenance": r.choice(["table", "unknown"])} for _ in range(r.randint(0, 4))] for _ in range(2)]
        merged, evidence = elements.merge_two(*sides, ([0] if sides[0] else None, None))
        text = lambda e: json.dumps(e, sort_keys=True)
        kinds = {json.dumps(e["bbox"]) if e["bbox"] else text(e) for e in itertools.chain(*sides)}
        assert len(merged) == len(kinds)
        for e in itertools.chain(*sides):
            own = [m for m in merged if (m["bbox"] == e["bbox"] if e["bbox"] else text(m) == text(e))]
            assert len(own) == 1 and (e["label"] is None or own[0]["label"] == e["label"])
            assert own[0]["value_provenance"] == "table" or e["value_provenance"] == "unknown"
        if sides[0]:
            first = sides[0][0]
            assert evidence == [i for i, m in enumerate(merged) if (m["bbox"] == first["bbox"] if first["bbox"] else text(m) == text(first))]
    with pytest.raises(elements.Conflict):
        elements.merge_two([{"label": "a", "bbox": [0, 0, 1, 1]}], [{"label": "b", "bbox": [0, 0, 1, 1]}], (None, None))


def test_interval(spark):
    """Close to what drawing with replacement gives, and the same however rows are dealt out."""
    random_ = np.random.default_rng(5)
    values = random_.normal(10, 3, 400)
    table = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i long, x double")
    got = [metrics.bootstrap_interval(table.repartition(n), "x", resamples=2000).first() for n in (2, 5)]
    assert got[0]["low"] == pytest.approx(got[1]["low"], rel=1e-9) and got[0]["high"] == pytest.approx(got[1]["high"], rel=1e-9)
    means = random_.choice(values, (2000, 400)).mean(1)
    assert got[0]["mean"] == pytest.approx(values.mean())
    assert [got[0]["low"], got[0]["high"]] == pytest.approx(np.percentile(means, [2.5, 97.5]), abs=0.06)


def test_intervals_of_few_and_of_many_values(spark, monkeypatch):
    """Zeros and ones are two rows, drawn once for all that are equal; blocks, and no values at all."""
    random_ = np.random.default_rng(6)
    ones = spark.range(3000).select((F.col("id") % 10 == 0).cast("int").alias("x"))
    got = metrics.bootstrap_interval(ones.unionByName(spark.range(50).select(F.lit(None).cast("int").alias("x"))), "x", resamples=4000).first()
    means = random_.binomial(3000, 0.1, 4000) / 3000
    assert got["mean"] == pytest.approx(0.1) and [got["low"], got["high"]] == pytest.approx(np.percentile(means, [2.5, 97.5]), abs=0.0015)
    monkeypatch.setattr(metrics, "BLOCK", 50)
    values = np.repeat(random_.normal(10, 3, 600), random_.integers(1, 40, 600))
    got = metrics.bootstrap_interval(spark.createDataFrame([(float(v),) for v in values], "x double"), "x", resamples=2000, alpha=0.1).first()
    means = random_.choice(values, (2000, len(values))).mean(1)
    assert got["mean"] == pytest.approx(values.mean()) and [got["low"], got["high"]] == pytest.approx(np.percentile(means, [5, 95]), abs=0.02)
    assert tuple(metrics.bootstrap_interval(ones.where("x > 1"), "x", resamples=10).first()) == (None, None, None)


def test_drawn_sums():
    """Single rows drawn together, and values of a count drawn by it, have the mean and spread of one Poisson number for each row."""
    for counts in (np.ones(50, np.int64), np.full(50, 100), np.array([1, 30] * 25)):
        values = np.linspace(-1, 3, 50)
        total, size = metrics.resampled_sums(values, counts, 20_000, [1, 2])
        n = counts.sum()
        assert size.mean() == pytest.approx(n, rel=0.02) and size.var() == pytest.approx(n, rel=0.05)
        assert total.mean() == pytest.approx((values * counts).sum(), rel=0.03) and total.var() == pytest.approx((values**2 * counts).sum(), rel=0.05)


def test_average_precisions_of_groups(spark):
    """Each group's mean of best precisions, by definition; ties, a group without detections, one without truths."""
    r = random.Random(8)
    hits = [([g for g in ("all", "a", "b") if g == "all" or r.random() < 0.5], r.choice([0.1, 0.2, 0.5, r.random()]), r.randrange(20), i, r.random() < 0.6) for i in range(150)]
    truths = {"all": 120, "a": 40, "b": 200, "none": 5, "no truths": 0}
    want = {}
    for group, n in truths.items():
        own = sorted((h for h in hits if group in h[0]), key=lambda h: (-h[1], h[2], h[3]))
        curve, found = [], 0
        for place, h in enumerate(own, 1):
            found += h[4]
            curve.append((found / n, found / place))
        want[group] = sum(max([p for x, p in curve if math.floor(x * 100 + 1e-9) >= level], default=0.0) for level in range(101)) / 101
    table = spark.createDataFrame(hits, "groups array<string>, score double, image long, seq long, hit boolean").repartition(4)
    got = metrics.average_precisions(table, spark.createDataFrame(list(truths.items()), "group string, truths long"))
    assert {g["group"]: pytest.approx(g["ap"]) for g in got.collect()} == want


def test_places_with_ties(spark):
    """Dense, in order, and the same in every run, though most rows share a value."""
    rows = [(1 if i % 5 else i, i) for i in range(500)]
    table = spark.createDataFrame(rows, "k long, i long")
    runs = [sorted((g["_place"], g["k"], g["i"]) for g in keyed.numbered(table.repartition(n), "k").collect()) for n in (2, 7)]
    assert runs[0] == runs[1]
    assert [p for p, _, _ in runs[0]] == list(range(500)) and [k for _, k, _ in runs[0]] == sorted(k for k, _ in rows)


def test_lengths_fall_back(spark):
    def count(values):
        if "bad" in values:
            raise ValueError
        return [len(v) for v in values]

    rows = spark.createDataFrame([(v,) for v in ("a", "bad", "cccc", "dd")], "t string").coalesce(1)
    assert sorted(r["t"] for r in mixture.within_length(rows, "t", count, 3).collect()) == ["a", "dd"]


def test_attempts_at_json():
    record = '{"answerable": true, "facts": [], "evidence_refs": [], "plan": null, "model_answer": "1"}'
    cases = {
        f"Sure: {record} done": ["extracted the outermost JSON object"],
        record.replace('"', "“", 1).replace('"', "”"): ["normalised quotes"],
        record.replace("[],", '[]",', 1): ["removed stray quote after an array"],
        record.replace("[],", '[]",', 1)[:-1] + ",}": ["removed stray quote after an array", "removed trailing comma"],
        f"```\n{record[:-1]},}}\n```": ["extracted the outermost JSON object", "removed trailing comma"],
    }
    for text, repairs in cases.items():
        got = json_tools.read_record(text)
        assert got["ok"] and sorted(json.loads(got["json"])) == sorted(json_tools.REQUIRED), text
        if "```" not in text:
            assert got["repairs"] == repairs
    assert json_tools.read_record('{"plan": 1}')["reason"].startswith("lacks") and not json_tools.read_record(f"{record} {record}")["ok"]


def test_context_names(spark):
    """Context elements taken one by one, names made anew at each step."""
    r = random.Random(5)
    some = lambda n: [(r.choice(["a", "b", "s · a", None]), r.choice(["s", "t", "", None]), r.random() < 0.2) for _ in range(r.randint(0, n))]
    rows = [(i, some(2), some(6)) for i in range(150)]

    def names(es):
        count = lambda x: sum(e[0] == x for e in es)
        return [f"{s} · {x}" if x is not None and count(x) > 1 and s else x for x, s, _ in es]

    def admitted(marked, context):
        kept, refused = [], [0, 0, 0]
        for e in context:
            now = names(marked + kept + [e])
            bad = 0 if now[: len(marked)] != names(marked + kept)[: len(marked)] else 1 if len(set(now)) < len(now) else 2 if e[2] else None
            if bad is None:
                kept.append(e)
            else:
                refused[bad] += 1
        return [(x, s) for x, s, _ in kept], *refused

    of = "array<struct<label:string,series:string,conflict:boolean>>"
    df = spark.createDataFrame(rows, f"i int, m {of}, c {of}")
    boxed = lambda c, x: F.transform(c, lambda e: F.struct(e["label"].alias("label"), e["series"].alias("series"), F.array(F.lit(x)).alias("bbox"), e["conflict"].alias("conflict")))
    got = df.select("i", facts.admit_context(boxed("m", 0.0), boxed("c", 1.0)).alias("s")).collect()
    assert {g["i"]: ([(k["label"], k["series"]) for k in g["s"]["kept"]], g["s"]["renames"], g["s"]["ambiguous"], g["s"]["conflicts"]) for g in got} == {i: admitted(m, c) for i, m, c in rows}


def test_best_elements_without_sorted_pairs(spark):
    """Ties go to the smaller index, a lone element leads by its overlap; no pair of box and element is sorted."""
    box = [0.0, 0.0, 10.0, 10.0]
    boxes = spark.createDataFrame([(1, 1, box), (2, 1, box), (3, 1, box)], "record_id long, box_index int, bbox array<double>")
    elements = spark.createDataFrame([(1, 2, box), (1, 1, box), (2, 1, [0.0, 0.0, 5.0, 10.0]), (2, 2, None)], "record_id long, element_index int, bbox array<double>")
    found = align.best_matches(boxes, elements)
    assert sorted(map(tuple, found.collect())) == [(1, 1, 1, 1.0, 0.0), (2, 1, 1, 0.5, 0.5)]
    assert "box_index ASC" not in found._jdf.queryExecution().toString() and "iou DESC" not in found._jdf.queryExecution().toString()


def test_alike_rows_are_judged_once(spark):
    """A row that stands for several counts as often; replies alike but for their id become one row."""
    rows = spark.createDataFrame([(True, 3), (False, 1)], "ok boolean, n long")
    ok = F.col("ok")
    assert tuple(metrics.plan_statistics(rows, ok, ok, ok, ok, ok, ok, F.col("n")).collect()[0]) == (3, 3, 3, 0.75, 0.75)
    assert tuple(metrics.plan_statistics(rows.where("n > 9"), ok, ok, ok, ok, ok, ok, F.col("n")).collect()[0]) == (0, 0, 0, 0.0, 0.0)
    replies = spark.createDataFrame([("a", "q", None), ("b", "q", None), ("c", "q", "no")], "record_id string, question string, reply string").selectExpr("*", "'3' AS answer", "array(named_struct('label', 'a', 'num', 3D)) AS elements", "array(0) AS evidence")
    assert sorted((r["reply"] or "", r["n"]) for r in mining.counted(replies).collect()) == [("", 2), ("no", 1)]
