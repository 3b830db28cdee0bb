"""Folding by clusters gives what folding record by record gives."""

import json
import random

import pytest

from factmill.operators import clusters, dedup, elements

SCHEMA = "split string, key string, source string, record_id string, row long, elements string, evidence array<int>"


def some_element(r, kind):
    x = r.choice([0.0, 20.0, 40.0]) + (r.choice([0, 0.5, 1, 1.5, 2.0]) if kind == "chains" else r.choice([0, 0.25]))
    e = {"label": "a", "bbox": r.choice([[x, 0.0, x + 9, 5.0]] * 8 + [None, [x, 30.0, x + 9, 35.0]]), "series": r.choice([None, "s"]), "value_provenance": r.choice(["table", "unknown", None, "other"])}
    if kind == "conflicts":
        e["label"] = r.choice(["a"] * 8 + ["b", None])
        e["unit"] = r.choice([None] * 6 + ["%", "m"])
    if kind == "fields":
        e[r.choice(["note", "area"])] = r.choice(["p", "q"])
        if r.random() < 0.3:
            del e["series"]
    items = list(e.items())
    r.shuffle(items)
    return dict(items)


def some_group(r, kind, key, n):
    own, marking = [some_element(r, kind) for _ in range(4)], kind == "marks" or r.random() < 0.15
    out = []
    for i in range(n):
        listed = [e if r.random() < 0.8 else some_element(r, kind) for e in r.sample(own, r.randint(0, 4))]
        marks = None if not marking or r.random() < 0.4 else sorted(r.sample(range(len(listed)), min(len(listed), r.randint(0, 2)))) if kind == "marks" else [j for j, e in enumerate(listed) if e["bbox"] == own[0]["bbox"]][:1]
        if kind == "same marks":
            listed, marks = [*own], [0] if r.random() < 0.7 else None
        out.append(("train", key, r.choice(["annotated", "grounded", "else"]), r.choice([f"r{i}", None]), i if r.random() < 0.9 else None, json.dumps(listed) if listed or r.random() < 0.5 else None, marks))
    return out


def shown(rows):
    return {(g["split"], g["key"]): (json.loads(g["elements"]) if g["elements"] else None, g["evidence"], g["conflict"]) for g in rows.collect()}


def test_groups_of_all_kinds(spark):
    r = random.Random(11)
    kinds = ["plain", "chains", "conflicts", "fields", "marks", "same marks"]
    rows = []
    for k in range(120):
        group = some_group(r, kinds[k % len(kinds)], f"k{k:03}", r.choice([1, 2, 3, 8, 25]))
        # the order of a group must be total
        rows += list({(g[2], g[3], g[4]): g for g in group}.values())
    r.shuffle(rows)
    records = spark.createDataFrame(rows, SCHEMA).repartition(3)
    one, parts = shown(dedup.merge_elements(records)), shown(dedup.merge_elements(records, many=1))
    assert set(one) == set(parts)
    for key in one:
        assert parts[key] == one[key], key
    assert {v[2] for v in one.values()} >= {None, "element label", "evidence"} and any(v[1] for v in one.values())


def test_large_and_small_groups_together(spark):
    r = random.Random(12)
    rows = [(*g[:3], f"r{i}", i, *g[5:]) for i, g in enumerate(some_group(r, "plain", "big", 60))] + [("val", "small", "annotated", "x", 1, json.dumps([some_element(r, "plain")]), [0])]
    records = spark.createDataFrame(rows, SCHEMA)
    assert shown(dedup.merge_elements(records, many=20)) == shown(dedup.merge_elements(records))


def test_clusters_are_apart(spark):
    """Boxes within the slack are in one cluster; boxes of one cluster are connected in each side's sweep."""
    r = random.Random(13)
    rows = [("t", r.choice(["k", None]), *[float(r.choice([0, 10, 50]) + r.choice([0, 0.4, 1, 1.4, 3])) for _ in range(4)], None) for _ in range(200)]
    table = spark.createDataFrame(rows, "split string, _key string, x1 double, y1 double, x2 double, y2 double, named string")
    got = clusters.with_clusters(table).collect()
    assert len(got) == len(rows) and len({g["cluster"] for g in got}) > 20
    for a in got:
        for b in got:
            if a["_key"] == b["_key"] and all(abs(a[s] - b[s]) <= 1 for s in ("x1", "y1", "x2", "y2")):
                assert a["cluster"] == b["cluster"]


def test_most_of_a_large_key_needs_no_order(spark):
    """Copies by the thousand are added up: what is folded record by record are the clusters that chain."""
    boxes = [{"label": f"l{i}", "bbox": [i * 10.0, 0.0, i * 10.0 + 5, 5.0]} for i in range(50)]
    rows = [("train", "k", "annotated", f"r{i:05}", i, json.dumps([boxes[i % 50], boxes[i * 7 % 50]]), None) for i in range(2000)]
    rows += [("train", "k", "annotated", f"s{i}", i, json.dumps([{"label": "c", "bbox": [900.0 + i % 3, 0.0, 950.0, 5.0]}]), None) for i in range(9)]
    records = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert shown(dedup.merge_elements(records, many=100)) == shown(dedup.merge_elements(records))


def test_fold_of_one_cluster():
    """A record that marks evidence but has nothing here contradicts marks here; where nothing is marked it doesn't."""
    e = {"label": "a", "bbox": [0.0, 0.0, 5.0, 5.0]}
    assert clusters.fold_cluster([(0, 0, [e], [0]), (2, 2, [e], [0])], 3, 3)[2] == [(None, 1, 1, "", "evidence")]
    assert clusters.fold_cluster([(0, 0, [e], [0])], 3, 2)[2] == [(None, 1, 1, "", "evidence")]
    assert clusters.fold_cluster([(0, 0, [e], [0]), (2, 1, [e], [0])], 3, 2) == ([e], [0], [])
    assert clusters.fold_cluster([(0, 0, [e], []), (2, 2, [e], [])], 4, 4) == ([e], [], [])
    assert clusters.fold_cluster([(1, 1, [e], [0])], 2, 2)[2] == [(1, None, 1, "", "evidence")]
    with pytest.raises(elements.Conflict):
        elements.merge_two([e], [e | {"label": "b"}], (None, None))
    assert clusters.fold_cluster([(0, None, [e, e | {"label": "b"}], [])], 2, 0)[2] == [(1, None, 0, elements._text(e), "element label")]
