"""Golden cases of the plan language, through both evaluators."""

import json

import pytest
from pyspark.sql import functions as F

from factmill.plans import compile as plans
from factmill.plans import nodes, verify

FACTS = [("f1", "2019", 245.0, None, None), ("f2", "2018", 210.0, None, None), ("f3", "2017", 210.0, None, None), ("f4", "S · 2019 · x", None, "12%", "%"), ("f5", "words", None, "n/a", None)]
SCHEMA = "id string, label string, num double, str string, unit string"


def refs(*ids):
    return [{"ref": f"f{i}"} for i in ids]


def op(name, args, **extra):
    return {"op": name, "args": args, **extra}


WHERE = {"compare": "greater"}
CASES = [
    (op("lookup", refs(1)), 245.0, None, None),
    (op("lookup", refs(4)), None, "12%", None),
    (op("label_of", refs(2)), None, "2018", None),
    (op("difference", refs(1, 2)), 35.0, None, None),
    (op("absolute_difference", refs(2, 1)), 35.0, None, None),
    (op("ratio", refs(1, 2)), 245 / 210, None, None),
    (op("percentage", refs(1, 2)), 100 * 245 / 210, None, None),
    (op("percent_change", refs(1, 2)), 100 * 35 / 210, None, None),
    (op("percent_change", [{"ref": "f1"}, op("difference", refs(2, 3))]), None, None, "division by zero"),
    (op("sum", refs(1, 2, 3)), 665.0, None, None),
    (op("mean", refs(1, 2)), 227.5, None, None),
    (op("median", refs(1, 2, 3)), 210.0, None, None),
    (op("median", refs(1, 2)), 227.5, None, None),
    (op("min", refs(1, 2)), 210.0, None, None),
    (op("max", refs(1, 2)), 245.0, None, None),
    (op("argmax", refs(1, 2, 3)), None, "2019", None),
    (op("argmin", refs(1, 2, 3)), None, None, "tie"),
    (op("count", refs(1, 1, 2)), 3.0, None, None),
    (op("trend", refs(3, 2, 1)), None, "mixed", None),
    (op("trend", refs(2, 3)), None, "flat", None),
    (op("trend", refs(2, 1)), None, "increasing", None),
    (op("trend", refs(1, 2)), None, "decreasing", None),
    (op("compare", refs(2, 3)), None, "equal", None),
    (op("greater_than", refs(1, 2)), None, "Yes", None),
    (op("less_than", refs(1, 2)), None, "No", None),
    (op("equal_to", refs(2, 3)), None, "Yes", None),
    (op("rank", refs(1, 2, 3), position=1, order="descending"), None, "2019", None),
    (op("rank", refs(1, 2, 3), position=2, order="descending"), None, None, "tie"),
    (op("rank_value", refs(1, 2, 3), position=2, order="descending"), 210.0, None, None),
    (op("count_where", refs(1, 2), threshold=300, **WHERE), 0.0, None, None),
    (op("sum_where", refs(1, 2), threshold=300, **WHERE), None, None, "nothing passes"),
    (op("mean_where", refs(1, 2, 3), threshold=100, **WHERE), 665 / 3, None, None),
    (op("label_where", refs(1, 2), threshold=220, **WHERE), None, "2019", None),
    (op("meets_threshold", refs(1), compare="greater_or_equal", threshold=245), None, "Yes", None),
    (op("category_of", refs(4)), None, "2019 · x", None),
    (op("category_of", refs(1)), None, "2019", None),
    (op("difference", refs(1, 4)), None, None, "units differ"),
    (op("sum", refs(1, 5)), None, None, "not a number"),
    (op("percentage", [{"ref": "f1"}, op("sum", refs(1, 2, 3))]), 100 * 245 / 665, None, None),
    (op("unanswerable", []), None, None, None),
]


def test_both_evaluators(spark):
    rows = [(i, json.dumps(p), [tuple(f) for f in FACTS]) for i, (p, *_) in enumerate(CASES)]
    df = spark.createDataFrame(rows, f"i int, plan string, facts array<struct<{', '.join(x.replace(' ', ':', 1) for x in SCHEMA.split(', '))}>>").coalesce(2)
    got = {r["i"]: r["r"] for r in df.select("i", nodes.evaluate(nodes.read(F.col("plan")), F.col("facts"), 2).alias("r")).collect()}
    one = df.limit(1).select(*[plans.compile_plan(p, F.col("facts")).alias(f"r{i}") for i, (p, *_) in enumerate(CASES) if p["op"] != "unanswerable"]).first()
    for i, (plan, num, text, err) in enumerate(CASES):
        for r in (got[i], one[f"r{i}"] if plan["op"] != "unanswerable" else got[i]):
            assert r["err"] == err, plan
            assert r["str"] == text, plan
            assert r["num"] == (None if num is None else pytest.approx(num)), plan


BAD = [op("sum", refs(1)), op("guess", refs(1)), op("lookup", refs(1), extra=1), op("rank", refs(1, 2), position=3, order="ascending"), op("count_where", refs(1, 2), compare="above", threshold=1), op("count_where", refs(1, 2), compare="less", threshold="1"), op("sum", [1, 2]), op("median", [op("sum", refs(1, 2)), {"ref": "f1"}]), op("difference", [op("argmax", refs(1, 2)), {"ref": "f1"}]), op("category_of", [op("trend", refs(1, 2))]), op("rank", refs(1, 2), position=True, order="ascending")]
DEEP = op("sum", [{"ref": "f1"}, op("sum", [{"ref": "f1"}, op("sum", [{"ref": "f1"}, op("sum", [{"ref": "f1"}, op("sum", refs(1, 2))])])])])


def test_shapes(spark):
    good = [p for p, *_ in CASES]
    df = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(good + [*BAD, DEEP])], "i int, plan string").coalesce(1)
    errors = {r["i"]: r["e"] for r in df.select("i", nodes.shape_errors(nodes.read(F.col("plan"))).alias("e")).collect()}
    for i, p in enumerate(good + [*BAD, DEEP]):
        assert bool(errors[i]) == bool(plans.shape_errors(p)) == (i >= len(good)), (p, errors[i])


def test_binding():
    labels = [("f1", "a"), ("f2", "b"), ("f3", "b")]
    assert plans.bind_labels(op("sum", ["a", {"op": "lookup", "args": ["a"]}]), labels)["args"][0] == {"ref": "f1"}
    assert len(plans.bind_labels(op("count", ["a", "a"]), labels)["args"]) == 2
    with pytest.raises(plans.PlanError):
        plans.bind_labels(op("lookup", ["b"]), labels)
    with pytest.raises(plans.PlanError):
        plans.bind_labels(op("sum", [1, 2]), labels)


def test_verdicts(spark):
    cases = [
        (op("sum", refs(1)), "245", "", ["f1"], verify.VACUOUS), (op("lookup", refs(1)), "245", "", ["f1"], verify.ACCEPTED), (op("lookup", refs(1)), "246", "", ["f1"], verify.WRONG_ANSWER),
        (op("lookup", refs(1)), "245", "", ["f2"], verify.NOT_COVERING), (op("lookup", refs(9)), "245", "", ["f1"], verify.UNKNOWN_FACT), (op("guess", []), "1", "", [], verify.UNKNOWN_OP),
        (op("count_where", refs(1, 2), compare="less", threshold=1200), "2", "less than 1,200?", ["f1"], verify.ACCEPTED), (op("count_where", refs(1, 2), compare="less", threshold=1201), "2", "less than 1,200?", ["f1"], verify.UNGROUNDED),
        (op("argmin", refs(1, 2, 3)), "x", "", ["f1"], verify.REFUSED), (DEEP, "1", "", ["f1"], verify.TOO_DEEP), ([1], "1", "", [], verify.MALFORMED),
    ]
    rows = [(i, json.dumps(p), a, q, m, FACTS) for i, (p, a, q, m, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, f"i int, plan string, answer string, question string, marked array<string>, facts array<struct<{', '.join(x.replace(' ', ':', 1) for x in SCHEMA.split(', '))}>>").coalesce(1)
    got = {r["i"]: r["s"] for r in df.select("i", verify.verdict(nodes.read(F.col("plan")), F.col("facts"), F.col("answer"), F.col("question"), F.col("marked"))["status"].alias("s")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[-1] for c in cases]


def test_labels_as_operands(spark):
    plan = [op("difference", ["2019", "2018"]), op("max", []), op("lookup", ["none"]), op("lookup", ["2017"])]
    facts = [f for f in FACTS if f[0] in ("f1", "f2", "f3")]
    df = spark.createDataFrame([(i, json.dumps(p), facts) for i, p in enumerate(plan)], f"i int, plan string, facts array<struct<{', '.join(x.replace(' ', ':', 1) for x in SCHEMA.split(', '))}>>").coalesce(1)
    got = {r["i"]: r["r"] for r in df.select("i", nodes.evaluate(nodes.read(F.col("plan")), F.col("facts"), 1, by_label=True).alias("r")).collect()}
    assert [got[i]["num"] for i in range(4)] == [35, 245, None, 210] and got[2]["err"] == "not exactly one fact"
