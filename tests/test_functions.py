import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from factmill.functions import colours, geometry, json_tools, numbers, text
from factmill.operators import mixture


def each(spark, values, column, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in rows.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_numbers(spark):
    forms = ["1,200", "12%", "$ 3", "%", "nan", "inf", "1d", "0x1p3", "1_000", None, " 7 ", ".5", "5.", "1e3", ""]
    assert each(spark, forms, numbers.parse_numeric) == [1200, 12, 3, None, None, None, None, None, 1000, None, 7, 0.5, 5, 1000, None]
    assert each(spark, ["1,200", "12%", "12"], numbers.to_float) == [None, 0.12, 12]
    assert each(spark, ["3.5", "3", "$1,200", "12.25%"], numbers.gold_tolerance) == pytest.approx([0.05, 0.5, 0.5, 0.005])
    assert [sorted(x) for x in each(spark, ["more than 1,200 in 2019", "v2 of -3.5"], numbers.question_numbers)] == [[1200, 2019], [-3.5]]
    assert each(spark, [3.549, 3.56], lambda x: numbers.matches_gold(x, F.lit("3.5")), "double") == [True, False]
    assert each(spark, ["105", "105.1"], lambda x: numbers.relaxed_correctness(F.lit("100"), x)) == [True, False]
    assert each(spark, ["0.0", "0"], lambda x: numbers.relaxed_correctness(F.lit("0"), x)) == [False, True]
    assert each(spark, [3.0, 2.5, 2.126], numbers.format_answer, "double") == ["3", "2.5", "2.13"]


def test_text(spark):
    assert each(spark, ["  What IS  it ?! ", "a.b"], text.normalise_question) == ["what is it", "a.b"]
    assert each(spark, ["S · 2019 · x", "2019"], text.category_of) == ["2019 · x", "2019"]
    assert each(spark, ["Сat  А", None], text.fold_for_matching) == ["cat a", "none"]
    assert each(spark, ["x.y.png"], text.stem) == ["x.y"]
    assert each(spark, ["a b/c"], lambda x: text.safe_file_name(F.lit(7), x)) == ["000007_a_b_c.png"]
    assert each(spark, [["a", "b", "c"]], text.scope_phrase, "array<string>") == [" among a, b, and c"]


def test_boxes(spark):
    box = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    row = spark.range(1).select(geometry.iou(box(0, 0, 10, 10), box(5, 0, 15, 10)).alias("iou"), geometry.union_boxes(F.array(box(0, 0, 10, 10), box(0.5, 0, 10, 10), box(1.4, 0, 10, 10))).alias("u"), geometry.clamp_box(box(0.5, 1.5, 2000, -3)).alias("c"), geometry.valid_box(box(5, 5, 5, 9)).alias("v")).first()
    assert row["iou"] == pytest.approx(1 / 3)
    assert [b[0] for b in row["u"]] == [0, 1.4]
    assert row["c"] == [0, 2, 999, 0]
    assert row["v"] is False


def test_colours(spark):
    got = each(spark, ["#ff0000", "#000000", "#ffffff", "#00008b", "dark blue", "#808080", ""], colours.describe_colour)
    assert got == ["red", "black", "light", "dark blue", "dark blue", "light gray", ""]


def test_json(spark):
    assert each(spark, ['{"b": 1, "a": [1, null]}', "{1}"], json_tools.canonical_json) == ['{"a":[1,null],"b":1}', None]
    record = '{"answerable": true, "facts": [], "evidence_refs": [], "plan": null, "model_answer": "1"}'
    got = [json_tools.read_record(t) for t in (record, f"```json\n{record}\n```", record[:-1] + ",}", "", "[1]", '{"answerable": NaN}')]
    assert [g["ok"] for g in got] == [True, True, True, False, False, False]
    assert got[1]["repairs"] == ["stripped code fence"]
    outcomes = each(spark, ['{"op": "sum"}', '{"refused": " "}', '{"refused": "no"}', "x", '{"needs_context": {"kind": "axis"}}'], lambda x: json_tools.parse_reply(x)["outcome"])
    assert outcomes == ["plan", "malformed", "refused", "malformed", "malformed"]


def test_quotas():
    assert mixture.balanced_quotas({"a": 1, "b": 5, "c": 5}, 7) == {"a": 1, "b": 3, "c": 3}
    assert mixture.holdout_quotas({"x": 3, "y": 3, "z": 4}, 5) == {"x": 2, "y": 1, "z": 2}
    with pytest.raises(ValueError):
        mixture.balanced_quotas({"a": 1}, 2)


def test_numbers_beyond_doubles(spark):
    """Numbers that overflow are none; a percent sign divides once."""
    rows = spark.createDataFrame([("1e999",), ("-1e999%",), ("12%",), ("1_000.5",), ("inf",), (None,)], "t string")
    got = [tuple(r) for r in rows.select(numbers.parse_numeric("t"), numbers.to_float("t")).collect()]
    assert got == [(None, None), (None, None), (12.0, 0.12), (1000.5, 1000.5), (None, None), (None, None)]


def test_numbers_of_file_names_are_whole(spark):
    assert each(spark, ["a b"], lambda x: text.safe_file_name(F.lit(1234567), x)) == ["1234567_a_b.png"]


def test_folding(spark):
    """Only texts that folding may touch go to Python; every other character is one that folding leaves alone, whatever stands beside it."""
    forms = ["plain", "é ß Ω я — “x” 漢", "ﬁ ²", "e\u0301", "ｆｕｌｌ", "a\u00a0b", "\u1100\u1161", "😀", "", None, "m\u0307\u0323", "é\u0300"] * 30
    assert each(spark, forms, text.folded) == [x if x is None else unicodedata.normalize("NFKC", x) for x in forms]
    plain, pairs = re.compile("[^\\x00-\\x7f" + text.NOT_PLAIN.split("[^")[1].removesuffix("]]") + "]"), (unicodedata.decomposition(chr(c)).split() for c in range(0x110000))
    second = {chr(int(p[1], 16)) for p in pairs if len(p) == 2 and not p[0].startswith("<")} | {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A7, 0x11C3))}
    left_alone = [x for x in map(chr, range(0x110000)) if not plain.search(x)]
    assert len(left_alone) > 20_000
    assert not [x for x in left_alone if unicodedata.normalize("NFKC", x) != x or unicodedata.combining(x) or x in second]


def test_plain_texts_stay_out_of_python(spark, monkeypatch):
    monkeypatch.setattr(text, "_nfkc", lambda c: F.when(c.isNotNull(), "sent"))
    assert each(spark, ["plain", "é ß Ω я — “x”", "ﬁ", None], text.folded) == ["plain", "é ß Ω я — “x”", "sent", None]
