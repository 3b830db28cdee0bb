import json
import zipfile

import pytest
from pyspark.sql import functions as F

from factmill.sources import files, teacher
from factmill.sources.archive import ZipSource


def test_zip_members(spark, tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("t/one.csv", "a,b\n\n1,\"x\ny\"\n")
        z.writestr("t/two.csv", "")
        z.writestr("u/three.txt", "no")
    spark.dataSource.register(ZipSource)
    rows = spark.read.format("zip_members").option("path", str(path)).option("prefix", "t/").option("members_per_task", 1).load()
    got = {r["name"]: r["t"] for r in rows.select("name", files.parse_table(files.member_text(F.col("content"))).alias("t")).collect()}
    assert got["t/one.csv"]["columns"] == ["a", "b"] and got["t/one.csv"]["rows"] == [["1", "x\ny"]]
    assert got["t/two.csv"]["columns"] is None


def test_annotations(spark):
    bar = {"type": "v_bar", "models": [{"name": "s", "x": ["a", "b"], "y": ["1", "2"], "bboxes": [{"x": 0, "y": 0, "w": 50, "h": 50}, {"x": 5, "y": 5, "w": 0, "h": 5}], "color": "unk"}]}
    pie = {"type": "pie", "models": [{"text_label": "p", "value": "3", "bbox": {"x": 0, "y": 0, "w": 10, "h": 20}}, {"text_label": "q", "value": "3"}]}
    df = spark.createDataFrame([(0, json.dumps(bar)), (1, json.dumps(pie)), (2, json.dumps({"type": "line", "models": []}))], "i int, a string")
    got = [r["e"] for r in df.select("i", files.annotation_elements(F.col("a"), F.lit(100), F.lit(100)).alias("e")).orderBy("i").collect()]
    assert [(e["series"], e["label"], e["bbox"], e["colour"]) for e in got[0]] == [("s", "a", [0, 0, 500, 500], None)]
    assert [e["label"] for e in got[1]] == ["p"] and got[2] == []


def test_plan_cache_and_lines(spark, tmp_path):
    path = tmp_path / "plans.jsonl"
    path.write_text("".join(json.dumps({"record_id": r, "plan": {"op": o}, "teacher": "t"}) + "\n" for r, o in (("b", "x"), ("a", "y"), ("b", "z"))))
    plans = files.read_plans(spark, str(path))
    assert {r["record_id"]: r["plan"] for r in plans.collect()} == {"a": '{"op":"y"}', "b": '{"op":"z"}'}
    files.write_plans(plans, str(tmp_path / "out"))
    assert files.read_plans(spark, str(tmp_path / "out")).count() == 2
    assert files.write_jsonl(spark.createDataFrame([(1, None)], "b int, a string"), str(tmp_path / "lines")) == 1
    assert spark.read.text(str(tmp_path / "lines")).first()[0] == '{"a":null,"b":1}'


def test_questions_and_manifest(spark, tmp_path):
    for name, rows in (("val_human", [{"imgname": "a.png", "query": "q1", "label": "1"}]), ("val_augmented", [{"imgname": "b.png", "query": "q2", "label": "2"}])):
        (tmp_path / f"{name}.json").write_text(json.dumps(rows))
    got = files.question_rows(spark, str(tmp_path), "val").orderBy("row").collect()
    assert [(r["row"], r["question_kind"], r["query"]) for r in got] == [(0, "human", "q1"), (1, "machine", "q2")]
    (tmp_path / "m.json").write_text(json.dumps({"examples": [{"example_id": "x", "image": "i.png", "holdout": True}, {"example_id": "y", "image": "j.png", "holdout": False}]}))
    row = files.read_manifest(spark, str(tmp_path / "m.json"), "/root").first()
    assert (row["source_row_index"], row["example_id"], row["image_path"]) == (1, "y", "/root/j.png")


def test_teacher():
    waits, left = [], [2]

    def flaky(prompt):
        if left[0]:
            left[0] -= 1
            raise OSError
        return f"<think>hm</think> {prompt}"

    assert teacher.asked(flaky, "hi", wait=waits.append) == "hi" and waits == [10, 20]
    with pytest.raises(PermissionError):
        teacher.asked(lambda p: (_ for _ in ()).throw(PermissionError()), "hi", wait=waits.append)
