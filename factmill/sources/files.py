"""Record files: JSON lines, plan caches, question files, tables, manifests, slices, logs."""

from __future__ import annotations

import csv
import io

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from ..functions.json_tools import canonical_json
from ..functions.text import stem
from ..operators.keyed import last_wins, numbered

QUESTION = "imgname string, query string, label string"
TABLE = StructType().add("columns", ArrayType(StringType())).add("rows", ArrayType(ArrayType(StringType())))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a bad line fails."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(rows: DataFrame, path: str) -> int:
    """One canonical JSON object a line; gives the number of rows."""
    from pyspark.sql import Observation

    seen = Observation()
    text = rows.select(canonical_json(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})).alias("value"))
    text.observe(seen, F.count("*").alias("n")).write.mode("overwrite").text(path)
    return seen.get["n"]


def question_rows(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """Human, then machine questions with a row number over both."""
    kinds = (("human", "human"), ("machine", "augmented"))
    both = None
    for i, (kind, name) in enumerate(kinds):
        # a question file is one JSON list: one task reads it
        part = spark.read.schema(QUESTION).option("multiLine", True).json(f"{folder}/{split}_{name}.json").withColumn("question_kind", F.lit(kind)).withColumn("_seq", F.monotonically_increasing_id() + F.lit(i << 60))
        both = part if both is None else both.unionByName(part)
    return numbered(both, "_seq").withColumnRenamed("_place", "row").drop("_seq")


def image_path(folder: Column | str, name: Column) -> Column:
    """Where a picture lies."""
    return F.concat_ws("/", folder if isinstance(folder, Column) else F.lit(folder), F.lit("png"), name)


def table_path(folder: str, name: Column) -> Column:
    """Where a picture's table lies."""
    return F.concat_ws("/", F.lit(folder), F.lit("tables"), F.concat(stem(name), F.lit(".csv")))


def annotation_path(folder: str, name: Column) -> Column:
    """Where a picture's annotation lies."""
    return F.concat_ws("/", F.lit(folder), F.lit("annotations"), F.concat(stem(name), F.lit(".json")))


@F.pandas_udf(TABLE)
def parse_table(text: pd.Series) -> pd.DataFrame:
    """A chart table from CSV text: the first row that isn't blank names columns; null text or none gives null.

    Quoted cells may span lines, which rules out reading by lines.
    """
    out = []
    for t in text:
        rows = [] if t is None else [r for r in csv.reader(io.StringIO(t)) if any(c.strip() for c in r)]
        out.append({"columns": rows[0] if rows else None, "rows": rows[1:] if rows else None})
    return pd.DataFrame(out, columns=["columns", "rows"])


BAR = "name string, x array<string>, y array<string>, bboxes array<struct<x:double,y:double,w:double,h:double>>, colors array<string>, color string"
ANNOTATION = f"struct<type:string,models:array<struct<{', '.join(p.replace(' ', ':', 1) for p in BAR.split(', '))},text_label:string,value:string,bbox:struct<x:double,y:double,w:double,h:double>>>>"


def annotation_elements(text: Column, width: Column, height: Column) -> Column:
    """Elements of an annotation: bars or wedges by its type, none for other types.

    Gives ``array<struct<series, label, value, bbox, colour>>``.
    """
    from ..functions import geometry as g

    a = F.from_json(text, ANNOTATION)
    box = lambda b: g.box_or_null(g.xywh_to_box(b["x"], b["y"], b["w"], b["h"], width, height))

    def bars(m: Column) -> Column:
        n = F.size(m["bboxes"])
        colours = g.aligned_colours(m["colors"], m["color"], n)
        return g.bar_elements(m["name"], m["x"], m["y"], F.transform(m["bboxes"], box), colours)

    def wedge(m: Column) -> Column:
        e = g.wedge_element(m["text_label"], m["value"], box(m["bbox"]), F.transform(m["bboxes"], box), F.coalesce(F.get(m["colors"], 0), m["color"]))
        return F.when(e.isNotNull(), F.struct(F.lit(None).cast("string").alias("series"), e["label"].alias("label"), e["value"].alias("value"), e["bbox"].alias("bbox"), e["colour"].alias("colour")))

    series = F.flatten(F.filter(F.transform(a["models"], bars), lambda x: x.isNotNull()))
    wedges = F.filter(F.transform(a["models"], wedge), lambda x: x.isNotNull())
    return F.when(a["type"].isin("v_bar", "h_bar"), series).when(a["type"] == "pie", wedges).otherwise(F.filter(wedges, lambda x: F.lit(False)))


def binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Members of an unpacked archive with their bytes: ``path, length, content``."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def member_text(content: Column) -> Column:
    """Bytes as text, bad bytes replaced."""
    return F.decode(content, "UTF-8")


def read_plans(spark: SparkSession, path: str) -> DataFrame:
    """A plan cache: ``record_id, plan`` (JSON text), ``teacher``; of repeated ids the last line counts."""
    lines = spark.read.text(path).select("value", F.input_file_name().alias("_file"), F.monotonically_increasing_id().alias("_line"))
    v = F.parse_json("value")
    rows = lines.select(F.variant_get(v, "$.record_id", "string").alias("record_id"), F.to_json(F.variant_get(v, "$.plan", "variant")).alias("plan"), F.try_variant_get(v, "$.teacher", "string").alias("teacher"), "_file", "_line")
    return last_wins(rows, ["record_id"], ["_file", "_line"]).drop("_file", "_line")


def write_plans(plans: DataFrame, path: str) -> None:
    """Sorted by id, one JSON object a line."""
    body = F.struct("record_id", F.parse_json("plan").alias("plan"), "teacher")
    plans.repartitionByRange("record_id").sortWithinPartitions("record_id").select(canonical_json(F.to_json(body)).alias("value")).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """Examples of a manifest that aren't held out, with their place among all and their picture's path."""
    schema = "examples array<struct<example_id:string,image:string,question:string,answer:string,level:string,chart_type:string,holdout:boolean,plan:string>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    rows = rows.select(F.posexplode("examples").alias("source_row_index", "e")).where(~F.coalesce("e.holdout", F.lit(False)))
    return rows.select("source_row_index", "e.*").withColumn("image_path", F.concat_ws("/", F.lit(folder), "image")).drop("image", "holdout")


def write_manifest(examples: DataFrame, path: str, generation_seed: int, histograms: dict[str, tuple]) -> None:
    """Examples with the histograms of some columns, counted while they are written.

    ``histograms`` names each column's values; what isn't among them counts as
    ``other``, and null as ``null``.  The summary is written last: a manifest
    without it isn't complete, and writing it again replaces both.
    """
    from ..streaming.ledger import Ledger

    ledger = Ledger(examples.sparkSession, path)
    ledger.clear()
    counts = {"rows": F.count("*")}
    for column, values in histograms.items():
        c = F.col(column)
        counts |= {f"{column}={v}": F.count_if(c == v) for v in values}
        counts |= {f"{column}=other": F.count_if(~c.isin(*values)), f"{column}=null": F.count_if(c.isNull())}
    ledger.write(examples, 0, lambda rows: rows, counts, lambda found: {"generation_seed": generation_seed})


def manifest_examples(spark: SparkSession, path: str) -> DataFrame:
    """The examples of a complete manifest; an incomplete one is an error."""
    from ..streaming.ledger import Ledger

    ledger = Ledger(spark, path)
    if not ledger.has(0):
        raise FileNotFoundError(f"no complete manifest at {path}")
    return ledger.rows().drop("batch")


def manifest_histograms(spark: SparkSession, path: str) -> DataFrame:
    """``name, value, n`` of a manifest's histograms, without values that don't occur."""
    from ..streaming.ledger import Ledger

    counts = Ledger(spark, path).totals().where(F.contains("name", F.lit("=")) & (F.col("n") > 0))
    return counts.select(F.substring_index("name", "=", 1).alias("name"), F.regexp_replace("name", "^[^=]*=", "").alias("value"), "n")


def log_metrics(metrics: DataFrame, path: str, step: int) -> None:
    """One evaluation's metrics, a row, as JSON lines of its step; a step that is logged again replaces the earlier line."""
    metrics.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/step={step}")


def read_metrics(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Logged metrics with their ``step``."""
    return spark.read.schema(f"{schema}, step int").option("mode", "FAILFAST").json(path)


def manifest_summary(examples: DataFrame) -> DataFrame:
    """How many examples each level and chart type has."""
    from ..operators.mixture import composition

    return composition(examples, ["level", "chart_type"])


def write_mixture(ids: DataFrame, composition: DataFrame, path: str) -> None:
    """``position, record_id`` rows and the composition, as tables of one folder."""
    ids.write.mode("overwrite").parquet(f"{path}/record_ids")
    composition.write.mode("overwrite").json(f"{path}/composition")


def read_mixture_ids(spark: SparkSession, path: str) -> DataFrame:
    """``position, record_id`` of a mixture."""
    return spark.read.parquet(f"{path}/record_ids")


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """``position, record_id`` of a JSON file with ``record_ids``."""
    return spark.read.schema("record_ids array<string>").option("multiLine", True).json(path).select(F.posexplode("record_ids").alias("position", "record_id"))


def mining_batches(records: DataFrame, order: str, path: str, size: int = 10) -> None:
    """Request files of ``size`` records each, one folder per batch."""
    from ..operators.mixture import batches

    batches(records, order, size).write.mode("overwrite").partitionBy("batch").json(path)


def remaining(rows: DataFrame, log: DataFrame, key: str = "record_id") -> DataFrame:
    """Rows that the log doesn't have yet."""
    return rows.join(log.select(key).distinct(), key, "left_anti")


def upstream_split(split: Column) -> Column:
    """Names of the validation split are one."""
    return F.when(split.isin("val", "valid", "dev", "validation"), "validation").otherwise(split)


def row_outcome(has_image: Column, well_formed: Column, has_box: Column, held_out: Column) -> Column:
    """What becomes of a source row; the first reason counts."""
    return F.when(~has_image, "missing_image").when(~well_formed, "malformed").when(~has_box, "no_usable_box").when(held_out, "held_out_image").otherwise("accepted")
