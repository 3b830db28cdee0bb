"""Facts of records: their values, whether a record can be used, and what context adds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import valid_box
from ..functions.numbers import parse_numeric, values_agree
from ..functions.text import SEPARATOR, fold_for_matching
from ..plans.evaluate import let


def table_values(records: DataFrame, key: str = "record_id") -> DataFrame:
    """Numbers of chart tables by folded column and row label, first one wins: key, ``series``, ``label``, ``value``.

    A null ``series`` holds the first numeric cell of the first row with a label.
    """
    rows = records.select(key, F.col("table.columns").alias("columns"), F.posexplode("table.rows").alias("row", "cells"))
    cells = rows.select(key, "row", F.trim(F.get("cells", 0)).alias("label"), "columns", F.posexplode("cells").alias("column", "cell")).where("column > 0")
    cells = cells.withColumn("value", parse_numeric(F.col("cell"))).where(F.col("value").isNotNull())
    first = F.min(F.struct("row", "column", "value"))
    named = cells.groupBy(key, fold_for_matching(F.get("columns", F.col("column"))).alias("series"), "label").agg(first.alias("f"))
    bare = cells.groupBy(key, F.lit(None).cast("string").alias("series"), "label").agg(first.alias("f"))
    return named.unionByName(bare).select(key, "series", "label", F.col("f.value").alias("value"))


def resolved_values(elements: DataFrame, values: DataFrame, key: str = "record_id") -> DataFrame:
    """Elements (``series, label, qualified, value``) with ``resolved`` and ``conflict``.

    The table's value for series and label comes first, then, for a label
    that needed no series, the label's, then the element's own; a table value
    that the annotation contradicts is a conflict.
    """
    named = values.where(F.col("series").isNotNull()).select(key, F.col("series").alias("_series"), "label", F.col("value").alias("_named"))
    bare = values.where(F.col("series").isNull()).select(key, "label", F.col("value").alias("_bare"))
    joined = elements.withColumn("_series", fold_for_matching(F.col("series"))).join(named, [key, "_series", "label"], "left").join(bare, [key, "label"], "left")
    table = F.coalesce("_named", F.when(F.col("qualified") == F.col("label"), F.col("_bare")))
    conflict = table.isNotNull() & ~values_agree(table.cast("string"), F.col("value").cast("string"))
    return joined.withColumn("resolved", F.coalesce(table, parse_numeric(F.col("value").cast("string")))).withColumn("conflict", F.coalesce(conflict, F.lit(False))).drop("_series", "_named", "_bare")


def refusal_reason(split: Column, answer: Column, question: Column, evidence: Column, only_grounded: Column, aligned: Column, facts: Column, conflicting: Column) -> Column:
    """the first of ten reasons why a record can't be mined, or null.

    ``facts`` is an array of ``label, num, str, bbox``.
    """
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    infinite = F.exists(facts, lambda f: F.isnan(f["num"]) | (F.abs(f["num"]) == float("inf")))
    return (
        F.when(split != "train", "not_training_split").when(blank(answer), "missing_answer").when(blank(question), "missing_question")
        .when(F.size(evidence) == 0, "empty_evidence").when(only_grounded & ~aligned, "unaligned_grounding")
        .when(F.coalesce(F.size(facts), F.lit(0)) <= 0, "missing_facts").when(F.exists(facts, lambda f: blank(f["label"])), "missing_fact_label")
        .when(F.exists(facts, lambda f: ~valid_box(f["bbox"])), "invalid_fact_box").when(infinite, "non_finite_fact_data")
        .when(conflicting, "conflicting_fact_value")
    )


def with_ids(facts: Column) -> Column:
    """Facts with ids ``f1, f2, …`` where they have none."""
    return F.transform(facts, lambda f, i: f.withField("id", F.coalesce(f["id"], F.concat(F.lit("f"), (i + 1).cast("string")))))


def marked_ids(evidence: Column) -> Column:
    """Ids of the elements that a question marks (positions from 0)."""
    return F.transform(evidence, lambda i: F.concat(F.lit("f"), (i + 1).cast("string")))


def _names(elements: Column) -> Column:
    labels = F.transform(elements, lambda e: e["label"])
    return F.zip_with(elements, labels, lambda e, label: F.when((F.size(F.filter(labels, lambda x: x == label)) > 1) & (F.coalesce(e["series"], F.lit("")) != ""), F.concat(e["series"], F.lit(SEPARATOR), label)).otherwise(label))


def admit_context(marked: Column, context: Column) -> Column:
    """context elements taken one by one, in order: ``struct<kept, renames, ambiguous, conflicts>``.

    An element is refused if with it a marked element would be called
    differently, two elements would be called alike, or its value contradicts
    its table (``conflict``).  Elements are ``label, series, bbox, conflict``;
    those whose box is marked already are left out beforehand (K07).
    """
    n = F.size(marked)
    zero = F.lit(0)
    labels = F.transform(marked, lambda e: e["label"])
    start = F.struct(
        F.filter(marked, lambda e: F.lit(False)).alias("kept"), zero.alias("renames"), zero.alias("ambiguous"), zero.alias("conflicts"),
        labels.alias("labels"), F.transform(marked, lambda e: e["series"]).alias("series"), _names(marked).alias("names"),
    )
    fresh = F.filter(context, lambda e: ~F.exists(marked, lambda m: m["bbox"] == e["bbox"]))
    has = lambda series: F.coalesce(series, F.lit("")) != ""

    def step(state: Column, element: Column) -> Column:
        label, series = element["label"], element["series"]
        # names are carried along: an element changes another's only if it is the second of its label
        same = F.filter(F.transform(state["labels"], lambda x, i: F.when(x == label, i)), lambda i: i.isNotNull())

        def judge(same: Column) -> Column:
            first = F.get(same, 0)
            other = F.get(state["series"], first)
            renamed = (F.size(same) == 1) & has(other)
            others = F.when(renamed, F.transform(state["names"], lambda x, i: F.when(i == first, F.concat(other, F.lit(SEPARATOR), label)).otherwise(x))).otherwise(state["names"])
            own = F.when((F.size(same) > 0) & has(series), F.concat(series, F.lit(SEPARATOR), label)).otherwise(label)
            return let(F.struct((renamed & (first < n)).alias("renames"), F.array_append(others, own).alias("names")), decide)

        def decide(trial: Column) -> Column:
            ambiguous = F.size(F.array_distinct(trial["names"])) < F.size(trial["names"])
            bad = F.when((n > 0) & trial["renames"], 1).when(ambiguous, 2).when(F.coalesce(element["conflict"], F.lit(False)), 3).otherwise(0)
            return let(bad, lambda b: F.when(b == 0, _counted(state, b, F.array_append(state["kept"], element), F.array_append(state["labels"], label), F.array_append(state["series"], series), trial["names"])).otherwise(_counted(state, b, state["kept"], state["labels"], state["series"], state["names"])))

        return let(same, judge)

    return F.aggregate(fresh, start, step, lambda s: F.struct(s["kept"].alias("kept"), s["renames"].alias("renames"), s["ambiguous"].alias("ambiguous"), s["conflicts"].alias("conflicts")))


def _counted(state: Column, bad: Column, kept: Column, labels: Column, series: Column, names: Column) -> Column:
    plus = lambda name, code: (state[name] + (bad == code).cast("int")).alias(name)
    return F.struct(kept.alias("kept"), plus("renames", 1), plus("ambiguous", 2), plus("conflicts", 3), labels.alias("labels"), series.alias("series"), names.alias("names"))


def first_numeric_window(df: DataFrame, key: str, order: str) -> DataFrame:
    """Adjacent differences in listed order: ``delta`` of ``value`` within a key."""
    return df.withColumn("delta", F.col("value") - F.lag("value").over(Window.partitionBy(key).orderBy(order)))
