"""Alignment of marked boxes with annotated elements by overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import iou
from ..functions.once import let

LEAST_IOU = 0.90
LEAST_MARGIN = 0.50


def best_matches(boxes: DataFrame, elements: DataFrame, key: str = "record_id") -> DataFrame:
    """For each box the element that overlaps it most, and its lead on the next.

    ``boxes``: key, ``box_index``, ``bbox``; ``elements``: key,
    ``element_index`` (an element's own), ``bbox``.  The smaller index wins ties.  Pairs are made
    within a record only.
    """
    # a record's elements are listed where its rows lie sorted by key, so that no pairs are sorted
    own = Window.partitionBy(key)
    listed = F.collect_list(F.struct("element_index", F.col("bbox").alias("box"))).over(own)
    first = F.col("element_index") == F.min("element_index").over(own)
    lists = elements.select(key, listed.alias("_elements"), first.alias("_first")).where("_first").drop("_first")
    found = boxes.join(lists, key).select(key, "box_index", _two_best(F.col("bbox"), F.col("_elements")).alias("_best"))
    best, second = F.get("_best", 0), F.coalesce(F.get("_best", 1)["iou"], F.lit(0.0))
    return found.select(key, "box_index", best["element_index"].alias("element_index"), best["iou"].alias("iou"), (best["iou"] - second).alias("margin"))


def _two_best(box: Column, elements: Column) -> Column:
    """The two elements that overlap a box most; unknown overlaps come last."""
    def ranked(e: Column) -> Column:
        # NaN counts as larger than any overlap
        order = lambda x: F.struct(x.isNull().alias("unknown"), F.when(F.isnan(x), F.lit(float("-inf"))).otherwise(-x).alias("order"), e["element_index"].alias("element_index"), x.alias("iou"))
        return let(iou(box, e["box"]), order)

    return F.slice(F.array_sort(F.transform(elements, ranked)), 1, 2)


def aligned_records(boxes: DataFrame, elements: DataFrame, key: str = "record_id", least: float = LEAST_IOU, margin: float = LEAST_MARGIN) -> DataFrame:
    """Records all of whose boxes have a clear match of their own: key, ``evidence`` in the order of boxes."""
    # a record without elements has no match at all, so the boxes with a best element are all boxes of the others
    good = (F.col("iou") >= least) & (F.col("margin") >= margin)
    grouped = best_matches(boxes, elements, key).groupBy(key).agg(F.count("*").alias("_boxes"), F.array_sort(F.collect_list(F.when(good, F.struct("box_index", "element_index")))).alias("_pairs"))
    evidence = F.transform("_pairs", lambda p: p["element_index"])
    whole = (F.size("_pairs") == F.col("_boxes")) & (F.size(F.array_distinct(evidence)) == F.col("_boxes"))
    return grouped.where(whole).select(key, evidence.alias("evidence"))


def context_elements(elements: DataFrame, aligned: DataFrame, key: str = "record_id") -> DataFrame:
    """Labelled elements of aligned records that no box matched and whose box isn't taken by one that did."""
    marked = aligned.select(key, F.explode("evidence").alias("element_index"))
    taken = elements.join(marked, [key, "element_index"]).select(key, "bbox").distinct()
    rest = elements.join(aligned.select(key), key, "left_semi").join(marked, [key, "element_index"], "left_anti").join(taken, [key, "bbox"], "left_anti")
    return rest.where(F.trim(F.coalesce("label", F.lit(""))) != "")


def image_join(grounded: DataFrame, annotated: DataFrame) -> DataFrame:
    """Grounded rows with the first annotated record (by ``source_row_index``) of the same picture that has elements."""
    order = Window.partitionBy("image_sha256").orderBy("source_row_index")
    with_elements = annotated.where(F.size("elements") > 0).withColumn("_nth", F.row_number().over(order)).where("_nth = 1")
    return grounded.join(with_elements.select("image_sha256", F.col("elements").alias("image_elements"), F.col("table").alias("image_table")), "image_sha256", "left")
