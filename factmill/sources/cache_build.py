"""The cache of usable training rows, built from pinned shards as a stream.

Every source row gets one outcome; accepted rows become records, and each
micro-batch commits its records and its outcomes together (see ``Ledger``).
A run that was stopped is taken up by running it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, text
from ..operators.keyed import broadcast_if_small
from ..session import cut
from ..streaming.ledger import Ledger
from .files import row_outcome

#: Kinds of questions that rows may have. Fixed values.
KINDS = ("human", "machine", "pot")
OUTCOMES = ("accepted", "missing_image", "malformed", "no_usable_box", "held_out_image")


def with_outcome(rows: DataFrame, held_out: DataFrame) -> DataFrame:
    """Source rows with their ``boxes`` on the canvas and their ``outcome``.

    ``rows``: ``id, image_hash, width, height`` (null if there is no picture
    that can be read), ``query, label, type, grounding_bboxes`` (structs of
    ``x, y, w, h``), ``response, source_row_index``; ``held_out``: hashes of
    pictures, ``image_hash``.

    A kind that isn't known, or a box with a part missing, of negative extent
    or on an empty picture, makes a row malformed; boxes of no area on the
    canvas are left out; no boxes at all are none.
    """
    boxes = F.coalesce("grounding_bboxes", F.array().cast(rows.schema["grounding_bboxes"].dataType))
    boxes = geometry.boxes_with_area(F.transform(boxes, lambda b: geometry.xywh_to_box(b["x"], b["y"], b["w"], b["h"], F.col("width"), F.col("height"))))
    known = F.coalesce(F.lower("type").isin(*KINDS), F.lit(False))
    marked = rows.withColumn("boxes", boxes).join(held_out.withColumn("_held", F.lit(True)), "image_hash", "left")
    outcome = row_outcome(F.col("image_hash").isNotNull(), known & F.col("boxes").isNotNull(), F.size("boxes") > 0, F.coalesce("_held", F.lit(False)))
    return marked.withColumn("outcome", outcome).drop("_held")


def record(folder: str, source: str, split: str) -> list:
    """Columns of an accepted row's record."""
    question = F.coalesce("query", F.lit("None"))
    nothing = F.lit(None).cast("string")
    element = lambda b: F.struct(nothing.alias("label"), nothing.alias("value"), nothing.alias("unit"), b.alias("bbox"), F.lit("gold").alias("grounding_provenance"), F.lit("unknown").alias("value_provenance"))
    meta = F.struct(F.array("width", "height").alias("image_size"), F.size("boxes").alias("n_boxes"), (F.coalesce(F.size("grounding_bboxes"), F.lit(0)) - F.size("boxes")).alias("boxes_dropped_outside_image"), "response")
    return [
        "source_row_index",
        text.record_id(F.lit(source), F.lit(split), F.col("source_row_index"), F.col("image_hash"), question).alias("record_id"),
        F.lit(source).alias("source"),
        F.lit(split).alias("split"),
        F.concat_ws("/", F.lit(folder), text.safe_file_name(F.col("source_row_index"), F.coalesce(F.nullif(F.col("id").cast("string"), F.lit("")), F.lit("no-id")))).alias("image_path"),
        F.col("image_hash").alias("image_sha256"),
        question.alias("question"),
        F.col("label").alias("answer"),
        F.lower("type").alias("question_kind"),
        "boxes",
        F.transform("boxes", element).alias("elements"),
        F.sequence(F.lit(0), F.size("boxes") - 1).alias("evidence"),
        F.col("id").cast("string").alias("source_id"),
        meta.alias("meta"),
    ]


def build(source: DataFrame, held_out: DataFrame, folder: str, images: str = "images", source_name: str = "grounded", split: str = "train") -> Ledger:
    """Take in what ``source`` (a stream of ``with_outcome``'s rows) has; run it again after a stop.

    Records are ``Ledger.rows``, outcomes ``Ledger.totals``.
    """
    ledger = Ledger(source.sparkSession, folder)
    hashes = broadcast_if_small(cut(held_out.select("image_hash").where(F.col("image_hash").isNotNull()).distinct()), 80)
    columns = record(images, source_name, split)

    def commit(batch: DataFrame, number: int) -> None:
        rows = with_outcome(batch, hashes)
        ledger.write(rows, number, lambda seen: seen.where("outcome = 'accepted'").select(*columns), {o: F.count_if(F.col("outcome") == o) for o in OUTCOMES})

    source.writeStream.foreachBatch(commit).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return ledger


def records(spark: SparkSession, folder: str) -> DataFrame:
    """The records of a cache."""
    return Ledger(spark, folder).rows().drop("batch")


def outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """How many rows had each outcome that occurred: ``outcome, n``."""
    return Ledger(spark, folder).totals().where("n > 0").withColumnRenamed("name", "outcome")
