"""What becomes of a teacher's replies: accepted, trainable, trusted, kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json_tools import parse_reply
from ..functions.text import quarantine_reason
from . import nodes, targets, verify


def scored(rows: DataFrame) -> DataFrame:
    """Rows with ``outcome`` (V05, V08), ``set_aside`` (why an accepted plan isn't kept) and ``plan`` of those that are kept.

    ``rows``: ``question, reply, answer, elements`` (label, num,
    str, unit, bbox), ``evidence`` (positions).  Every step is a column; only
    the histogram of outcomes shuffles.  Other columns stay.
    """
    facts = F.transform("elements", lambda e, i: F.struct(F.concat(F.lit("f"), (i + 1).cast("string")).alias("id"), e["label"].alias("label"), e["num"].alias("num"), e["str"].alias("str"), e["unit"].alias("unit")))
    read = rows.withColumn("_reply", F.when(F.trim(F.coalesce("reply", F.lit(""))) != "", parse_reply(F.col("reply")))).withColumn("_facts", facts)
    read = read.withColumn("_plan", F.try_parse_json(F.col("_reply.plan")))
    judged = read.withColumn("outcome", verify.reply_outcome(F.col("_reply"), verify.verdict(F.col("_plan"), F.col("_facts"), F.col("answer"), F.col("question"))["status"]))
    good = F.col("outcome") == verify.ACCEPTED
    builds = targets.target(F.col("elements"), F.col("evidence"), F.col("_plan"), F.col("answer"))["status"] == "ok"
    distrusted = quarantine_reason(nodes.get(F.col("_plan"), "op"), _one_fact(F.col("_plan")), F.size(nodes.thresholds(F.col("_plan"))) > 0, F.col("question"))
    aside = F.when(good & ~builds, "untrainable").when(good, distrusted)
    return judged.withColumn("set_aside", aside).withColumn("plan", F.when(good & F.col("set_aside").isNull(), F.to_json("_plan"))).drop("_reply", "_facts", "_plan")


def counted(rows: DataFrame) -> DataFrame:
    """Rows of ``scored`` that are alike but for their id, as one with their number ``n``: each is judged once."""
    return rows.groupBy("question", "reply", "answer", "elements", "evidence").agg(F.count("*").alias("n"))


def _one_fact(plan: Column) -> Column:
    return (F.size(nodes.operands(plan)) == 1) & F.forall(nodes.operands(plan), nodes.is_ref)


def histogram(scored_rows: DataFrame) -> DataFrame:
    """How often each outcome falls, and what of it is set aside."""
    return scored_rows.groupBy("outcome", "set_aside").agg(F.count("*").alias("n"))
