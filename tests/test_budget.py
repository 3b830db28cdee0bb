"""Metrics within a time budget."""

import time

import pytest
from pyspark.sql import functions as F

from factmill.operators import budget


def slow(seconds, slice_of):
    """A test that one slice's rows take long to answer."""

    @F.udf("boolean")
    def answer(i, k):
        if k == slice_of:
            time.sleep(seconds)
        return i % 3 == 0

    return answer


def test_in_time(spark):
    rows = spark.range(100).withColumn("x", F.col("id") % 2)
    got = budget.metrics_within(rows, "id", F.col("id") % 4 == 0, F.col("x") == 1, F.lit(None).cast("boolean"), 600, 3).first()
    assert tuple(got) == (100, 0.25, 0.5, 0.0, None)
    empty = budget.metrics_within(rows.where("false"), "id", F.col("x") == 1, F.col("x") == 1, F.col("x") == 1, 600, 2).first()
    assert tuple(empty) == (0, 0.0, 0.0, 0.0, None)


def test_a_slow_slice_is_cancelled(spark):
    """What was finished before the deadline is kept, the accuracy is unknown, and nothing waits for the slow slice."""
    rows = spark.range(40)
    k = F.pmod(F.xxhash64("id"), F.lit(4))
    first = rows.where(k < 2).count()
    began = time.monotonic()
    got = budget.metrics_within(rows, "id", slow(8, 2)("id", k), F.lit(True), F.col("id") % 2 == 0, 15, 4).first()
    assert time.monotonic() - began < 50
    assert got["answer_accuracy"] is None and got["stopped_early"] == f"time budget spent after {got['metric_n']} of 40 rows"
    assert got["metric_n"] == first and got["schema_valid"] == 1.0
    spent = budget.metrics_within(rows, "id", F.lit(True), F.lit(True), F.lit(True), 0, 4).first()
    assert spent["metric_n"] == 0 and spent["answer_accuracy"] is None and spent["stopped_early"].startswith("time budget spent after 0")


def test_errors_are_errors(spark):
    with pytest.raises(Exception, match="no good"):
        budget.sums_within(spark.range(5), "id", {"x": F.sum(F.raise_error(F.lit("no good")).cast("int"))}, 100, 1)
