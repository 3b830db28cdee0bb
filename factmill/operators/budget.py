"""Sums over rows within a time budget.

Rows are dealt to slices by a hash of their ids and written slice by slice, so
that a slice can be read alone and stands for all rows.  Slices are summed up
one after the other; the one that the deadline falls into is cancelled, and
what was finished before is kept.
"""

from __future__ import annotations

import threading
import time
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder


def sums_within(rows: DataFrame, id_column: str, sums: dict[str, Column], seconds: float, slices: int = 16) -> dict:
    """``sums`` (aggregates that add up), ``n``, the number of rows they are of, ``total``, of all rows, and ``slices`` that were finished.

    The budget begins when the slices are written.  Null sums count as 0.
    """
    spark = rows.sparkSession
    context = spark.sparkContext
    path = f"{shared_folder(spark)}/slices-{uuid.uuid4().hex}"
    rows.withColumn("_slice", F.pmod(F.xxhash64(id_column), F.lit(slices))).write.partitionBy("_slice").parquet(path)
    dealt = spark.read.schema(rows.schema.add("_slice", "long")).parquet(path)
    total, deadline = dealt.count(), time.monotonic() + seconds
    found = dict.fromkeys(sums, 0) | {"n": 0}
    done = 0
    for k in range(slices):
        left = deadline - time.monotonic()
        if left <= 0:
            break
        tag = f"budget-{uuid.uuid4().hex}"
        late = threading.Event()
        timer = threading.Timer(left, lambda tag=tag, late=late: (late.set(), context.cancelJobGroup(tag)))
        context.setJobGroup(tag, "sums within a budget", interruptOnCancel=True)
        timer.start()
        try:
            part = dealt.where(F.col("_slice") == k).agg(F.count("*").alias("n"), *[c.alias(name) for name, c in sums.items()]).first()
        except Exception:
            if not late.is_set():
                raise
            break
        finally:
            timer.cancel()
            for name in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
                context.setLocalProperty(name, None)
        found = {name: found[name] + (part[name] or 0) for name in found}
        done += 1
    return found | {"total": total, "slices": done}


def metrics_within(rows: DataFrame, id_column: str, right: Column, valid: Column, agrees: Column, seconds: float, slices: int = 16) -> DataFrame:
    """One row: ``metric_n, answer_accuracy, schema_valid, round_trip, stopped_early``.

    Where the budget was spent before the last slice, ``stopped_early`` says
    so, and the accuracy, which checkpoints are chosen by, is null; the other
    shares are of the rows that were seen.  Without rows all shares are 0.
    """
    found = sums_within(rows, id_column, {"right": F.count_if(right), "valid": F.count_if(valid), "agrees": F.count_if(agrees)}, seconds, slices)
    n, whole = max(found["n"], 1), found["n"] == found["total"]
    stopped = None if whole else f"time budget spent after {found['n']} of {found['total']} rows"
    row = (found["n"], found["right"] / n if whole else None, found["valid"] / n, found["agrees"] / n, stopped)
    return rows.sparkSession.createDataFrame([row], "metric_n long, answer_accuracy double, schema_valid double, round_trip double, stopped_early string")
