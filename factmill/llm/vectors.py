"""Searches in tables of vectors: what exact and approximate search share.

Equal vectors have equal scores, so that of each distinct vector only the few
smallest ids can be among a query's results.  That makes a vector with very
many copies as cheap as any other, without losing a result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usable(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", nonzero: bool = False, narrow: bool = False) -> DataFrame:
    """``vec_id, v``: vectors that aren't null and hold finite components only, one row per id.

    Of several rows with one id, the smallest vector counts; rows without an
    id take no part.  ``v`` holds doubles, or with ``narrow`` single-precision
    numbers where the table has no others, which is half as much to shuffle.
    """
    v = F.col(vector_column).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    if nonzero:
        good = good & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col(id_column).isNotNull() & F.col(vector_column).isNotNull() & (F.size(vector_column) > 0)).where(good)
    kind = "array<float>" if narrow and vectors.schema[vector_column].dataType.simpleString() == "array<float>" else "array<double>"
    # 0.0 and -0.0 are one component
    return rows.select(F.col(id_column).cast("long").alias("vec_id"), F.transform(v, lambda x: x + F.lit(0.0)).cast(kind).alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """``v, ids``: distinct vectors, each with its ``keep`` smallest ids.

    Ranking with a limit drops the other copies before the shuffle.
    """
    order = Window.partitionBy("v").orderBy("vec_id")
    few = rows.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= keep)
    return few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def matrix(column: pa.ChunkedArray | pa.Array, dtype=np.float64) -> np.ndarray:
    """Rows of equal length as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 0), dtype)
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), -1)


def ranked(found: DataFrame, k: int, best_first: list) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best rows of each query."""
    order = Window.partitionBy("query_id").orderBy(*best_first, "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
