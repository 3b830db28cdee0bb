"""The operators of plans: what they take, what they give, how units behave."""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_DEPTH = 4
MAX_FACTS = 12
#: Facts of a record in evaluation.
MAX_FACTS_EVALUATION = 64
COMPARISONS = ("greater", "greater_or_equal", "less", "less_or_equal", "equal")
ORDERS = ("ascending", "descending")


class Spec(NamedTuple):
    """``takes``: facts, numbers (facts or nested numeric plans), a label, or nothing.

    ``most=None``: as many operands as facts.  ``unit``: "same" demands equal
    units of all operands; what follows is the result's unit ("=" the operands').
    """

    takes: str
    gives: str
    least: int
    most: int | None
    same_unit: bool
    unit: str
    extra: tuple[str, ...] = ()


_RANKED, _FILTERED = ("position", "order"), ("compare", "threshold")
SPECS: dict[str, Spec] = {
    "lookup": Spec("facts", "scalar", 1, 1, False, "="),
    "label_of": Spec("facts", "string", 1, 1, False, ""),
    "difference": Spec("numbers", "number", 2, 2, True, "="),
    "absolute_difference": Spec("numbers", "number", 2, 2, True, "="),
    "ratio": Spec("numbers", "number", 2, 2, True, ""),
    "percentage": Spec("numbers", "number", 2, 2, True, "%"),
    "percent_change": Spec("numbers", "number", 2, 2, True, "%"),
    "sum": Spec("numbers", "number", 2, None, True, "="),
    "mean": Spec("numbers", "number", 2, None, True, "="),
    "median": Spec("facts", "number", 2, None, True, "="),
    "min": Spec("facts", "number", 2, None, True, "="),
    "max": Spec("facts", "number", 2, None, True, "="),
    "argmin": Spec("facts", "string", 2, None, True, ""),
    "argmax": Spec("facts", "string", 2, None, True, ""),
    "count": Spec("facts", "number", 2, None, False, ""),
    "trend": Spec("facts", "string", 2, None, True, ""),
    "compare": Spec("numbers", "string", 2, 2, True, ""),
    "greater_than": Spec("numbers", "yes_no", 2, 2, True, ""),
    "less_than": Spec("numbers", "yes_no", 2, 2, True, ""),
    "equal_to": Spec("numbers", "yes_no", 2, 2, True, ""),
    "rank": Spec("facts", "string", 2, None, True, "", _RANKED),
    "rank_value": Spec("facts", "scalar", 2, None, True, "=", _RANKED),
    "count_where": Spec("facts", "number", 2, None, False, "", _FILTERED),
    "sum_where": Spec("facts", "number", 2, None, True, "=", _FILTERED),
    "mean_where": Spec("facts", "number", 2, None, True, "=", _FILTERED),
    "label_where": Spec("facts", "string", 2, None, True, "", _FILTERED),
    "category_of": Spec("label", "string", 1, 1, False, ""),
    "meets_threshold": Spec("numbers", "yes_no", 1, 1, False, "", _FILTERED),
    "unanswerable": Spec("none", "null", 0, 0, False, ""),
}
FOLDS = tuple(op for op, s in SPECS.items() if s.most is None)
THRESHOLDED = tuple(op for op, s in SPECS.items() if s.extra == _FILTERED)
LABELS = ("label_of", "argmax", "argmin", "rank", "label_where")
NUMERIC = tuple(op for op, s in SPECS.items() if s.gives in ("number", "scalar"))


def converts(op: str) -> bool:
    """Whether texts among the operands are read as numbers."""
    return SPECS[op].takes in ("facts", "numbers") and op not in ("lookup", "label_of", "count")


def spec_of(op: Column) -> Column:
    """What rules ask of an operator, looked up by its name in one literal map; null for unknown operators.

    ``struct<fields, takes, gives, least, most, same_unit, converts>``; ``most`` is null for as many operands as facts.
    """
    rows = {name: {"fields": ["op", "args", *s.extra], "takes": s.takes, "gives": s.gives, "least": s.least, "most": s.most, "same_unit": s.same_unit, "converts": converts(name)} for name, s in SPECS.items()}
    kind = "map<string,struct<fields:array<string>,takes:string,gives:string,least:int,most:int,same_unit:boolean,converts:boolean>>"
    return F.try_element_at(F.from_json(F.lit(json.dumps(rows)), kind), op)


def operator_specs(spark: SparkSession) -> DataFrame:
    """The catalogue as a table, one row per operator."""
    rows = [(op, s.takes, s.gives, s.least, s.most, s.same_unit, s.unit, list(s.extra)) for op, s in SPECS.items()]
    return spark.createDataFrame(rows, "op string, takes string, gives string, least int, most int, same_unit boolean, unit string, extra array<string>")
