"""What each operator computes, as one Column over its operands.

Operands are ``array<struct<label, num, str, unit, err>>``; the result is a
struct of the same fields.  Errors are data: ``err`` says why there is no
value.  Extremes and ranks that are tied on the selected value are errors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.numbers import parse_numeric
from ..functions.once import let
from ..functions.text import category_of
from .specs import SPECS, converts, spec_of

VALUE = "struct<label:string,num:double,str:string,unit:string,err:string>"


def value(num: Column | None = None, text: Column | None = None, unit: Column | None = None, err: Column | str | None = None, label: Column | None = None) -> Column:
    null = F.lit(None)
    err = F.lit(err) if isinstance(err, str) else err
    parts = ((label if label is not None else text, "label", "string"), (num, "num", "double"), (text, "str", "string"), (unit, "unit", "string"), (err, "err", "string"))
    return F.struct(*[(null if c is None else c).cast(kind).alias(name) for c, name, kind in parts])


def fact_value(fact: Column) -> Column:
    """A fact (``label, num, str, unit``) as an operand."""
    return value(fact["num"], fact["str"], fact["unit"], None, fact["label"])


def number(operand: Column) -> Column:
    return F.coalesce(operand["num"], parse_numeric(operand["str"]))


def _finite(x: Column, unit: Column) -> Column:
    # NaN counts as larger than infinity
    return F.when(F.abs(x) < F.lit(float("inf")), value(x, unit=unit)).otherwise(value(err="not finite"))


def passes(x: Column, compare: Column, threshold: Column) -> Column:
    """one of five comparisons with a threshold."""
    return (
        F.when(compare == "greater", x > threshold).when(compare == "greater_or_equal", x >= threshold)
        .when(compare == "less", x < threshold).when(compare == "less_or_equal", x <= threshold).when(compare == "equal", x == threshold)
    )


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def _yes_no(test: Column, unit: Column) -> Column:
    return value(text=F.when(test, F.lit("Yes")).otherwise(F.lit("No")), unit=unit)


def _divided(a: Column, b: Column, x: Column, unit: Column) -> Column:
    return F.when(b == 0, value(err="division by zero")).otherwise(_finite(F.try_divide(x, b), unit))


def _extreme(args: Column, xs: Column, best: Column, unit: Column) -> Column:
    winners = F.filter(args, lambda a: a["num"] == best)
    return F.when(F.size(winners) == 1, value(text=F.get(winners, 0)["label"], unit=unit)).otherwise(value(err="tie"))


def _trend(xs: Column, unit: Column) -> Column:
    steps = F.zip_with(F.slice(xs, F.lit(1), F.size(xs) - 1), F.slice(xs, F.lit(2), F.size(xs) - 1), lambda a, b: F.signum(b - a))
    word = (
        F.when(F.forall(steps, lambda s: s > 0), "increasing").when(F.forall(steps, lambda s: s < 0), "decreasing")
        .when(F.forall(steps, lambda s: s == 0), "flat").otherwise("mixed")
    )
    return value(text=word, unit=unit)


def _ordered(args: Column, order: Column) -> Column:
    """Operands by number, equal ones as listed."""
    keyed = F.transform(args, lambda a, i: F.struct(F.when(order == "descending", -a["num"]).otherwise(a["num"]).alias("key"), i.alias("i"), a.alias("a")))
    return F.transform(F.array_sort(keyed), lambda k: k["a"])


def _median(xs: Column) -> Column:
    return let(F.array_sort(xs), lambda s: (F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / 2)


def _chosen(args: Column, extras: dict[str, Column]) -> Column:
    return F.filter(args, lambda a: passes(a["num"], extras["compare"], extras["threshold"]))


def _branches(args: Column, raw: Column, unit: Column, extras: dict[str, Column]) -> dict[str, Callable[[], Column]]:
    """``args``: operands whose ``num`` is their number; ``raw``: as they came."""
    xs = F.transform(args, lambda a: a["num"])
    a, b = F.get(args, 0)["num"], F.get(args, 1)["num"]
    none = F.lit("")
    percent = F.lit("%")
    picked = lambda body: let(_chosen(args, extras), lambda c: F.when(F.size(c) == 0, value(err="nothing passes")).otherwise(body(F.transform(c, lambda x: x["num"]))))

    def ranked(body: Callable[[Column, Column], Column]) -> Column:
        at = extras["position"].cast("int") - 1
        chosen = lambda: F.get(_ordered(args, extras["order"]), at)
        return F.when((at >= 0) & (at < F.size(args)), let(chosen(), lambda c: body(c, F.size(F.filter(args, lambda x: x["num"] == c["num"]))))).otherwise(value(err="position out of range"))

    return {
        "lookup": lambda: value(F.get(raw, 0)["num"], F.get(raw, 0)["str"], unit),
        "label_of": lambda: value(text=F.get(raw, 0)["label"], unit=none),
        "difference": lambda: _finite(a - b, unit),
        "absolute_difference": lambda: _finite(F.abs(a - b), unit),
        "ratio": lambda: _divided(a, b, a, none),
        "percentage": lambda: _divided(a, b, a * 100, percent),
        "percent_change": lambda: _divided(a, b, (a - b) * 100, percent),
        "sum": lambda: _finite(_total(xs), unit),
        "mean": lambda: _finite(_total(xs) / F.size(xs), unit),
        "median": lambda: _finite(_median(xs), unit),
        "min": lambda: _finite(F.array_min(xs), unit),
        "max": lambda: _finite(F.array_max(xs), unit),
        "argmin": lambda: _extreme(args, xs, F.array_min(xs), none),
        "argmax": lambda: _extreme(args, xs, F.array_max(xs), none),
        "count": lambda: value(F.size(raw).cast("double"), unit=none),
        "trend": lambda: _trend(xs, none),
        "compare": lambda: value(text=F.when(a > b, "greater").when(a < b, "less").otherwise("equal"), unit=none),
        "greater_than": lambda: _yes_no(a > b, none),
        "less_than": lambda: _yes_no(a < b, none),
        "equal_to": lambda: _yes_no(a == b, none),
        "rank": lambda: ranked(lambda c, n: F.when(n == 1, value(text=c["label"], unit=none)).otherwise(value(err="tie"))),
        "rank_value": lambda: ranked(lambda c, n: value(F.when(c["str"].isNull(), c["num"]), c["str"], unit)),
        "count_where": lambda: value(F.size(_chosen(args, extras)).cast("double"), unit=none),
        "sum_where": lambda: picked(lambda c: _finite(_total(c), unit)),
        "mean_where": lambda: picked(lambda c: _finite(_total(c) / F.size(c), unit)),
        "label_where": lambda: let(_chosen(args, extras), lambda c: F.when(F.size(c) == 1, value(text=F.get(c, 0)["label"], unit=none)).otherwise(value(err="not exactly one passes"))),
        "category_of": lambda: value(text=category_of(F.get(raw, 0)["label"]), unit=none),
        "meets_threshold": lambda: _yes_no(passes(a, extras["compare"], extras["threshold"]), none),
        "unanswerable": lambda: value(unit=none),
    }


def apply(op: str | Column, operands: Column, position: Column | None = None, order: Column | None = None, compare: Column | None = None, threshold: Column | None = None) -> Column:
    """The operator's result.  ``op`` is a name, or a column of names."""
    null = F.lit(None)
    extras = {"position": (null if position is None else position).cast("int"), "order": (null if order is None else order).cast("string"), "compare": (null if compare is None else compare).cast("string"), "threshold": (null if threshold is None else threshold).cast("double")}
    names = [op] if isinstance(op, str) else list(SPECS)

    def body(raw: Column, same: Column, as_numbers: Column) -> Column:
        units = F.array_distinct(F.transform(raw, lambda a: F.coalesce(a["unit"], F.lit(""))))
        numbered = F.transform(raw, lambda a: F.struct(a["label"].alias("label"), number(a).alias("num"), a["str"].alias("str"), a["unit"].alias("unit"), a["err"].alias("err")))

        def checked(args: Column) -> Column:
            parts = _branches(args, raw, F.get(units, 0), extras)
            if isinstance(op, str):
                result = parts[op]()
            else:
                result = F.when(F.lit(False), value())
                for name in names:
                    result = result.when(op == name, parts[name]())
                result = result.otherwise(value(err="unknown operator"))
            failed = F.filter(raw, lambda a: a["err"].isNotNull())
            return (
                F.when(same & (F.size(units) > 1), value(err="units differ")).when(F.size(failed) > 0, value(err=F.get(failed, 0)["err"]))
                .when(as_numbers & F.exists(args, lambda a: a["num"].isNull()), value(err="not a number")).otherwise(result)
            )

        return let(numbered, checked)

    if isinstance(op, str):
        return let(operands, lambda raw: body(raw, F.lit(SPECS[op].same_unit), F.lit(converts(op))))
    return let(F.struct(operands.alias("raw"), spec_of(op).alias("spec")), lambda x: body(x["raw"], x["spec"]["same_unit"], x["spec"]["converts"]))
