"""Numbers in text, and when two of them agree.

There are two readings of a number: ``parse_numeric`` (plans: thousands
separators and currency are noise, a percent sign is dropped) and ``to_float``
(scoring: a percent sign divides by 100, nothing else is forgiven).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .once import let

#: Deleted inside a number: comma, dollar, space, no-break, narrow no-break and thin space.  Fixed values.
SEPARATORS = ",$    "
#: A plain decimal number with white space around it; the number is the first group.
_DECIMAL = r"(?U)^\s*([+-]?(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+(?:_\d+)*)?)\s*$"
#: Numbers in a sentence, not glued to a word or to another number.
NUMBER_IN_TEXT = r"(?<![\w.])-?\d[\d,]*(?:\.\d+)?"


def strip(text: Column) -> Column:
    """Without any Unicode white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _finite(number: Column) -> Column:
    # NaN counts as larger than infinity
    return F.when(F.abs(number) < F.lit(float("inf")), number)


def read_decimal(text: Column) -> Column:
    """A plain decimal number, or null: no hexadecimal, type suffix, NaN or infinity."""
    read = F.replace(F.regexp_extract(text, _DECIMAL, 1), F.lit("_"), F.lit("")).try_cast("double")
    # too large a number reads as an infinity; taken out without naming the number twice, as each name reads the text again
    return F.get(F.array_remove(F.array_remove(F.array(read), F.lit(float("inf"))), F.lit(float("-inf"))), F.lit(0))


def parse_numeric(text: Column) -> Column:
    """A plan operand's number.  ``1,200`` is 1200, ``12%`` is 12, ``%`` is null."""
    return read_decimal(F.rtrim(F.translate(strip(text), SEPARATORS, ""), F.lit("%")))


def to_float(text: Column) -> Column:
    """A scored answer's number.  ``12%`` is 0.12, ``1,200`` is null."""
    return let(strip(text), lambda plain: read_decimal(F.rtrim(plain, F.lit("%"))) / F.when(plain.endswith("%"), 100.0).otherwise(1.0))


def question_numbers(question: Column) -> Column:
    """The distinct numbers that a question states."""
    found = F.transform(F.regexp_extract_all(question, F.lit(NUMBER_IN_TEXT), F.lit(0)), parse_numeric)
    return F.array_distinct(F.filter(found, lambda x: x.isNotNull()))


def gold_tolerance(gold: Column) -> Column:
    """Half a unit of the last decimal that the gold text prints."""
    plain = F.rtrim(F.translate(strip(gold), ",$", ""), F.lit("%"))
    decimals = F.length(F.coalesce(F.get(F.split(plain, r"\.", 2), 1), F.lit("")))
    return F.lit(0.5) * F.pow(F.lit(10.0), -decimals.cast("double"))


def _both(x: Column, y: Column, body: Callable[[Column, Column], Column]) -> Column:
    """``body`` of two values, each computed once."""
    return let(F.struct(x.alias("x"), y.alias("y")), lambda v: body(v["x"], v["y"]))


def _same_text(a: Column, b: Column) -> Column:
    return F.lower(strip(a)) == F.lower(strip(b))


def relaxed_correctness(target: Column, prediction: Column, tolerance: float = 0.05) -> Column:
    """P50: within 5 % of the target; a zero or non-numeric target must be met as text."""

    def judged(t: Column, p: Column) -> Column:
        close = F.abs(p - t) / F.abs(t) <= F.lit(tolerance)
        return F.when(t.isNotNull() & (t != 0) & p.isNotNull(), close).otherwise(_same_text(target, prediction))

    return F.coalesce(_both(to_float(target), to_float(prediction), judged), F.lit(False))


def relaxed_close(target: Column, prediction: Column, tolerance: float = 0.05) -> Column:
    """P50 for numbers that are numbers already: within 5 % of a target that isn't zero, or equal to it."""
    close = F.abs(prediction - target) / F.abs(F.nullif(target, F.lit(0.0))) <= F.lit(tolerance)
    return F.coalesce(F.when(target == 0, prediction == 0).otherwise(close), F.lit(False))


def answers_agree(a: Column, b: Column, tolerance: float = 0.05) -> Column:
    """The symmetric test; two zeros agree, texts that aren't numbers are compared as texts."""

    def judged(x: Column, y: Column) -> Column:
        scale = F.greatest(F.abs(x), F.abs(y))
        near = (scale == 0) | (F.abs(x - y) <= F.lit(tolerance) * scale)
        return F.when(x.isNotNull() & y.isNotNull(), near).otherwise(relaxed_correctness(a, b, tolerance))

    return _both(parse_numeric(a), parse_numeric(b), judged)


def matches_gold(value: Column, gold: Column) -> Column:
    """A number at the precision that the gold text prints."""
    slack = lambda v, t: F.lit(1e-12) * F.greatest(F.abs(v), F.abs(t), F.lit(1.0))
    return F.coalesce(_both(value, parse_numeric(gold), lambda v, t: F.abs(v - t) <= gold_tolerance(gold) + slack(v, t)), F.lit(False))


def result_matches_gold(number: Column, text: Column, gold: Column) -> Column:
    """P52 for a plan's result, which is a number or a text (or neither: no match)."""
    by_text = F.coalesce(_same_text(text, gold), F.lit(False))
    return F.when(number.isNotNull(), matches_gold(number, gold)).when(text.isNotNull(), by_text).otherwise(F.lit(False))


def values_agree(table: Column, element: Column) -> Column:
    """A table's and an annotation's value within 2 %, or the one the other's percentage."""
    near = lambda x, y: F.abs(x - y) <= F.lit(0.02) * F.greatest(F.abs(x), F.abs(y), F.lit(1e-9))
    return _both(parse_numeric(table), parse_numeric(element), lambda a, b: F.when(a.isNull() | b.isNull(), F.lit(True)).otherwise(near(a, b) | near(a * 100, b)))


def format_answer(value: Column) -> Column:
    """Whole numbers without decimals, others with at most two; null if not finite."""
    whole = F.abs(value - F.rint(value)) < F.lit(1e-9)
    short = F.rtrim(F.rtrim(F.format_string("%.2f", value), F.lit("0")), F.lit("."))
    return F.when(_finite(value).isNull(), F.lit(None).cast("string")).when(whole, F.rint(value).cast("long").cast("string")).otherwise(short)


def as_answer(number: Column, text: Column, flag: Column) -> Column:
    """A result as scored text: Yes or No, whole numbers as integers, nothing as empty text."""
    whole = number == F.floor(number)
    shown = F.when(whole & (F.abs(number) < 1e16), number.cast("decimal(38,0)").cast("string")).otherwise(number.cast("string"))
    return F.when(flag.isNotNull(), F.when(flag, F.lit("Yes")).otherwise(F.lit("No"))).when(number.isNotNull(), shown).otherwise(F.coalesce(text, F.lit("")))


def warmup_decay(step: Column, steps: int, warmup: int, kind: str = "cosine") -> Column:
    """The learning rate's factor at a step."""
    rising = (step + 1) / F.lit(float(max(1, warmup)))
    share = F.least(F.lit(1.0), (step - warmup) / F.lit(float(max(1, steps - warmup))))
    falling = {"cosine": F.lit(0.5) * (1 + F.cos(F.lit(3.141592653589793) * share)), "linear": 1 - share, "constant": F.lit(1.0)}[kind]
    return F.when(step < warmup, rising).otherwise(F.greatest(F.lit(0.0), falling))


def normalised_percentages(values: Column) -> Column:
    """Shares of a hundred with two decimals; what rounding leaves goes to the largest."""
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    cents = F.transform(values, lambda x: F.floor(x / total * 10000))
    left = F.lit(10000) - F.aggregate(cents, F.lit(0).cast("long"), lambda a, x: a + x)
    top = F.array_position(cents, F.array_max(cents)).cast("int") - 1
    return F.transform(cents, lambda c, i: F.when(i == top, c + left).otherwise(c) / F.lit(100.0))


def axis_limits(values: Column, room: float = 0.1) -> Column:
    """An axis from zero, or below the least value, to some room above the largest."""
    high, low = F.array_max(values), F.array_min(values)
    return F.struct(F.least(F.lit(0.0), low * (1 + room)).alias("low"), F.greatest(F.lit(0.0), high * (1 + room)).alias("high"))
