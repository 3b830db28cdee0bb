"""Keys, labels and rules over text."""

from __future__ import annotations

import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .numbers import strip

SEPARATOR = " · "
#: Cyrillic letters and the Latin ones they look like.  Fixed values.
CYRILLIC = "АВЕКМНОРСТХаеорсх"
LATIN = "ABEKMHOPCTXaeopcx"
#: Wording that asks for an aggregate, a threshold or a named point.  Fixed values.
AGGREGATE = r"(?i)\b(across all|maximum|minimum|highest|lowest|largest|smallest|biggest|greatest|difference|median|(second|third|fourth) (largest|highest|smallest|lowest|biggest|greatest|most|least))\b"
THRESHOLD_WORDED = r"(?i)\b(larger|greater|more|less|smaller|fewer|higher|lower|above|below|over|under|exceed\w*)\b(\s+than)?\s+-?[\d.,]+"
AGGREGATE_WORDED = r"(?i)\b(average|mean|sum|total|how many|count|number of|which)\b"
NAMES_A_POINT = r"(?i)\b(1[89]\d\d|20\d\d|january|february|march|april|may|june|july|august|september|october|november|december|q[1-4])\b"


#: Anything but characters that folding leaves alone, whatever stands beside them: ASCII, accented Latin letters, Greek, Cyrillic, dashes, quotes, Han.
NOT_PLAIN = r"[\x{80}-\x{10FFFF}&&[^\u00A1-\u00A7\u00A9\u00AB-\u00AE\u00B0\u00B1\u00B6\u00B7\u00BB\u00BF-\u0131\u0134-\u013E\u0141-\u0148\u014A-\u017E\u0391-\u03A1\u03A3-\u03CE\u0400-\u0482\u2010\u2012-\u2016\u2018-\u2023\u20AC\u4E00-\u9FA5]]"
#: Texts that are folded at once.
_SLICE = 64


@F.arrow_udf(StringType())
def _nfkc(text: pa.Array) -> pa.Array:
    folded = lambda part: pa.array([None if x is None else unicodedata.normalize("NFKC", x) for x in part.to_pylist()], pa.string())
    return pa.concat_arrays([folded(text.slice(i, _SLICE)) for i in range(0, len(text), _SLICE)] or [pa.array([], pa.string())])


def folded(text: Column) -> Column:
    """Unicode compatibility folding; only texts with a character that folding may touch go to Python."""
    touched = (F.octet_length(text) > F.length(text)) & text.rlike(NOT_PLAIN)
    return F.coalesce(_nfkc(F.when(touched, text)), text)


@F.pandas_udf(StringType())
def _casefold(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else x.casefold())


def one_spaced(text: Column) -> Column:
    """Words with one space between, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalise_question(question: Column, nfkc: bool = True) -> Column:
    """Unicode compatibility folding, lower case, one space between words, no closing ``?.!`` or space.

    Without ``nfkc``, for text that is known to be folded, no Python is needed.
    """
    text = folded(question) if nfkc else question
    return strip(F.rtrim(one_spaced(F.lower(text)), F.lit(" ?.!")))


def dedup_key(content_hash: Column, question: Column) -> Column:
    """What makes two records one: 16 characters of each hash."""
    return F.concat_ws(":", F.substring(content_hash, 1, 16), F.substring(F.sha2(normalise_question(question), 256), 1, 16))


def record_id(source: Column, split: Column, row: Column, content_hash: Column, question: Column) -> Column:
    """A stable id of a record."""
    key = F.concat_ws("|", source, split, row.cast("string"), content_hash, normalise_question(question))
    return F.concat_ws("_", source, split, F.substring(F.sha2(key, 256), 1, 16))


def fold_for_matching(text: Column) -> Column:
    """Look-alike letters, case and white space folded; null reads ``none``."""
    return one_spaced(F.lower(F.translate(F.coalesce(text, F.lit("None")), CYRILLIC, LATIN)))


def answer_key(answer: Column, casefold: bool = False) -> Column:
    """Answers that differ in case and spacing only are one; ``casefold`` also folds letters like sharp s."""
    return one_spaced(_casefold(answer) if casefold else F.lower(answer))


def qualified_label(label: Column, series: Column, same_label: Column) -> Column:
    """Series and label where several elements of a record have the label."""
    return F.when((same_label > 1) & (F.coalesce(series, F.lit("")) != ""), F.concat(series, F.lit(SEPARATOR), label)).otherwise(label)


def qualified_labels(elements: Column) -> Column:
    """P05 inside a record: labels of an array of elements with ``label`` and ``series``."""
    labels = F.transform(elements, lambda e: F.coalesce(e["label"], F.lit("None")))
    return F.zip_with(elements, labels, lambda e, label: qualified_label(label, e["series"], F.size(F.filter(labels, lambda x: x == label))))


def category_of(label: Column) -> Column:
    """What stands after the first separator, or all of it."""
    parts = F.split(label, SEPARATOR, 2)
    return F.coalesce(F.get(parts, 1), label)


def label_parts(label: Column) -> Column:
    """``series`` and ``category`` of a qualified label, null if either is missing."""
    parts = F.split(label, SEPARATOR, 2)
    whole = (F.size(parts) == 2) & (F.get(parts, 0) != "") & (F.get(parts, 1) != "")
    return F.when(whole, F.struct(F.get(parts, 0).alias("series"), F.get(parts, 1).alias("category")))


def chart_type(raw: Column) -> Column:
    """P10: canonical names of chart types."""
    return F.when(raw == "v_bar", "vbar").when(raw == "h_bar", "hbar").when(F.coalesce(raw, F.lit("")) == "", "unknown").otherwise(raw)


def unit_of(raw_value: Column, declared: Column) -> Column:
    """The declared unit, else a percent sign behind or a dollar sign before the value."""
    plain = strip(raw_value)
    return F.coalesce(F.nullif(declared, F.lit("")), F.when(plain.endswith("%"), F.lit("%")).when(plain.startswith("$"), F.lit("$")))


def question_of(prompt: Column) -> Column:
    """The first ``QUESTION:`` line of a prompt."""
    return strip(F.regexp_extract(prompt, r"(?m)^QUESTION:(.*)$", 1))


def quarantine_reason(op: Column, plain_lookup: Column, has_threshold: Column, question: Column) -> Column:
    """Why a plan that reproduces its answer isn't trusted, or null.

    ``plain_lookup``: a lookup or label of one fact.
    """
    shortcut = op.isin("lookup", "label_of") & plain_lookup & question.rlike(AGGREGATE) & ~question.rlike(NAMES_A_POINT)
    hidden = ~has_threshold & question.rlike(THRESHOLD_WORDED) & question.rlike(AGGREGATE_WORDED)
    return F.when(shortcut, "shortcut").when(hidden, "hidden_filter")


def stem(path: Column) -> Column:
    """A file name without its last extension."""
    return F.regexp_replace(path, r"\.[^.]*$", "")


def safe_file_name(index: Column, identifier: Column) -> Column:
    """A row's number and its id with nothing but letters, digits, ``_.-``."""
    safe = F.substring(F.regexp_replace(identifier, r"[^A-Za-z0-9_.-]+", "_"), 1, 80)
    number = index.cast("string")
    return F.concat(F.lpad(number, F.greatest(F.length(number), F.lit(6)), F.lit("0")), F.lit("_"), safe, F.lit(".png"))


def fill_template(template: str, **columns: Column) -> Column:
    """P25: a prompt from a template with ``{name}`` places."""
    text = F.lit(template)
    for name, value in columns.items():
        text = F.replace(text, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return text


def render_table(columns: Column, rows: Column, most: int = 20) -> Column:
    """A table's header and first rows as lines of cells, and how many rows follow."""
    line = lambda cells: F.array_join(cells, " | ", "")
    body = F.array_join(F.transform(F.slice(rows, 1, most), line), "\n")
    more = F.size(rows) - most
    rest = F.when(more > 0, F.concat(F.lit("\n… and "), more.cast("string"), F.lit(" further rows"))).otherwise(F.lit(""))
    return F.concat(line(columns), F.lit("\n"), body, rest)


def format_prediction(boxes: Column, answer: Column) -> Column:
    """Boxes and answer in the scorer's notation."""
    shown = F.transform(boxes, lambda b: F.concat(F.lit("<box>"), F.array_join(b.cast("array<string>"), ","), F.lit("</box>")))
    return F.concat(F.array_join(shown, ""), F.lit("<grounding-sep>"), F.coalesce(answer, F.lit("")))


def scope_phrase(labels: Column) -> Column:
    """`` among a, b, and c``."""
    n = F.size(labels)
    head = F.array_join(F.slice(labels, F.lit(1), F.greatest(n - 1, F.lit(0))), ", ")
    last = F.get(labels, n - 1)
    listed = F.when(n <= 1, last).when(n == 2, F.concat(head, F.lit(" and "), last)).otherwise(F.concat(head, F.lit(", and "), last))
    return F.concat(F.lit(" among "), listed)


def entity_noun(labels: Column) -> Column:
    """What kind of thing labels name; most of them must fit, at least two."""
    enough = F.greatest(F.lit(2), F.floor(F.size(labels) / 2)).cast("int")
    fits = lambda pattern: F.size(F.filter(labels, lambda x: F.lower(x).rlike(pattern))) >= enough
    years = (F.size(labels) > 0) & F.forall(labels, lambda x: x.rlike(r"^(1[89]|20)\d\d$"))
    return (
        F.when(years, "year").when(fits(r"^q[1-4]\b"), "quarter")
        .when(fits(r"^(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"), "month")
        .when(fits(r"^\d+\s*(-|–|to)\s*\d+|^\d+\+"), "age group").otherwise("category")
    )


def position_reference(index: Column, size: Column) -> Column:
    """First, second, third, last, or a number from the left."""
    return F.when(index == 0, "first").when(index == size - 1, "last").when(index == 1, "second").when(index == 2, "third").otherwise(F.concat(F.lit("number "), (index + 1).cast("string")))


def rename_truncated(operand: Column, names: Column, least: int = 8) -> Column:
    """The one fact name of at least 8 characters that an operand starts with, else the operand."""
    fitting = F.filter(names, lambda n: (F.length(n) >= least) & F.startswith(operand, n))
    return F.when(F.array_contains(names, operand) | (F.size(fitting) != 1), operand).otherwise(F.get(fitting, 0))


def colour_reference(colours: Column, index: Column) -> Column:
    """``the red one`` where an element's colour word is its own, else null."""
    word = F.get(colours, index)
    return F.when(F.size(F.filter(colours, lambda c: c == word)) == 1, F.concat(F.lit("the "), word, F.lit(" one")))
