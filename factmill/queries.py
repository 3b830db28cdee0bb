"""Queries over the driver's tables, one for each operator or family, with DuckDB SQL where it can say the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import colours, geometry, json_tools, numbers, text
from .operators import align, dedup, facts, keyed, metrics, mixture, synthetic
from .plans import compile as plans
from .plans import nodes, targets, verify
from .session import shared_folder
from .streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- plans over charts: a region is a chart, its nations' order totals are its facts

FACTS_SQL = """
WITH v AS (
  SELECT r_name AS chart, n_name AS label, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS num
  FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY chart ORDER BY label) AS k FROM v),
f AS (SELECT chart, list(num ORDER BY k) AS n, list(label ORDER BY k) AS l FROM k GROUP BY chart)
"""


def chart_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``chart, facts``: facts f1 to f5 of each region, in the order of nations' names."""
    t = lambda name: table(spark, sf_dir, name)
    nations = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    # orders shrink to customers' totals before they meet anything else
    totals = t("orders").groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("_total"))
    joined = totals.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    values = joined.groupBy(F.col("r_name").alias("chart"), F.col("n_name").alias("label")).agg(F.sum("_total").cast("double").alias("num"))
    listed = F.array_sort(F.collect_list(F.struct("label", "num")))
    fact = lambda x, i: F.struct(F.concat(F.lit("f"), (i + 1).cast("string")).alias("id"), x["label"].alias("label"), x["num"].alias("num"), F.lit(None).cast("string").alias("str"), F.lit("USD").alias("unit"))
    return values.groupBy("chart").agg(listed.alias("_listed")).select("chart", F.transform("_listed", fact).alias("facts"))


def _refs(*ids: int) -> list[dict]:
    return [{"ref": f"f{i}"} for i in ids]


def op(name: str, *args, **extra) -> dict:
    return {"op": name, "args": [a for x in args for a in (x if isinstance(x, list) else [x])], **extra}


ALL = _refs(1, 2, 3, 4, 5)
_SUM = "0.0::DOUBLE + n[1] + n[2] + n[3] + n[4] + n[5]"
_PASS = {"compare": "greater", "threshold": 1e7}
_WHERE = "list_filter(n, lambda x: x > 1e7)"
_FOLD = "list_reduce(list_prepend(0.0::DOUBLE, {}), lambda a, x: a + x)"
_LABEL = "l[list_position(n, {})]"


def _yes(test: str) -> str:
    return f"CASE WHEN {test} THEN 'Yes' ELSE 'No' END"


#: plan, SQL of its number, text, unit and error
PLANS: dict[str, tuple] = {
    "plan_lookup": (op("lookup", _refs(1)), "n[1]", "NULL", "'USD'", "NULL"),
    "plan_label_of": (op("label_of", _refs(2)), "NULL", "l[2]", "''", "NULL"),
    "plan_difference": (op("difference", _refs(1, 2)), "n[1] - n[2]", "NULL", "'USD'", "NULL"),
    "plan_absolute_difference": (op("absolute_difference", _refs(1, 2)), "abs(n[1] - n[2])", "NULL", "'USD'", "NULL"),
    "plan_ratio": (op("ratio", _refs(1, 2)), "n[1] / n[2]", "NULL", "''", "NULL"),
    "plan_percentage": (op("percentage", _refs(1, 2)), "n[1] * 100 / n[2]", "NULL", "'%'", "NULL"),
    "plan_percent_change": (op("percent_change", _refs(1, 2)), "(n[1] - n[2]) * 100 / n[2]", "NULL", "'%'", "NULL"),
    "plan_sum": (op("sum", ALL), _SUM, "NULL", "'USD'", "NULL"),
    "plan_mean": (op("mean", ALL), f"({_SUM}) / 5", "NULL", "'USD'", "NULL"),
    "plan_median": (op("median", ALL), "list_sort(n)[3]", "NULL", "'USD'", "NULL"),
    "plan_min": (op("min", ALL), "list_min(n)", "NULL", "'USD'", "NULL"),
    "plan_max": (op("max", ALL), "list_max(n)", "NULL", "'USD'", "NULL"),
    "plan_count": (op("count", ALL), "len(n)", "NULL", "''", "NULL"),
    "plan_argmin": (op("argmin", ALL), "NULL", _LABEL.format("list_min(n)"), "''", "NULL"),
    "plan_argmax": (op("argmax", ALL), "NULL", _LABEL.format("list_max(n)"), "''", "NULL"),
    "plan_rank": (op("rank", ALL, position=2, order="descending"), "NULL", _LABEL.format("list_reverse_sort(n)[2]"), "''", "NULL"),
    "plan_rank_value": (op("rank_value", ALL, position=2, order="ascending"), "list_sort(n)[2]", "NULL", "'USD'", "NULL"),
    "plan_compare": (op("compare", _refs(1, 2)), "NULL", "CASE WHEN n[1] > n[2] THEN 'greater' WHEN n[1] < n[2] THEN 'less' ELSE 'equal' END", "''", "NULL"),
    "plan_greater_than": (op("greater_than", _refs(1, 2)), "NULL", _yes("n[1] > n[2]"), "''", "NULL"),
    "plan_less_than": (op("less_than", _refs(1, 2)), "NULL", _yes("n[1] < n[2]"), "''", "NULL"),
    "plan_equal_to": (op("equal_to", _refs(1), op("min", ALL)), "NULL", _yes("n[1] = list_min(n)"), "''", "NULL"),
    "plan_meets_threshold": (op("meets_threshold", _refs(3), **_PASS), "NULL", _yes("n[3] > 1e7"), "''", "NULL"),
    "plan_count_where": (op("count_where", ALL, **_PASS), f"len({_WHERE})", "NULL", "''", "NULL"),
    "plan_sum_where": (op("sum_where", ALL, **_PASS), f"CASE WHEN len({_WHERE}) > 0 THEN {_FOLD.format(_WHERE)} END", "NULL", f"CASE WHEN len({_WHERE}) > 0 THEN 'USD' END", f"CASE WHEN len({_WHERE}) = 0 THEN 'nothing passes' END"),
    "plan_mean_where": (op("mean_where", ALL, **_PASS), f"CASE WHEN len({_WHERE}) > 0 THEN {_FOLD.format(_WHERE)} / len({_WHERE}) END", "NULL", f"CASE WHEN len({_WHERE}) > 0 THEN 'USD' END", f"CASE WHEN len({_WHERE}) = 0 THEN 'nothing passes' END"),
    "plan_label_where": (op("label_where", ALL, **_PASS), "NULL", f"CASE WHEN len({_WHERE}) = 1 THEN {_LABEL.format(f'{_WHERE}[1]')} END", f"CASE WHEN len({_WHERE}) = 1 THEN '' END", f"CASE WHEN len({_WHERE}) <> 1 THEN 'not exactly one passes' END"),
    "plan_category_of": (op("category_of", op("argmax", ALL)), "NULL", _LABEL.format("list_max(n)"), "''", "NULL"),
    "plan_nested": (op("percentage", _refs(1), op("sum", ALL)), f"n[1] * 100 / ({_SUM})", "NULL", "'%'", "NULL"),
    "plan_nested_depth4": (op("ratio", op("difference", op("sum", op("mean", ALL), _refs(1)), _refs(2)), _refs(3)), f"((0.0::DOUBLE + ({_SUM}) / 5 + n[1]) - n[2]) / n[3]", "NULL", "''", "NULL"),
    "plan_unit_mismatch": (op("difference", _refs(1), op("ratio", _refs(1, 2))), "NULL", "NULL", "NULL", "'units differ'"),
    "plan_unanswerable": (op("unanswerable"), "NULL", "NULL", "''", "NULL"),
}


def _plan_query(name: str, plan: dict) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = chart_facts(spark, sf_dir)
        return rows.select("chart", plans.compile_plan(plan, F.col("facts")).alias("r")).select("chart", "r.num", "r.str", "r.unit", "r.err")

    run.__name__ = name
    QUERIES[name] = run


for _name, (_plan, *_sql) in PLANS.items():
    _plan_query(_name, _plan)
    ORACLE_SQL[_name] = FACTS_SQL + "SELECT chart, ({})::DOUBLE AS num, ({})::VARCHAR AS str, ({})::VARCHAR AS unit, ({})::VARCHAR AS err FROM f".format(*_sql)


@query(FACTS_SQL + f"""SELECT chart,
  CASE substr(chart, 1, 1) WHEN 'A' THEN n[1] - n[2] WHEN 'E' THEN {_SUM} ELSE n[1] * 100 / ({_SUM}) END AS num,
  CASE substr(chart, 1, 1) WHEN 'A' THEN 'USD' WHEN 'E' THEN 'USD' ELSE '%' END AS unit,
  CASE substr(chart, 1, 1) WHEN 'A' THEN 1 WHEN 'E' THEN 1 ELSE 2 END AS depth FROM f""")
def plan_nodes_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan of its own for each row, as JSON."""
    import json

    d, s, p = (json.dumps(x) for x in (op("difference", _refs(1, 2)), op("sum", ALL), op("percentage", _refs(1), op("sum", ALL))))
    first = F.substring("chart", 1, 1)
    rows = chart_facts(spark, sf_dir).withColumn("plan", nodes.read(F.when(first == "A", d).when(first == "E", s).otherwise(p)))
    return rows.select("chart", nodes.evaluate(F.col("plan"), F.col("facts"), 2).alias("r"), nodes.depth_of(F.col("plan")).alias("depth")).select("chart", "r.num", "r.unit", "depth")


@query(FACTS_SQL + """SELECT * FROM (VALUES
  ('accepted'), ('rejected:does_not_reproduce_the_answer'), ('rejected:operand_not_in_evidence'), ('rejected:unknown_operation'), ('rejected:vacuous_single_item_fold'),
  ('rejected:threshold_not_stated_in_the_question'), ('rejected:executor_refused'), ('rejected:malformed_plan'), ('rejected:does_not_cover_the_marked_regions'), ('rejected:missing_marked_fact_ids')) t(status), (SELECT count(*) AS n FROM f)""")
def verify_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chart's plan with ten injected faults, and how often each verdict falls."""
    import json

    total = json.dumps(op("sum", ALL))
    cases = {
        "ok": total, "answer": total, "unmarked": total, "fact": json.dumps(op("lookup", _refs(9))), "operator": json.dumps(op("guess", ALL)), "single": json.dumps(op("sum", _refs(1))),
        "threshold": json.dumps(op("count_where", ALL, compare="greater", threshold=7)), "refused": json.dumps(op("ratio", _refs(1), op("difference", _refs(2, 2)))),
        "shape": json.dumps(op("lookup", _refs(1, 2))), "covering": json.dumps(op("sum", _refs(1, 2))),
    }
    rows = chart_facts(spark, sf_dir).crossJoin(F.broadcast(spark.createDataFrame(list(cases.items()), "case string, plan string")))
    # the difference of two facts has the facts' unit, so that case must be told by its zero
    zero = json.dumps(op("percentage", _refs(1), op("difference", _refs(2, 2))))
    plan = nodes.read(F.when(F.col("case") == "refused", F.lit(zero)).otherwise(F.col("plan")))
    sums = F.aggregate("facts", F.lit(0.0), lambda a, f: a + f["num"])
    two = F.aggregate(F.slice("facts", 1, 2), F.lit(0.0), lambda a, f: a + f["num"])
    answer = F.when(F.col("case") == "answer", F.lit("1")).when(F.col("case") == "covering", F.format_string("%.2f", two)).otherwise(F.format_string("%.2f", sums))
    marked = F.when(F.col("case") == "covering", F.array(F.lit("f3"))).when(F.col("case") == "unmarked", F.lit(None)).otherwise(F.array(F.lit("f1")))
    judged = rows.select(verify.verdict(plan, F.col("facts"), answer, F.lit("How many are over 5?"), marked.cast("array<string>"), F.col("case") == "unmarked").alias("v"))
    return judged.groupBy("v.status").agg(F.count("*").alias("n"))


@query("""
WITH d AS (SELECT event_type, date_trunc('day', ts) AS day, count(*)::DOUBLE AS n FROM events GROUP BY ALL),
s AS (SELECT event_type, n - lag(n) OVER (PARTITION BY event_type ORDER BY day) AS step FROM d)
SELECT event_type, CASE WHEN bool_and(step > 0) THEN 'increasing' WHEN bool_and(step < 0) THEN 'decreasing' WHEN bool_and(step = 0) THEN 'flat' ELSE 'mixed' END AS trend
FROM s WHERE step IS NOT NULL GROUP BY event_type""")
def plan_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X16 over facts that are each type's daily counts in the order of days."""
    days = table(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.count("*").cast("double").alias("n"))
    listed = days.groupBy("event_type").agg(F.array_sort(F.collect_list(F.struct("day", "n"))).alias("d"))
    from .plans.evaluate import apply, value

    args = F.transform("d", lambda x: value(x["n"], label=x["day"].cast("string")))
    return listed.select("event_type", apply("trend", args)["str"].alias("trend"))


@query("""
WITH v AS (SELECT n_regionkey, c_mktsegment AS series, n_name AS label FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
c AS (SELECT *, count(*) OVER (PARTITION BY n_regionkey, label) AS same FROM v)
SELECT n_regionkey, series, label, CASE WHEN same > 1 THEN series || ' · ' || label ELSE label END AS qualified, label AS category FROM c""")
def plan_label_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that several series share are qualified; the category is what stands behind."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.select("n_regionkey", F.col("c_mktsegment").alias("series"), F.col("n_name").alias("label")).distinct()
    same = F.count("*").over(Window.partitionBy("n_regionkey", "label"))
    named = rows.withColumn("qualified", text.qualified_label(F.col("label"), F.col("series"), same))
    return named.withColumn("category", text.category_of(F.col("qualified")))


# --- keys, numbers, colours

NORM_SQL = r"trim(rtrim(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), ' ?.!'))"


@query(f"SELECT doc_id, substr(sha256(source), 1, 16) || ':' || substr(sha256({NORM_SQL}), 1, 16) AS key FROM documents")
def norm_question_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.dedup_key(F.sha2("source", 256), F.col("text")).alias("key"))


@query(f"SELECT doc_id, source || '_train_' || substr(sha256(source || '|train|' || doc_id || '|' || sha256(source) || '|' || {NORM_SQL}), 1, 16) AS record_id FROM documents")
def record_id_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.record_id(F.col("source"), F.lit("train"), F.col("doc_id"), F.sha2("source", 256), F.col("text")).alias("record_id"))


@query("""
WITH p AS (SELECT l_orderkey, l_linenumber, l_extendedprice, round(l_extendedprice * 100)::BIGINT AS c, l_partkey % 5 AS form FROM lineitem)
SELECT form::BIGINT AS form, count(*) AS n, sum(CASE form WHEN 0 THEN c WHEN 1 THEN c WHEN 2 THEN c ELSE NULL END)::BIGINT AS cents, count(CASE WHEN form <= 2 THEN 1 END) AS numbers FROM p GROUP BY form""")
def parse_numeric_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P08 over prices written as ``$1,234.5``, ``12%``, plain, as a word and as ``inf``."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 5).alias("form"), (F.round(F.col("l_extendedprice") * 100).cast("long") / 100).cast("decimal(18,2)").alias("x"))
    shown = F.when(F.col("form") == 0, F.concat(F.lit("$ "), F.format_number("x", 2))).when(F.col("form") == 1, F.concat(F.col("x").cast("string"), F.lit("%"))).when(F.col("form") == 2, F.col("x").cast("string")).when(F.col("form") == 3, F.concat(F.col("x").cast("string"), F.lit("d"))).otherwise(F.lit("inf"))
    value = numbers.parse_numeric(shown)
    return rows.select("form", value.alias("v")).groupBy("form").agg(F.count("*").alias("n"), F.sum(F.round(F.col("v") * 100).cast("long")).alias("cents"), F.count("v").alias("numbers"))


@query("""
WITH p AS (SELECT (l_quantity::BIGINT)::INT AS q, l_linenumber % 3 AS form FROM lineitem)
SELECT form::INT AS form, q, CASE form WHEN 0 THEN q / 100.0::DOUBLE WHEN 1 THEN q::DOUBLE ELSE NULL END AS value, count(*) AS n FROM p GROUP BY ALL""")
def to_float_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``12%`` is 0.12, ``12`` is 12, ``1,200`` is nothing."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("long").cast("int").alias("q"), (F.col("l_linenumber") % 3).alias("form"))
    q = F.col("q").cast("string")
    shown = F.when(F.col("form") == 0, F.concat(q, F.lit("%"))).when(F.col("form") == 1, q).otherwise(F.concat(F.lit("1,"), q))
    return rows.groupBy("form", "q", numbers.to_float(shown).alias("value")).agg(F.count("*").alias("n"))


@query("""
WITH p AS (SELECT l_returnflag, printf('%.1f', l_extendedprice) AS gold, l_extendedprice AS v, l_extendedprice + 0.06 AS off FROM lineitem)
SELECT l_returnflag, count(*) AS n, sum((abs(v - gold::DOUBLE) <= 0.05 + 1e-12 * greatest(abs(v), abs(gold::DOUBLE), 1))::INT)::BIGINT AS same,
  sum((abs(off + 0.05 - gold::DOUBLE) <= 0.05 + 1e-12 * greatest(abs(off), 1))::INT)::BIGINT AS other FROM p GROUP BY l_returnflag""")
def gold_precision_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value agrees with gold text if it would print as it does."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.format_string("%.1f", "l_extendedprice").alias("gold"), F.col("l_extendedprice").alias("v"))
    same, other = numbers.matches_gold(F.col("v"), F.col("gold")), numbers.matches_gold(F.col("v") + 0.06 + 0.05, F.col("gold"))
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if(same).alias("same"), F.count_if(other).alias("other"))


@query("""
WITH p AS (SELECT l_returnflag AS kind, l_extendedprice AS t, l_quantity * p_retailprice AS p FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT kind, kind IS NULL AS overall, count(*) AS n, avg((abs(p - t) / abs(t) <= 0.05)::INT) AS accuracy FROM p GROUP BY ROLLUP (kind)""")
def relaxed_accuracy_by_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of predictions within 5 % of the target, overall and by kind."""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", "l_extendedprice", "l_quantity").join(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
    close = numbers.relaxed_close(F.col("l_extendedprice"), F.col("l_quantity") * F.col("p_retailprice"))
    return metrics.accuracy_by_subset(rows.withColumnRenamed("l_returnflag", "kind"), "kind", close)


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 2 ELSE 1 END AS n, (p_size + CASE WHEN p_size % 2 = 0 THEN 1200 ELSE 0 END)::DOUBLE AS total FROM part""")
def question_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers stated in a question; those glued to words don't count."""
    asked = F.concat(F.lit("Is v2 of "), F.col("p_name"), F.lit(" more than "), F.col("p_size").cast("string"), F.when(F.col("p_size") % 2 == 0, F.lit(" or 1,200?")).otherwise(F.lit("?")))
    found = numbers.question_numbers(asked)
    return table(spark, sf_dir, "part").select("p_partkey", F.size(found).alias("n"), F.aggregate(found, F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("""SELECT reason, count(*) AS n FROM (SELECT CASE p_size % 4 WHEN 0 THEN 'shortcut' WHEN 2 THEN 'hidden_filter' ELSE NULL END AS reason FROM part) GROUP BY reason""")
def quarantine_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P17 over four wordings with two plans."""
    form = F.col("p_size") % 4
    asked = F.when(form == 0, "What is the highest value?").when(form == 1, "What is the highest value of 2019?").when(form == 2, "How many are more than 20?").otherwise("What is the value?")
    op_ = F.when(form < 2, "lookup").otherwise("count")
    reason = text.quarantine_reason(op_, form < 2, F.lit(False), asked)
    return table(spark, sf_dir, "part").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


COLOURS_SQL = """
WITH c AS (SELECT p_partkey, '#' || lpad(lower(to_hex((p_partkey * 7919 + p_size * 104729) % 16777216)), 6, '0') AS colour FROM part),
x AS (SELECT *, ('0x' || substr(colour, 2, 2))::INT / 255 AS r, ('0x' || substr(colour, 4, 2))::INT / 255 AS g, ('0x' || substr(colour, 6, 2))::INT / 255 AS b FROM c),
y AS (SELECT *, greatest(r, g, b) AS hi, greatest(r, g, b) - least(r, g, b) AS s, (greatest(r, g, b) + least(r, g, b)) / 2 AS l FROM x),
z AS (SELECT *, CASE WHEN s = 0 THEN 0 WHEN r = hi THEN (hi - b) / s - (hi - g) / s WHEN g = hi THEN 2 + (hi - r) / s - (hi - b) / s ELSE 4 + (hi - g) / s - (hi - r) / s END / 6 AS t,
  CASE WHEN s = 0 THEN 0 WHEN l <= 0.5 THEN s / (2 * l) ELSE s / (2 - 2 * l) END AS sat FROM y),
h AS (SELECT *, (t - floor(t)) * 360 AS hue FROM z),
n AS (SELECT *, CASE WHEN hue >= 345 OR hue < 12 THEN 'red' WHEN hue < 40 THEN 'orange' WHEN hue < 68 THEN 'yellow' WHEN hue < 160 THEN 'green' WHEN hue < 195 THEN 'teal' WHEN hue < 255 THEN 'blue' WHEN hue < 290 THEN 'purple' ELSE 'pink' END AS base FROM h),
w AS (SELECT p_partkey, colour, CASE WHEN l <= 0.10 THEN ['black', 'dark']
  WHEN l <= 0.22 AND sat > 0.12 THEN ['black', 'dark', 'dark ' || base, base] || CASE WHEN base = 'blue' THEN ['navy'] ELSE [] END WHEN l <= 0.22 THEN ['black', 'dark', 'dark grey', 'grey']
  WHEN l >= 0.92 THEN ['white', 'light'] WHEN sat <= 0.12 AND l < 0.4 THEN ['grey', 'gray', 'silver', 'dark grey', 'dark gray'] WHEN sat <= 0.12 THEN ['grey', 'gray', 'silver', 'light grey', 'light gray']
  WHEN l < 0.38 THEN [base, 'dark ' || base] || CASE base WHEN 'blue' THEN ['navy'] WHEN 'red' THEN ['maroon'] ELSE [] END
  WHEN l > 0.62 THEN [base, 'light ' || base] || CASE WHEN base = 'blue' THEN ['sky blue'] ELSE [] END ELSE [base] END AS words FROM n),
e AS (SELECT p_partkey, unnest(words) AS word FROM w),
d AS (SELECT p_partkey, word, row_number() OVER (PARTITION BY p_partkey ORDER BY -len(string_split(word, ' ')), -len(word), word) AS nth FROM e)
SELECT w.p_partkey, w.colour, d.word, array_to_string(list_sort(words), ',') AS words FROM w JOIN d ON w.p_partkey = d.p_partkey AND nth = 1"""


@query(COLOURS_SQL)
def colour_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P12, P13 over colours made from part keys."""
    digits = F.concat(F.lit("#"), F.lpad(F.lower(F.hex((F.col("p_partkey") * 7919 + F.col("p_size") * 104729) % 16777216)), 6, "0"))
    return table(spark, sf_dir, "part").select("p_partkey", digits.alias("colour"), colours.describe_colour(digits).alias("word"), F.array_join(colours.names_for(digits), ",").alias("words"))


# --- records made of documents

RECORDS_SQL = f"""
WITH r AS (
  SELECT doc_id AS row, 'r' || doc_id AS record_id, ['annotated', 'annotated_extra', 'grounded', 'synthetic'][(doc_id % 4 + 1)::INT] AS source,
         CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'val' ELSE 'test' END AS split, sha256({NORM_SQL}) AS key,
         CASE WHEN doc_id % 3 = 0 THEN NULL ELSE (doc_id % 2)::VARCHAR END AS answer, doc_id % 4 AS rank FROM documents),
g AS (
  SELECT split, key, count(*) AS n, min(row) AS first_row, count(DISTINCT answer) > 1 AS bad, arg_min(record_id, (rank, record_id, row)) AS record_id,
         arg_min(source, (rank, record_id, row)) AS source, arg_min(answer, (rank, record_id, row)) FILTER (answer IS NOT NULL) AS answer,
         list_sort(list(DISTINCT source)) AS merged_from, list_sort(list(DISTINCT record_id)) AS ids FROM r GROUP BY split, key)
"""


def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    sources = F.array(*[F.lit(s) for s in dedup.SOURCES])
    return d.select(
        i.alias("row"), F.concat(F.lit("r"), i.cast("string")).alias("record_id"), F.get(sources, (i % 4).cast("int")).alias("source"),
        F.when(i % 10 < 8, "train").when(i % 10 == 8, "val").otherwise("test").alias("split"), F.sha2(text.normalise_question(F.col("text")), 256).alias("key"),
        F.when(i % 3 != 0, (i % 2).cast("string")).alias("answer"), F.lit(None).cast("string").alias("table"), F.lit(None).cast("string").alias("plan"), F.array().cast("array<array<double>>").alias("boxes"),
    )


@query(RECORDS_SQL + """SELECT split, key, record_id, source, first_row, answer, array_to_string(merged_from, ',') AS merged_from, array_to_string(ids, ',') AS merged_record_ids FROM g WHERE split = 'train' AND NOT bad
UNION ALL SELECT split, key, record_id, source, row, answer, source, record_id FROM r WHERE split <> 'train'""")
def dedup_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup.deduplicate(document_records(spark, sf_dir))
    return out.select("split", "key", "record_id", "source", "first_row", "answer", F.array_join("merged_from", ",").alias("merged_from"), F.array_join("merged_record_ids", ",").alias("merged_record_ids"))


@query(RECORDS_SQL + """SELECT sum(n)::BIGINT AS input_rows, count_if(n > 1)::BIGINT AS duplicate_groups, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS duplicate_rows, count_if(split = 'train' AND bad)::BIGINT AS conflict_groups,
  coalesce(sum(n) FILTER (split = 'train' AND bad), 0)::BIGINT AS quarantined_rows, coalesce(sum(n - 1) FILTER (split = 'train' AND NOT bad), 0)::BIGINT AS duplicates_removed,
  sum(CASE WHEN split <> 'train' THEN n WHEN bad THEN 0 ELSE 1 END)::BIGINT AS output_rows FROM g""")
def dedup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.report(document_records(spark, sf_dir))


@query(RECORDS_SQL + "SELECT key, array_to_string(ids, ',') AS record_ids, 'answer' AS reason FROM g WHERE split = 'train' AND bad")
def dedup_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.conflicts(document_records(spark, sf_dir)).withColumn("record_ids", F.array_join("record_ids", ","))


@query(RECORDS_SQL + """, s AS (SELECT key, split AS split_a, lead(split) OVER (PARTITION BY key ORDER BY split) AS split_b FROM (SELECT DISTINCT key, split FROM r))
SELECT key, split_a, split_b FROM s WHERE split_b IS NOT NULL""")
def cross_split_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.cross_split(document_records(spark, sf_dir))


@query()
def element_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of records with one key, folded in order."""
    i = F.col("row")
    box = F.transform(F.array(*[F.lit(x) for x in (0, 0, 10, 10)]), lambda x: (x + i % 3).cast("double"))
    element = F.to_json(F.array(F.struct(F.lit("a").alias("label"), F.lit("x").alias("series"), box.alias("bbox"))))
    rows = document_records(spark, sf_dir).withColumn("elements", element).withColumn("evidence", F.array(F.lit(0)))
    return dedup.merge_elements(rows)


@query(RECORDS_SQL + "SELECT record_id FROM r WHERE key NOT IN (SELECT key FROM r WHERE split <> 'train')")
def heldout_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose key no held-out record has."""
    rows = document_records(spark, sf_dir)
    return keyed.without_held_out(rows, keyed.held_out_hashes(rows, ["val", "test"], "key"), "key").select("record_id")


@query("""
WITH p AS (SELECT doc_id, 'q' || quality AS plan FROM labels)
SELECT d.doc_id, p.plan FROM documents d LEFT JOIN p USING (doc_id)""")
def attach_plans_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"), F.lit(None).cast("string").alias("plan"))
    p = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("record_id"), F.concat(F.lit("q"), "quality").alias("plan"), F.lit(0).alias("line"))
    return keyed.attach_plans(d, p).select(F.col("record_id").alias("doc_id"), "plan")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(event_id) FILTER (ts = m) AS event_id FROM (SELECT *, max(ts) OVER (PARTITION BY user_id) AS m FROM events) GROUP BY user_id")
def last_wins_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last event."""
    return keyed.last_wins(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("SELECT user_id, arg_min(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def first_wins_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's first event."""
    return keyed.first_per_key(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_type")


@query("SELECT doc_id AS id, 'label' AS origin FROM labels UNION ALL SELECT doc_id, 'document' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def later_wins_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, replaced by labels of the same id."""
    one = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("document").alias("origin"))
    two = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.lit("label").alias("origin"))
    return keyed.later_wins_union([one, two], ["id"], ["origin"])


@query("SELECT (row_number() OVER (ORDER BY o_orderkey) - 1)::BIGINT AS place, o_orderkey, o_totalprice AS price FROM orders")
def zip_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders paired by place with the same orders in the same order."""
    o = table(spark, sf_dir, "orders")
    left, right = keyed.numbered(o.select("o_orderkey"), "o_orderkey"), keyed.numbered(o.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price")), "k")
    return left.join(right, "_place").select(F.col("_place").alias("place"), "o_orderkey", "price")


# --- boxes made of line items

BOXES_SQL = """
WITH e AS (
  SELECT l_orderkey AS record_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i,
         (l_partkey % 40) * 10.0 AS x, (l_suppkey % 20) * 20.0 AS y FROM lineitem),
b AS (SELECT record_id, i AS element_index, x, y, x + 100 AS x2, y + 60 AS y2 FROM e),
g AS (SELECT record_id, element_index AS box_index, x + element_index % 3 AS x, y, x2 + element_index % 3 AS x2, y2 FROM b WHERE element_index <= 2),
p AS (
  SELECT g.record_id, box_index, element_index, greatest(0, least(g.x2, b.x2) - greatest(g.x, b.x)) * greatest(0, least(g.y2, b.y2) - greatest(g.y, b.y)) AS inter
  FROM g JOIN b USING (record_id)),
q AS (SELECT *, (inter / (6000 + 6000 - inter))::DOUBLE AS iou FROM p),
o AS (SELECT *, row_number() OVER (PARTITION BY record_id, box_index ORDER BY iou DESC, element_index) AS nth FROM q),
m AS (
  SELECT record_id, box_index, max(element_index) FILTER (nth = 1) AS element_index, max(iou) FILTER (nth = 1) AS iou, max(iou) FILTER (nth = 1) - coalesce(max(iou) FILTER (nth = 2), 0.0) AS margin
  FROM o WHERE nth <= 2 GROUP BY ALL)
"""


def order_boxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Elements and marked boxes of each order: line items as rectangles of 100 by 60, the first two moved a little."""
    i = F.row_number().over(Window.partitionBy("record_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    # the key has its name before the window, so that what follows finds the rows in their places
    rows = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "record_id").select("record_id", i.alias("element_index"), ((F.col("l_partkey") % 40) * 10.0).alias("x"), ((F.col("l_suppkey") % 20) * 20.0).alias("y"))
    box = lambda shift: F.array(F.col("x") + shift, F.col("y"), F.col("x") + 100 + shift, F.col("y") + 60)
    elements = rows.select("record_id", "element_index", box(F.lit(0)).alias("bbox"))
    boxes = rows.where("element_index <= 2").select("record_id", F.col("element_index").alias("box_index"), box(F.col("element_index") % 3).alias("bbox"))
    return boxes, elements


@query(BOXES_SQL + "SELECT * FROM m")
def iou_align_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each box's best element and its lead."""
    return align.best_matches(*order_boxes(spark, sf_dir))


@query(BOXES_SQL + """, c AS (SELECT record_id, max(box_index) AS n FROM g GROUP BY record_id)
SELECT record_id, string_agg(element_index, ',' ORDER BY box_index) AS evidence FROM m JOIN c USING (record_id) WHERE iou >= 0.9 AND margin >= 0.5
GROUP BY record_id, n HAVING count(*) = n AND count(DISTINCT element_index) = n""")
def iou_aligned_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose boxes all have a clear match of their own."""
    return align.aligned_records(*order_boxes(spark, sf_dir)).withColumn("evidence", F.array_join(F.col("evidence").cast("array<string>"), ","))


@query()
def context_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F08 over each order's first two boxes and the rest of its items."""
    # an order's items are listed where its lines lie sorted, once for the first of them
    lines = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    place = F.struct(((F.col("l_partkey") % 40) * 10.0).alias("x"), ((F.col("l_suppkey") % 20) * 20.0).alias("y"))
    listed = F.collect_list(place).over(lines.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("record_id"), listed.alias("l"), F.row_number().over(lines).alias("i")).where("i = 1")
    box = lambda p: F.array(p["x"], p["y"], p["x"] + 100, p["y"] + 60)
    element = lambda p, i: F.struct(((i + 1) % 3).cast("string").alias("label"), F.when((i + 1) % 2 == 0, F.lit("s")).alias("series"), box(p).alias("bbox"), (i + 1 == 5).alias("conflict"))
    rows = rows.select("record_id", F.transform("l", element).alias("all"))
    state = facts.admit_context(F.slice("all", 1, 2), F.slice("all", 3, 2147483645))
    return rows.select("record_id", state.alias("s")).select("record_id", F.size("s.kept").alias("kept"), "s.renames", "s.ambiguous", "s.conflicts")


@query(BOXES_SQL + """, u AS (SELECT record_id, [x, y, x2, y2]::DOUBLE[] AS box FROM b UNION ALL SELECT record_id, [x, y, x2, y2]::DOUBLE[] FROM g)
SELECT record_id, len(list_reduce(list([box] ORDER BY box), lambda kept, new: CASE WHEN len(list_filter(kept, lambda k: list_max(list_transform(range(1, 5), lambda i: abs(k[i] - new[1][i]))) <= 1)) > 0 THEN kept ELSE list_concat(kept, new) END))::INT AS n_boxes, count(*) AS n
FROM u GROUP BY record_id""")
def box_union_eps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of an order without those that are the same within the slack."""
    boxes, elements = order_boxes(spark, sf_dir)
    both = elements.select("record_id", "bbox").unionByName(boxes.select("record_id", "bbox"))
    return both.groupBy("record_id").agg(F.size(geometry.union_boxes(F.collect_list("bbox"))).alias("n_boxes"), F.count("*").alias("n"))


@query("""
WITH o AS (SELECT vec_id, label, (vec_id * 7919 % 1000) / 1000.0 AS score, (vec_id % 3 = 0) AS hit FROM embeddings),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, label, vec_id) AS place, sum(hit::INT) OVER (ORDER BY score DESC, label, vec_id) AS tp FROM o),
n AS (SELECT count(*)::DOUBLE AS n FROM o WHERE hit),
c AS (SELECT tp::DOUBLE / place AS precision, tp::DOUBLE / n AS recall FROM r, n),
l AS (SELECT range AS level, coalesce((SELECT max(precision) FROM c WHERE floor(recall * 100 + 1e-9) >= range), 0.0) AS p FROM range(101))
SELECT round(avg(p), 9) AS ap FROM l""")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: 101-point average precision of scored hits."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("image"), F.col("vec_id").alias("seq"), ((F.col("vec_id") * 7919 % 1000) / 1000.0).alias("score"), (F.col("vec_id") % 3 == 0).alias("hit"))
    return metrics.average_precision(rows, rows.where("hit").count()).select(F.round("ap", 9).alias("ap"))


@query(BOXES_SQL + """, k1 AS (SELECT record_id, element_index, iou >= 0.5 AS hit FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY iou DESC, element_index DESC) AS nth FROM q WHERE box_index = 1) WHERE nth = 1),
k2 AS (
  SELECT record_id, coalesce(max(q.iou) FILTER (NOT (k1.hit AND k1.element_index = q.element_index)) >= 0.5, false) AS hit
  FROM q JOIN k1 USING (record_id) WHERE box_index = 2 GROUP BY record_id)
SELECT hit, count(*) AS n FROM (SELECT hit FROM k1 UNION ALL SELECT hit FROM k2) GROUP BY hit""")
def detection_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of an order as detections of its elements."""
    boxes, elements = order_boxes(spark, sf_dir)
    found = boxes.select(F.col("record_id").alias("image"), F.col("box_index").cast("long").alias("seq"), (F.lit(1.0) / F.col("box_index")).alias("score"), "bbox")
    hits = metrics.match_detections(found, elements.select(F.col("record_id").alias("image"), F.col("element_index").alias("seq"), "bbox"))
    return hits.groupBy("hit").agg(F.count("*").alias("n"))


@query()
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean order price and its interval."""
    return metrics.bootstrap_interval(table(spark, sf_dir, "orders"), "o_totalprice")


# --- samples and mixtures of documents

_KEY = "sha256('{}|' || doc_id)"


@query("SELECT name, value, count(*) AS n FROM (SELECT unnest(['event_type', 'day', 'big']) AS name, unnest([event_type, dayofweek(ts)::VARCHAR, (value > 50)::VARCHAR]) AS value FROM events) GROUP BY ALL")
def composition_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three histograms in one pass."""
    rows = table(spark, sf_dir, "events").select("event_type", (F.dayofweek("ts") - 1).alias("day"), (F.col("value") > 50).alias("big"))
    return mixture.composition(rows, ["event_type", "day", "big"])


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def outcome_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.outcomes(table(spark, sf_dir, "events"), "event_type")


BALANCED_SQL = f"""
WITH c AS (SELECT lang, count(*) AS n, row_number() OVER (ORDER BY lang) AS i, count(*) OVER () AS k FROM documents GROUP BY lang),
q AS (SELECT lang, 50 // k + (i <= 50 % k)::INT AS quota FROM c),
r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_KEY.format(7)}, doc_id) AS nth FROM documents)
SELECT doc_id, lang FROM r JOIN q USING (lang) WHERE nth <= quota"""


@query(BALANCED_SQL)
def balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty documents, as many of each language."""
    return mixture.balance_by_level(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", 50, 7, "doc_id")


@query(f"""
WITH c AS (SELECT lang, count(*) AS n, sum(count(*)) OVER () AS t FROM documents GROUP BY lang),
x AS (SELECT lang, floor(64 * n / t)::INT AS q, 64 * n / t - floor(64 * n / t) AS rest FROM c),
a AS (SELECT *, row_number() OVER (ORDER BY rest DESC, lang) AS place, 64 - sum(q) OVER () AS missing FROM x),
r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_KEY.format(9)}, doc_id) AS nth FROM documents)
SELECT doc_id, lang, nth <= q + (place <= missing)::INT AS held FROM r JOIN a USING (lang)""")
def stratified_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 documents in proportion to languages are held out."""
    return mixture.stratified_holdout(table(spark, sf_dir, "documents").select("doc_id", "lang"), ["lang"], 64, 9, "doc_id")


@query(f"""
WITH q AS (SELECT * FROM (VALUES ('en', 34), ('fr', 33), ('de', 33)) t(lang, quota)),
r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_KEY.format(3)}, doc_id) AS nth FROM documents)
SELECT doc_id, lang FROM r JOIN q USING (lang) WHERE nth <= quota""")
def reservoir_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred documents of three kinds."""
    return mixture.reservoir_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), ["en", "fr", "de"], "lang", 100, 3, "doc_id")


@query(f"""
WITH a AS (SELECT doc_id, 'real' AS part FROM documents WHERE lang = 'en' ORDER BY {_KEY.format(5)}, doc_id LIMIT 60),
b AS (SELECT doc_id, 'replay' AS part FROM documents WHERE lang <> 'en' ORDER BY {_KEY.format(5)}, doc_id LIMIT 20),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
SELECT doc_id, part, (row_number() OVER (ORDER BY {_KEY.format(6)}, doc_id))::INT AS position FROM u""")
def mixture_stage2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixty documents of one kind and twenty replayed ones, shuffled."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return mixture.replay_mixture(d.where("lang = 'en'").select("doc_id"), d.where("lang <> 'en'").select("doc_id"), 80, 20, 5, "doc_id")


@query("SELECT doc_id, epoch, sha256('1|' || epoch || '|' || doc_id) AS key FROM documents, (SELECT unnest([0, 1, 2])::INT AS epoch) WHERE epoch > 1 OR (epoch = 1 AND sha256('1|1|' || doc_id) > '8')")
def epoch_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three epochs, each in an order of its own, taken up in the midst of the second."""
    feed = mixture.epoch_order(table(spark, sf_dir, "documents").select("doc_id"), 3, 1, "doc_id")
    return mixture.resumed(feed, 1, "8").select("doc_id", "epoch", "key")


@query("SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) // 10)::BIGINT AS batch FROM documents")
def mining_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W08, S18."""
    return mixture.batches(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query("SELECT (item_id % 40)::INT AS position, d.doc_id, d.lang FROM benchmark JOIN documents d ON d.doc_id = item_id % 40 * 3")
def slice_order_preserving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a list of ids, with their places."""
    ids = table(spark, sf_dir, "benchmark").select((F.col("item_id") % 40).cast("int").alias("position"), (F.col("item_id") % 40 * 3).alias("record_id"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"), "lang")
    return keyed.require_all(keyed.slice_in_order(d, ids)).select("position", F.col("record_id").alias("doc_id"), "lang")


@query("SELECT doc_id, quality = 1 AS stage1, toxic = 0 AND quality = 1 AS stage2 FROM labels WHERE quality = 1")
def usability_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels usable for either stage."""
    one, two = mixture.split_by_usability(table(spark, sf_dir, "labels"), F.col("quality") == 1, (F.col("toxic") == 0) & (F.col("quality") == 1))
    return one.select("doc_id").withColumn("stage1", F.lit(True)).join(two.select("doc_id").withColumn("_two", F.lit(True)), "doc_id", "left").select("doc_id", "stage1", F.coalesce("_two", F.lit(False)).alias("stage2"))


@query("""SELECT doc_id, CASE WHEN doc_id % 10 >= 8 THEN 'not_training_split' WHEN doc_id % 7 = 0 THEN 'missing_answer' WHEN trim(text) = '' OR text IS NULL THEN 'missing_question'
  WHEN doc_id % 5 = 0 THEN 'empty_evidence' WHEN doc_id % 4 = 2 THEN 'unaligned_grounding' WHEN doc_id % 11 = 0 THEN 'missing_facts' WHEN doc_id % 13 = 0 THEN 'missing_fact_label'
  WHEN doc_id % 17 = 0 THEN 'invalid_fact_box' WHEN doc_id % 19 = 0 THEN 'conflicting_fact_value' END AS reason FROM documents""")
def eligibility_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F01 over documents with faults by their ids."""
    i = F.col("doc_id")
    label = F.when(i % 13 == 0, " ").otherwise("a")
    box = F.when(i % 17 == 0, F.array(*[F.lit(float(x)) for x in (5, 5, 5, 9)])).otherwise(F.array(*[F.lit(float(x)) for x in (1, 1, 5, 9)]))
    one = F.array(F.struct(label.alias("label"), F.lit(1.0).alias("num"), F.lit(None).cast("string").alias("str"), box.alias("bbox")))
    own = F.when(i % 11 != 0, one)
    evidence = F.when(i % 5 == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(0)))
    split = F.when(i % 10 < 8, "train").otherwise("val")
    reason = facts.refusal_reason(split, F.when(i % 7 != 0, "x"), F.col("text"), evidence, i % 4 == 2, F.lit(False), own, i % 19 == 0)
    return table(spark, sf_dir, "documents").select("doc_id", reason.alias("reason"))


# --- JSON

@query("SELECT event_id, (props->>'$.k')::INT AS k FROM events")
def json_field_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "int").alias("k"))


@query("""SELECT event_id, '{"a":[1,null],"k":' || (props->>'$.k') || '}' AS json FROM events""")
def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys sorted, no blanks."""
    loose = F.concat(F.lit('{ "k" : '), F.get_json_object("props", "$.k"), F.lit(', "a": [1, null] }'))
    return table(spark, sf_dir, "events").select("event_id", json_tools.canonical_json(loose).alias("json"))


_GENERATION = '{"answerable": true, "facts": [{"id": "f1", "label": "a", "value": 3, "unit": null, "bbox": [1, 2, 3, 4]}], "evidence_refs": ["f1"], "plan": {"op": "lookup", "args": [{"ref": "f1"}]}, "model_answer": "3"}'


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model outputs with six kinds of fault, by event id."""
    form = F.col("event_id") % 6
    bad = F.lit(_GENERATION.replace('"evidence_refs": ["f1"]', '"evidence_refs": ["f2"]'))
    out = (
        F.when(form == 0, F.lit(_GENERATION)).when(form == 1, F.lit(f"Here it is:\n```json\n{_GENERATION}\n```")).when(form == 2, F.lit(_GENERATION[:-1] + ",}"))
        .when(form == 3, F.lit('{"answerable": true}')).when(form == 4, F.lit("no idea")).otherwise(bad)
    )
    return table(spark, sf_dir, "events").select("event_id", form.cast("int").alias("form"), out.alias("raw"))


@query("""SELECT event_id, event_id % 6 IN (0, 1, 2, 5) AS ok, CASE event_id % 6 WHEN 1 THEN 'stripped code fence' WHEN 2 THEN 'removed trailing comma' ELSE '' END AS repairs FROM events""")
def json_tolerant_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record from each generation, with what had to be repaired."""
    return generations(spark, sf_dir).select("event_id", json_tools.parse_record(F.col("raw")).alias("p")).select("event_id", "p.ok", F.array_join("p.repairs", ",").alias("repairs"))


@query("""SELECT event_id, CASE WHEN event_id % 6 IN (0, 1, 2) THEN '3' ELSE '' END AS answer, event_id % 6 IN (0, 1, 2) AS usable FROM events""")
def generation_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of valid records."""
    return generations(spark, sf_dir).select("event_id", json_tools.interpret(F.col("raw")).alias("p")).select("event_id", "p.answer", (F.col("p.reason") == "").alias("usable"))


@query("""SELECT event_id, ['plan', 'refused', 'needs_operator', 'needs_context', 'malformed'][(event_id % 5 + 1)::INT] AS outcome FROM events""")
def reply_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """teachers' replies of five kinds."""
    form = F.col("event_id") % 5
    reply = (
        F.when(form == 0, F.lit('Thinking…\n```json\n{"op": "lookup", "args": [{"ref": "f1"}]}\n```')).when(form == 1, F.lit('{"refused": "unclear"}'))
        .when(form == 2, F.lit('{"needs_operator": {"name": "mode"}}')).when(form == 3, F.lit('{"needs_context": {"kind": "axis", "why": "cut off"}}')).otherwise(F.lit('{"op": "sum", "refused": "x"}'))
    )
    return table(spark, sf_dir, "events").select("event_id", json_tools.parse_reply(reply)["outcome"].alias("outcome"))


@query("""
WITH e AS (SELECT event_id % 6 IN (0, 1, 2) AS usable FROM events)
SELECT count_if(usable)::BIGINT AS answers_with_plan, count_if(usable)::BIGINT AS plans_that_execute, count_if(usable)::BIGINT AS plans_reproducing_stated_answer, count_if(usable) / count(*) AS executed_plan_accuracy, count_if(usable) / count(*) AS plan_verified_accuracy FROM e""")
def plan_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A07 over the generations: how many plans there are, run and give what was said."""
    # generations that are the same text are read and run once
    rows = generations(spark, sf_dir).groupBy("raw").agg(F.count("*").alias("n")).withColumn("reason", json_tools.interpret(F.col("raw"))["reason"]).withColumn("record", F.try_parse_json(json_tools.parse_record(F.col("raw"))["json"]))
    listed = F.coalesce(F.try_variant_get("record", "$.facts", "array<variant>"), F.array().cast("array<variant>"))
    own = F.transform(listed, lambda f: F.struct(nodes.get(f, "id").alias("id"), nodes.get(f, "label").alias("label"), nodes.get(f, "value", "double").alias("num"), F.lit(None).cast("string").alias("str"), nodes.get(f, "unit").alias("unit")))
    rows = rows.withColumn("trip", verify.round_trip(F.try_variant_get("record", "$.plan", "variant"), own, F.try_variant_get("record", "$.model_answer", "string")))
    agrees = F.col("trip") == "agrees"
    return metrics.plan_statistics(rows, F.col("reason") == "", F.col("trip") != "no_plan", F.col("trip").isin("agrees", "disagrees"), agrees, agrees, agrees, F.col("n"))


# --- synthetic examples, targets, tables

@query("""SELECT level, 'agrees' AS trip, count(*) AS n FROM (SELECT ['L1', 'L2', 'L3', 'L4'][(i // 8 % 4 + 1)::INT] AS level FROM range((SELECT count(*) FROM customer)) r(i)) GROUP BY level""")
def synthetic_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many examples as customers, all accepted; their plans give the answer that printing their value states."""
    made = synthetic.generate(spark, table(spark, sf_dir, "customer").count())
    rows = made.where(F.col("status") == synthetic.ACCEPTED).withColumn("r", nodes.evaluate(nodes.read(F.col("plan")), F.col("facts"), 2))
    # printed with enough digits that the reader's tolerance is met
    answer = F.when(F.col("answer_number").isNotNull(), F.format_string("%.6f", "answer_number")).otherwise(F.col("answer_text"))
    trip = F.when(F.col("r.err").isNotNull(), "raises").when(numbers.result_matches_gold(F.col("r.num"), F.col("r.str"), answer), "agrees").otherwise("disagrees")
    return rows.groupBy("level", trip.alias("trip")).agg(F.count("*").alias("n"))


@query("""
WITH s AS (SELECT i, held, i % 8 AS kind, i // 8 % 4 AS level, i // 32 * 8 + i % 8 AS nth FROM range((SELECT count(*) FROM orders)) r(i), (VALUES (false), (true)) h(held))
SELECT i, held AS holdout, ['vbar', 'hbar', 'grouped_bar', 'line', 'multi_line', 'pie', 'scatter', 'area'][(kind + 1)::INT] AS chart_type, 'L' || (level + 1) AS level,
  CASE WHEN level = 1 THEN ['signed_difference', 'absolute_distance', 'ratio', 'winner', 'greater', 'less', 'equal'][(nth % 7 + 1)::INT] END AS form,
  CASE WHEN held THEN [7, 13, 23][(i % 3 + 1)::INT] ELSE [s FOR s IN range(60) IF s NOT IN (7, 13, 23)][(i % 57 + 1)::INT] END AS style,
  CASE WHEN held THEN 900000 + i % 50000 ELSE i % 900000 END AS data_seed FROM s""")
def synthetic_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types, levels, forms and styles of as many examples as orders, held out and not."""
    n = table(spark, sf_dir, "orders").count()
    return synthetic.schedule(spark, n).unionByName(synthetic.schedule(spark, n, holdout=True)).drop("seed")


@query(FACTS_SQL + "SELECT chart, 'ok' AS status, 5 AS n_facts FROM f")
def training_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record that a model should write for each chart's sum."""
    import json

    rows = chart_facts(spark, sf_dir)
    elements = F.transform("facts", lambda f, i: F.struct(f["label"].alias("label"), f["num"].alias("num"), f["str"].alias("str"), f["unit"].alias("unit"), F.array(i * 10.0, F.lit(1.0), i * 10.0 + 9, F.lit(1200.0)).alias("bbox")))
    sums = F.format_string("%.2f", F.aggregate("facts", F.lit(0.0), lambda a, f: a + f["num"]))
    made = targets.target(elements, F.array(F.lit(0)), F.parse_json(F.lit(json.dumps(op("sum", ALL)))), sums)
    return rows.select("chart", made.alias("t")).select("chart", "t.status", F.size(F.try_variant_get(F.parse_json("t.json"), "$.facts", "array<variant>")).alias("n_facts"))


@query("""
WITH v AS (SELECT n_regionkey AS record_id, c_mktsegment AS series, n_name AS label, count(*)::DOUBLE AS value FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT record_id, lower(series) AS series, label, value FROM v
UNION ALL SELECT record_id, NULL, label, arg_min(value, series) FROM v GROUP BY record_id, label""")
def table_value_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of a chart table by column and row label; a row's first number by its label alone."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    counts = rows.groupBy(F.col("n_regionkey").alias("record_id"), F.col("c_mktsegment").alias("series"), F.col("n_name").alias("label")).agg(F.count("*").alias("n"))
    names = counts.groupBy("record_id").agg(F.array_sort(F.collect_set("series")).alias("names"))
    cells = counts.groupBy("record_id", "label").agg(F.map_from_entries(F.collect_list(F.struct("series", F.col("n").cast("string")))).alias("cells")).join(names, "record_id")
    row = F.concat(F.array("label"), F.transform("names", lambda s: F.try_element_at(F.col("cells"), s)))
    made = cells.groupBy("record_id").agg(F.struct(F.concat(F.array(F.lit("nation")), F.first("names")).alias("columns"), F.array_sort(F.collect_list(row)).alias("rows")).alias("table"))
    return facts.table_values(made)


# --- streams

@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts by type, computed incrementally."""
    events = table(spark, sf_dir, "events")
    out, state = _folders(spark, "windows")
    rows = incremental.stream(spark, f"{sf_dir}/events.parquet", events.schema).groupBy(F.date_trunc("day", "ts").alias("day"), "event_type")
    counts = rows.agg(F.count("*").alias("n"))
    counts.writeStream.outputMode("complete").foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(out)).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_incremental_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First event of each user and type; a second run adds nothing."""
    events = table(spark, sf_dir, "events")
    out, state = _folders(spark, "dedup")
    for _ in range(2):
        rows = incremental.stream(spark, f"{sf_dir}/events.parquet", events.schema).dropDuplicates(["user_id", "event_type"]).select("user_id", "event_type")
        incremental.run_once(rows, out, state)
    return spark.read.parquet(out)


def _folders(spark: SparkSession, name: str) -> tuple[str, str]:
    """New output and state folders where the cluster shares files."""
    run = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    return f"{run}/out", f"{run}/state"

