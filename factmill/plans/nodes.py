"""Plans that differ from row to row: JSON, read as VARIANT and evaluated in place.

A plan is at most four operators deep; its nodes are listed level by level and
folded from the deepest one up.  No row leaves its place, and no shuffle is
needed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import specs
from .evaluate import VALUE, apply, fact_value, let, value
from .specs import spec_of


def read(plan_json: Column) -> Column:
    """The plan as VARIANT, null if the text isn't one JSON value."""
    return F.try_parse_json(plan_json)


def get(node: Column, field: str, kind: str = "string") -> Column:
    return F.try_variant_get(node, f"$.{field}", kind)


def operands(node: Column) -> Column:
    return get(node, "args", "array<variant>")


def keys(node: Column) -> Column:
    """The fields of an object, null for anything else."""
    return F.map_keys(node.try_cast("map<string,variant>"))


def kind(node: Column) -> Column:
    return F.schema_of_variant(node)


def is_ref(node: Column) -> Column:
    return F.coalesce((kind(node) == "OBJECT<ref: STRING>"), F.lit(False))


def fact_of(ref: Column, facts: Column) -> Column:
    """The one fact with an id; unknown and repeated ids are errors."""
    own = F.filter(facts, lambda f: f["id"] == ref)
    return F.when(F.size(own) == 1, fact_value(F.get(own, 0))).otherwise(value(err="unknown fact"))


def fact_named(label: Column, facts: Column) -> Column:
    """The one fact with a label; labels of none or of several facts are errors."""
    own = F.filter(facts, lambda f: f["label"] == label)
    return F.when(F.size(own) == 1, fact_value(F.get(own, 0))).otherwise(value(err="not exactly one fact"))


def evaluate(plan: Column, facts: Column, depth: int = specs.MAX_DEPTH, by_label: bool = False) -> Column:
    """The value of a VARIANT plan over the row's ``facts``; malformed parts are errors.

    ``by_label`` (K10, V03) lets operands be labels, and folds without
    operands take all facts.
    """
    return let(F.struct(plan.alias("plan"), facts.alias("facts")), lambda s: evaluate_in_place(s["plan"], s["facts"], depth, by_label))


def placed_nodes(plan: Column, depth: int = specs.MAX_DEPTH) -> Column:
    """All operator nodes with their paths (``""``, ``.0``, ``.0.1`` …), the deepest level first."""
    none = F.array().cast("array<variant>")
    path = lambda above, i: F.concat(above, F.lit("."), i.cast("string"))
    below = lambda n: F.transform(F.coalesce(operands(n["node"]), none), lambda a, i: F.struct(path(n["path"], i).alias("path"), a.alias("node")))
    is_operator = lambda n: get(n["node"], "op").isNotNull()
    root = F.filter(F.array(F.struct(F.lit("").alias("path"), plan.alias("node"))), is_operator)
    return _levels(root, lambda level: F.filter(F.flatten(F.transform(level, below)), is_operator), depth, lambda found, level: F.concat(level, found))


def _levels(root: Column, below: Callable[[Column], Column], depth: int, joined: Callable[[Column, Column], Column]) -> Column:
    """``depth`` levels, from ``root`` down, put together by ``joined``; the step from one to the next stands once, whatever the depth."""
    start = F.struct(root.alias("level"), F.filter(root, lambda n: F.lit(False)).alias("found"))
    step = lambda s, _: F.struct(below(s["level"]).alias("level"), joined(s["found"], s["level"]).alias("found"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), start, step, lambda s: s["found"])


def evaluate_in_place(plan: Column, facts: Column, depth: int, by_label: bool = False) -> Column:
    """The same where plan and facts are cheap to name often.

    Nodes are folded from the deepest level up; each finds its operands'
    values by their paths.  An operator's expression stands once in the
    plan, however deep plans are.
    """
    none = F.array().cast("array<variant>")

    def step(known: Column, n: Column) -> Column:
        node, path = n["node"], n["path"]

        def operand(a: Column, i: Column) -> Column:
            nested = F.get(F.filter(known, lambda k: k["path"] == F.concat(path, F.lit("."), i.cast("string"))), 0)["value"]
            found = F.when(is_ref(a), fact_of(get(a, "ref"), facts))
            if by_label:
                found = found.when(kind(a) == "STRING", fact_named(a.try_cast("string"), facts))
            return found.otherwise(F.coalesce(nested, value(err="not an operation, or too deep")))

        args = F.transform(F.coalesce(operands(node), none), operand)
        if by_label:
            implicit = get(node, "op").isin(*specs.FOLDS) & (F.size(operands(node)) == 0)
            args = F.when(implicit, F.transform(facts, fact_value)).otherwise(args)
        result = apply(get(node, "op"), args, get(node, "position", "int"), get(node, "order"), get(node, "compare"), get(node, "threshold", "double"))
        return F.array_append(known, F.struct(path.alias("path"), result.alias("value")))

    start = F.array().cast(f"array<struct<path:string,value:{VALUE}>>")
    # the root comes last
    return F.aggregate(placed_nodes(plan, depth), start, step, lambda known: F.coalesce(F.get(known, F.size(known) - 1)["value"], value(err="unknown operator")))


def nodes(plan: Column, depth: int = specs.MAX_DEPTH) -> Column:
    """All operator nodes, root first, as an array of VARIANT."""
    return _levels(_operators(F.array(plan)), _operators_below, depth, F.concat)


def _operators(level: Column) -> Column:
    return F.filter(level, lambda n: get(n, "op").isNotNull())


def _operators_below(level: Column) -> Column:
    none = F.array().cast("array<variant>")
    return _operators(F.flatten(F.transform(level, lambda n: F.coalesce(operands(n), none))))


def cited(plan: Column, depth: int = specs.MAX_DEPTH) -> Column:
    """Ids of cited facts, level by level, repeats included."""
    none = F.array().cast("array<variant>")
    args = F.flatten(F.transform(nodes(plan, depth), lambda n: F.coalesce(operands(n), none)))
    return F.transform(F.filter(args, is_ref), lambda a: get(a, "ref"))


def depth_of(plan: Column, most: int = specs.MAX_DEPTH + 1) -> Column:
    """Operators above each other, counted up to one too many."""
    start = F.struct(_operators(F.array(plan)).alias("level"), F.lit(0).alias("n"))
    step = lambda s, _: F.struct(_operators_below(s["level"]).alias("level"), (s["n"] + F.when(F.size(s["level"]) > 0, 1).otherwise(0)).alias("n"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step, lambda s: s["n"])


def thresholds(plan: Column) -> Column:
    """The thresholds of all nodes."""
    return F.filter(F.transform(nodes(plan), lambda n: get(n, "threshold", "double")), lambda x: x.isNotNull())


def _node_errors(node: Column, max_facts: int) -> Column:
    """V02 for one node, without what stands below its operands."""
    parts = F.struct(node.alias("node"), get(node, "op").alias("op"), operands(node).alias("args"), keys(node).alias("keys"), spec_of(get(node, "op")).alias("spec"))
    return let(parts, lambda x: _errors_by_spec(x["node"], x["op"], x["args"], x["keys"], x["spec"], max_facts))


def _errors_by_spec(node: Column, op: Column, args: Column, keys: Column, spec: Column, max_facts: int) -> Column:
    fields, takes = spec["fields"], spec["takes"]
    inner = F.transform(args, lambda a: F.struct(is_ref(a).alias("ref"), get(a, "op").alias("op"), (kind(a).startswith("OBJECT")).alias("object")))
    position, threshold = get(node, "position", "int"), get(node, "threshold", "double")
    wrong = lambda test, text: F.when(F.coalesce(test, F.lit(True)), F.lit(text))
    number = kind(F.try_variant_get(node, "$.threshold", "variant"))
    whole = kind(F.try_variant_get(node, "$.position", "variant"))
    # an unknown operator is its own node's fault
    not_a_number = lambda inner_op: F.when(inner_op.isNotNull(), F.coalesce(~spec_of(inner_op)["gives"].isin("number", "scalar"), F.lit(False)))
    misfit = lambda a: ~a["ref"] & (~F.coalesce(a["object"], F.lit(False)) | (takes == "facts") | ((takes == "numbers") & not_a_number(a["op"])) | ((takes == "label") & ~F.coalesce(a["op"].isin(*specs.LABELS), F.lit(False))))
    found = F.array(
        wrong(spec.isNull(), "unknown operation"),
        wrong((F.size(F.array_except(keys, fields)) > 0) | (F.size(F.array_except(fields, keys)) > 0), "fields"),
        wrong((F.size(args) < spec["least"]) | (F.size(args) > F.coalesce(spec["most"], F.lit(max_facts))), "operands"),
        wrong(F.exists(inner, misfit), "operand types"),
        F.when(op.isin("rank", "rank_value"), wrong((whole != "BIGINT") | (position < 1) | (position > F.size(args)) | ~get(node, "order").isin(*specs.ORDERS), "position or order")),
        F.when(op.isin(*specs.THRESHOLDED), wrong(threshold.isNull() | number.isin("STRING", "BOOLEAN") | ~get(node, "compare").isin(*specs.COMPARISONS), "compare or threshold")),
    )
    return F.array_compact(found)


def shape_errors(plan: Column, max_facts: int = specs.MAX_FACTS) -> Column:
    """What is wrong with the plan's nodes; empty if it is well formed."""
    return let(plan, lambda p: _shape_errors(p, max_facts))


def _shape_errors(plan: Column, max_facts: int) -> Column:
    below = let(nodes(plan), lambda all_: F.flatten(F.transform(all_, lambda n: _node_errors(n, max_facts))))
    root = F.coalesce(kind(plan).startswith("OBJECT"), F.lit(False)) & get(plan, "op").isNotNull() & ~kind(F.try_variant_get(plan, "$.op", "variant")).isin("BIGINT", "BOOLEAN")
    deep = F.when(depth_of(plan) > specs.MAX_DEPTH, F.lit("too deep"))
    return F.when(~F.coalesce(root, F.lit(False)), F.array(F.lit("not an operation"))).otherwise(F.array_compact(F.array_append(below, deep)))


def is_compositional(plan: Column) -> Column:
    """more than one lookup: another operator, or a nested one."""
    nested = F.exists(F.coalesce(operands(plan), F.array().cast("array<variant>")), lambda a: get(a, "op").isNotNull())
    return F.coalesce((get(plan, "op") != "lookup") | nested, F.lit(False))
