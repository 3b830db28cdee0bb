"""A plan that is the same for all rows, checked once and folded into one Column."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import specs
from .evaluate import apply, fact_value, value
from .specs import SPECS


class PlanError(ValueError):
    """A plan that isn't well formed."""


def is_ref(node: Any) -> bool:
    return isinstance(node, dict) and set(node) == {"ref"} and isinstance(node["ref"], str)


def depth(node: Any) -> int:
    """How many operators stand above each other."""
    return 0 if not isinstance(node, dict) or is_ref(node) else 1 + max((depth(a) for a in node.get("args") or []), default=0)


def refs(node: Any) -> list[str]:
    """Cited facts in the order of reading, repeats included."""
    if is_ref(node):
        return [node["ref"]]
    return [r for a in (node.get("args") or [] if isinstance(node, dict) else []) for r in refs(a)]


def shape_errors(node: Any, max_facts: int = specs.MAX_FACTS, at: str = "plan") -> list[str]:
    """Everything that is wrong with a plan's form and types."""
    if not isinstance(node, dict) or is_ref(node) or not isinstance(node.get("op"), str):
        return [f"{at}: not an operation"]
    op, args = node["op"], node.get("args")
    if op not in SPECS:
        return [f"{at}: unknown operation {op}"]
    spec, found = SPECS[op], []
    fields = {"op", "args", *spec.extra}
    if set(node) != fields:
        found.append(f"{at}: fields {sorted(set(node) ^ fields)} are unknown or missing")
    if not isinstance(args, list):
        return [*found, f"{at}: args isn't a list"]
    if not spec.least <= len(args) <= (max_facts if spec.most is None else spec.most):
        found.append(f"{at}: {len(args)} operands")
    for i, arg in enumerate(args):
        if is_ref(arg):
            continue
        if not isinstance(arg, dict) or spec.takes == "facts":
            found.append(f"{at}.{i}: not a fact")
            continue
        found += shape_errors(arg, max_facts, f"{at}.{i}")
        inner = arg.get("op")
        if inner in SPECS and inner not in {"numbers": specs.NUMERIC, "label": specs.LABELS}.get(spec.takes, ()):
            found.append(f"{at}.{i}: {inner} gives no {spec.takes}")
    if "position" in spec.extra:
        p = node.get("position")
        if not isinstance(p, int) or isinstance(p, bool) or not 1 <= p <= len(args):
            found.append(f"{at}: position")
        if node.get("order") not in specs.ORDERS:
            found.append(f"{at}: order")
    if "threshold" in spec.extra:
        t = node.get("threshold")
        if node.get("compare") not in specs.COMPARISONS:
            found.append(f"{at}: compare")
        if not isinstance(t, int | float) or isinstance(t, bool) or not math.isfinite(t):
            found.append(f"{at}: threshold")
    if at == "plan" and depth(node) > specs.MAX_DEPTH:
        found.append(f"{at}: deeper than {specs.MAX_DEPTH}")
    return found


def compile_plan(plan: dict, facts: Column, max_facts: int = specs.MAX_FACTS) -> Column:
    """The plan's value (``label, num, str, unit, err``) over ``facts``.

    ``facts`` is ``array<struct<id, label, num, str, unit>>`` with distinct
    ids.  A fact that a row lacks is that row's error.
    """
    if errors := shape_errors(plan, max_facts):
        raise PlanError("; ".join(errors))

    def fold(node: dict) -> Column:
        if is_ref(node):
            own = F.filter(facts, lambda f: f["id"] == node["ref"])
            return F.when(F.size(own) == 1, fact_value(F.get(own, 0))).otherwise(value(err="unknown fact"))
        operands = F.array(*[fold(a) for a in node["args"]]) if node["args"] else F.array(value(err="none"))
        extras = {k: F.lit(node[k]) for k in ("position", "order", "compare", "threshold") if k in node}
        if node["op"] == "unanswerable":
            return value(unit=F.lit(""))
        return apply(node["op"], operands, **extras)

    return fold(plan)


def bind_labels(plan: Any, labels: list[tuple[str, str]], strict: bool = False) -> dict:
    """Operands that are labels become references; a fold without operands takes all facts.

    ``labels`` lists each fact's id and label.  A label must name exactly one
    fact.  ``strict`` keeps ``position`` and ``order`` of ``rank`` only.
    """
    if isinstance(plan, dict) and not shape_errors(plan):
        if unknown := set(refs(plan)) - {i for i, _ in labels}:
            raise PlanError(f"unknown facts {sorted(unknown)}")
        return plan
    if isinstance(plan, str):
        own = [i for i, label in labels if label == plan]
        if len(own) != 1:
            raise PlanError(f"{plan!r} names {len(own)} facts")
        return {"ref": own[0]}
    if not isinstance(plan, dict) or plan.get("op") not in SPECS or not isinstance(plan.get("args"), list):
        raise PlanError(f"{plan!r} can't be bound")
    op, args = plan["op"], plan["args"]
    if not args and op in specs.FOLDS:
        args = [label for _, label in labels]
    bound = {"op": op, "args": [bind_labels(a, labels, strict) for a in args]}
    kept = ("position", "order") if op == "rank" else () if strict else SPECS[op].extra
    return bound | {k: plan[k] for k in kept if k in plan}
