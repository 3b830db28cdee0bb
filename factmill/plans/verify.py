"""Verdicts on plans: does one hold against its question, its facts and its answer?"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.numbers import answers_agree, question_numbers, result_matches_gold
from . import nodes, specs
from .evaluate import let

#: Statuses in the order of their tests; the first that applies is the verdict.  Fixed values.
ACCEPTED = "accepted"
VACUOUS = "rejected:vacuous_single_item_fold"
MALFORMED = "rejected:malformed_plan"
UNKNOWN_OP = "rejected:unknown_operation"
TOO_DEEP = "rejected:too_deep"
TOO_MANY = "rejected:too_many_arguments"
UNGROUNDED = "rejected:threshold_not_stated_in_the_question"
MISSING_MARKINGS = "rejected:missing_marked_fact_ids"
TOO_MUCH_EVIDENCE = "rejected:needs_more_evidence_than_the_schema_allows"
UNKNOWN_FACT = "rejected:operand_not_in_evidence"
REFUSED = "rejected:executor_refused"
WRONG_ANSWER = "rejected:does_not_reproduce_the_answer"
NOT_COVERING = "rejected:does_not_cover_the_marked_regions"


def verdict(plan: Column, facts: Column, answer: Column, question: Column, marked: Column | None = None, marking_required: Column | None = None) -> Column:
    """The status of a VARIANT plan, and its result.

    ``facts`` is ``array<struct<id, label, num, str, unit>>``; ``marked`` the
    ids that a question marks (null: nothing is known).
    """
    return let(F.struct(plan.alias("plan"), facts.alias("facts")), lambda s: _verdict(s["plan"], s["facts"], answer, question, marked, marking_required))


def _verdict(plan: Column, facts: Column, answer: Column, question: Column, marked: Column | None, marking_required: Column | None) -> Column:
    marked = F.lit(None).cast("array<string>") if marked is None else marked
    required = F.lit(False) if marking_required is None else marking_required
    op, args = nodes.get(plan, "op"), nodes.operands(plan)
    of_objects = F.forall(args, lambda a: nodes.kind(a).startswith("OBJECT"))
    object_ = F.coalesce(nodes.kind(plan).startswith("OBJECT") & op.isNotNull(), F.lit(False))
    used = F.array_distinct(nodes.cited(plan))
    stated = F.coalesce(question_numbers(question), F.array().cast("array<double>"))
    every_op = F.transform(nodes.nodes(plan), lambda n: nodes.get(n, "op"))

    def judged(result: Column) -> Column:
        agrees = result_matches_gold(result["num"], result["str"], answer)
        status = (
            F.when(object_ & op.isin(*specs.FOLDS) & (F.size(args) < 2) & of_objects, VACUOUS)
            .when(~object_, MALFORMED)
            .when(F.exists(every_op, lambda o: specs.spec_of(o).isNull()), UNKNOWN_OP)
            .when(nodes.depth_of(plan) > specs.MAX_DEPTH, TOO_DEEP)
            .when(F.size(args) > specs.MAX_FACTS, TOO_MANY)
            .when(F.size(nodes.shape_errors(plan)) > 0, MALFORMED)
            .when(F.size(F.array_except(nodes.thresholds(plan), stated)) > 0, UNGROUNDED)
            .when(required & marked.isNull(), MISSING_MARKINGS)
            .when(F.size(used) > specs.MAX_FACTS, TOO_MUCH_EVIDENCE)
            .when(F.size(F.array_except(used, F.transform(facts, lambda f: f["id"]))) > 0, UNKNOWN_FACT)
            .when(result["err"].isNotNull(), REFUSED)
            .when(~agrees, WRONG_ANSWER)
            .when(marked.isNotNull() & (((F.size(marked) == 0) & (F.size(used) > 0)) | (F.size(F.array_except(marked, used)) > 0)), NOT_COVERING)
            .otherwise(ACCEPTED)
        )
        return F.struct(status.alias("status"), result["num"].alias("num"), result["str"].alias("str"), result["unit"].alias("unit"))

    return let(nodes.evaluate_in_place(plan, facts, specs.MAX_DEPTH), judged)


def round_trip(plan: Column, facts: Column, answer: Column, strict: bool = True, max_facts: int = specs.MAX_FACTS) -> Column:
    """``no_plan``, ``raises``, ``agrees`` or ``disagrees``; strict means at the gold text's precision."""

    def judged(result: Column) -> Column:
        agree = result_matches_gold(result["num"], result["str"], answer)
        if not strict:
            agree = F.when(result["num"].isNotNull(), answers_agree(result["num"].cast("string"), answer)).otherwise(agree)
        raises = (F.size(nodes.shape_errors(plan, max_facts)) > 0) | result["err"].isNotNull()
        return F.when(plan.isNull(), "no_plan").when(raises, "raises").when(agree, "agrees").otherwise("disagrees")

    return let(nodes.evaluate(plan, facts), judged)


def reply_outcome(reply: Column, status: Column) -> Column:
    """What a teacher's reply amounts to; ``status`` is the verdict on the plan it holds.

    ``reply`` is ``struct<outcome, plan, note>`` of ``functions.json_tools.parse_reply``, or null.
    """
    outcome = reply["outcome"]
    return (
        F.when(reply.isNull(), "missing_response").when(outcome == "needs_operator", "needs_operator").when(outcome == "needs_context", "needs_context")
        .when(outcome == "refused", "teacher_refused").when(outcome != "plan", "malformed_response").otherwise(status)
    )
