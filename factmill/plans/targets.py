"""Training targets: the record that a model should write, or why there is none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.geometry import clamp_box
from ..plans import nodes, specs
from .evaluate import let
from .verify import round_trip


def selected_positions(elements: Column, evidence: Column, plan: Column) -> Column:
    """Positions of facts that a target shows: marked ones and the plan's, all if a fold lists none."""
    everything = F.sequence(F.lit(0), F.size(elements) - 1)
    implicit = F.exists(nodes.nodes(plan), lambda n: nodes.get(n, "op").isin(*specs.FOLDS) & (F.size(nodes.operands(n)) == 0))
    used = F.transform(nodes.cited(plan), lambda r: F.substring(r, 2, 9).try_cast("int") - 1)
    marked = F.coalesce(evidence, F.array().cast("array<int>"))
    return F.when(F.coalesce(implicit, F.lit(False)), everything).otherwise(F.array_sort(F.array_union(marked, F.coalesce(used, F.array().cast("array<int>")))))


def target(elements: Column, evidence: Column, plan: Column, answer: Column, kind: str = "joint") -> Column:
    """``struct<status, json>``; ``kind`` is joint, grounding or stage1.

    ``elements`` is ``array<struct<label, num, str, unit, bbox>>`` with their
    qualified labels.  A joint target needs answer and plan and must give its
    answer when executed; a grounding target needs evidence and has no plan;
    a stage-1 target is a joint one if there is a plan, else a grounding one.
    """
    has_plan = plan.isNotNull()
    with_plan = {"joint": F.lit(True), "grounding": F.lit(False), "stage1": has_plan}[kind]
    shown = F.when(with_plan, plan)
    none = F.array().cast("array<int>")
    fact_id = lambda i: F.concat(F.lit("f"), (i + 1).cast("string"))

    def fact(i: Column) -> Column:
        e = F.get(elements, i)
        # a number, a text or null, whatever the fact holds
        held = F.when(e["num"].isNotNull(), F.to_json(F.array(e["num"]))).when(e["str"].isNotNull(), F.to_json(F.array(e["str"]))).otherwise(F.lit("[null]"))
        value = F.try_variant_get(F.parse_json(held), "$[0]", "variant")
        return F.struct(fact_id(i).alias("id"), e["label"].alias("label"), value.alias("value"), e["unit"].alias("unit"), clamp_box(e["bbox"]).alias("bbox"))

    # ids are positions, so that the plan runs over all facts as over the selected ones
    everything = F.transform(elements, lambda e, i: F.struct(fact_id(i).alias("id"), e["label"].alias("label"), e["num"].alias("num"), e["str"].alias("str"), e["unit"].alias("unit")))

    def judged(places: Column, trip: Column) -> Column:
        labels = F.transform(elements, lambda e: e["label"])
        status = (
            F.when(F.coalesce(F.size(elements), F.lit(0)) <= 0, "no_elements").when(F.size(F.array_distinct(labels)) < F.size(labels), "ambiguous_names")
            .when(with_plan & (answer.isNull() | ~has_plan), "missing_answer_or_plan").when(~with_plan & (F.coalesce(F.size(evidence), F.lit(0)) <= 0), "missing_evidence")
            .when((F.size(places) < 1) | (F.size(places) > specs.MAX_FACTS), "fact_count").when(F.exists(places, lambda i: (i < 0) | (i >= F.size(elements))), "unknown_fact")
            .when(with_plan & (trip != "agrees"), F.concat(F.lit("round_trip_"), trip)).otherwise("ok")
        )
        refs = F.transform(F.coalesce(evidence, none), fact_id)
        body = F.struct(F.lit(True).alias("answerable"), F.transform(places, fact).alias("facts"), refs.alias("evidence_refs"), shown.alias("plan"), F.coalesce(answer, F.lit("")).alias("model_answer"))
        return let(status, lambda s: F.struct(s.alias("status"), F.when(s == "ok", F.to_json(body, {"ignoreNullFields": "false"})).alias("json")))

    found = F.struct(selected_positions(elements, evidence, shown).alias("places"), F.when(with_plan, round_trip(shown, everything, answer)).alias("trip"))
    return let(found, lambda x: judged(x["places"], x["trip"]))
