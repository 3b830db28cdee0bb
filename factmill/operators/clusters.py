"""A03 for keys with very many records: the fold of their elements, cluster by cluster.

Elements only ever merge where their boxes are within the slack of each other
(or, without boxes, are equal), and a merged element keeps one of its members'
boxes.  So clusters of boxes that no chain of such neighbours connects don't
touch each other in the fold.  A cluster whose boxes are all within the slack,
whose elements don't contradict each other and which either all or none of the
records mark, comes out the same in any order: it is an aggregate.  Only the
others are folded record by record, each by itself.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, drop
from .elements import CORE, PROVENANCE, Conflict, _ordered, _reading_order, _text, merge_two
from .keyed import broadcast_if_small, numbered

#: Within this much of each other in every coordinate, boxes are one place.
SLACK = 1.0
_SIDES = ("x1", "y1", "x2", "y2")
#: Fields whose merging doesn't hang on an order; the box comes first among them in canonical text.
_FIELDS = ("bbox", *CORE, *PROVENANCE)
_GROUP = ["split", "_key"]


def _said(field: str) -> str:
    return f"said_{field}"


def explode_elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each element: its canonical text, its box, what it says of each field, whether it is marked."""
    schema = pa.schema(
        [("split", pa.string()), ("_key", pa.string()), ("step", pa.int64()), ("known", pa.int64()), ("place", pa.int32()), ("body", pa.string()), ("text", pa.string()), ("marked", pa.bool_()), ("named", pa.string())]
        + [(s, pa.float64()) for s in _SIDES] + [("box", pa.string()), ("plain", pa.bool_()), ("has", pa.int32())] + [(_said(f), pa.string()) for f in CORE]
        + [(_said(f), pa.struct([("rank", pa.int32()), ("text", pa.string())])) for f in PROVENANCE]
    )
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            made = []
            for row in batch.slice(at, 1024).to_pylist():
                marks = set(row["evidence"] or ())
                for i, e in enumerate(json.loads(row["elements"] or "[]")):
                    text, box = _text(e), e.get("bbox")
                    out = {k: row[k] for k in ("split", "_key", "step", "known")} | {"place": i, "body": json.dumps(e, ensure_ascii=False), "text": text, "marked": i in marks}
                    out |= dict(zip(_SIDES, map(float, box), strict=True)) | {"box": _text(box)} if box is not None else {"named": hashlib.sha256(text.encode()).hexdigest()}
                    out["plain"], out["has"] = all(f in _FIELDS for f in e), sum(1 << _FIELDS.index(f) for f in e if f in _FIELDS)
                    out |= {_said(f): _text(e[f]) for f in CORE if e.get(f) is not None}
                    for f, order in PROVENANCE.items():
                        if e.get(f) is not None:
                            out[_said(f)] = {"rank": order.index(e[f]) if e[f] in order else len(order), "text": e[f]}
                    made.append(out)
            yield pa.RecordBatch.from_pylist(made, schema=schema)


def _columns() -> str:
    sides = ", ".join(f"{s} double" for s in _SIDES)
    said = ", ".join([f"{_said(f)} string" for f in CORE] + [f"{_said(f)} struct<rank:int,text:string>" for f in PROVENANCE])
    return f"split string, _key string, step bigint, known bigint, place int, body string, text string, marked boolean, named string, {sides}, box string, plain boolean, has int, {said}"


def _joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Rows joined by columns of one name that may be null, kept once."""
    other = right.select(*[F.col(c).alias(f"_on_{c}") if c in on else F.col(c) for c in right.columns])
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_on_{c}"))
    return left.join(other, same, how).drop(*[f"_on_{c}" for c in on])


def _cell(side: str) -> Column:
    return F.floor(F.col(side) / F.lit(SLACK)).cast("long")


def with_clusters(rows: DataFrame) -> DataFrame:
    """``rows`` with ``cluster``: boxes of different ones are never within the slack of each other, nor connected by others that are.

    Side by side, a sweep over the cells that a cluster's boxes lie in cuts it
    where a cell is empty.  A sweep sees each cell once: on a canvas of a
    thousand, a thousand and one.
    """
    cells = [f"_c{i}" for i in range(4)]
    placed = rows.where("named IS NULL").withColumns({c: _cell(s) for c, s in zip(cells, _SIDES, strict=True)})
    found = cut(placed.select(*_GROUP, *cells).distinct().withColumn("cluster", F.lit("")))
    for c in cells:
        own = [*_GROUP, "cluster"]
        order = Window.partitionBy(*own).orderBy(c)
        gap = F.coalesce(F.col(c) - F.lag(c).over(order) > 1, F.lit(False)).cast("int")
        swept = found.select(*own, c).distinct().withColumn("_gap", gap).withColumn("_nth", F.sum("_gap").over(order)).drop("_gap")
        before = found
        named = F.concat_ws(".", "cluster", F.col("_nth").cast("string"))
        found = cut(_joined(found, swept, [*own, c]).withColumn("cluster", named).drop("_nth"))
        drop(before)
    boxed = _joined(placed, found, [*_GROUP, *cells]).drop(*cells)
    return boxed.unionByName(rows.where("named IS NOT NULL").withColumn("cluster", F.col("named")))


def _one(row: dict) -> str:
    """The element of a cluster that comes out the same in any order."""
    if row["named"] is not None:
        return row["text"]
    out = {}
    for i, f in enumerate(_FIELDS):
        if row["has"] >> i & 1:
            said = row["box"] if f == "bbox" else row[_said(f)]
            out[f] = None if said is None else said["text"] if f in PROVENANCE else json.loads(said)
    return _text(out)


def fold_cluster(records: Iterable[tuple[int, int | None, list[dict], list[int]]], n: int, n_known: int) -> tuple[list[dict], list[int], list[tuple]]:
    """Elements of one cluster, those that are marked, and conflicts ``(step, known, kind, text, reason)``.

    ``records`` are those of the group's ``n`` that have elements in the
    cluster: their place in the fold, their number among the ``n_known`` that
    mark evidence (None: doesn't), their elements and marked places.  Records
    without elements here still make the fold look at what there is once more.
    """
    left: list[dict] = []
    running: list[int] | None = None
    at, next_known, absent, conflicts = -1, 0, None, []

    def merged(step: int, right: list[dict], two: list[int] | None) -> bool:
        nonlocal left, running
        try:
            left, running = merge_two(left, right, (running, two))
        except Conflict as e:
            conflicts.append((step, None, int(str(e) == "evidence"), e.place, str(e)))
        return not conflicts

    def settled(until: int) -> bool:
        """Merge with nothing for each record from the last one on, while that changes anything."""
        for step in range(max(at + 1, 1), until):
            before, marks = _ordered(left), running
            if not merged(step, [], None):
                return False
            if _ordered(left) == before and running == marks:
                break
        return True

    for step, known, elements, marks in records:
        if at >= 0 and not settled(step):
            return left, [], conflicts
        two = None
        if known is not None:
            if known > next_known:
                if running is None:
                    running = []  # the first one that marks anything marks nothing here
                elif running and absent is None:
                    absent = next_known
            next_known = known + 1
            two = None if absent is not None else marks
        if step == 0:
            left, running = elements, two
        elif not merged(step, elements, two):
            break
        at = step
    if not conflicts and settled(n) and running and next_known < n_known and absent is None:
        absent = next_known
    if absent is not None:
        conflicts.append((None, absent, 1, "", "evidence"))
    return left, running or [], conflicts


_FOLDED = "split string, _key string, text string, marked boolean, step bigint, known bigint, kind int, first string, reason string"


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folds clusters whose elements come in the order of their records, as a stream."""
    schema = pa.schema([("split", pa.string()), ("_key", pa.string()), ("text", pa.string()), ("marked", pa.bool_()), ("step", pa.int64()), ("known", pa.int64()), ("kind", pa.int32()), ("first", pa.string()), ("reason", pa.string())])
    rows = (row for batch in batches for at in range(0, batch.num_rows, 1024) for row in batch.slice(at, 1024).to_pylist())
    for (split, key, _), own in groupby(rows, itemgetter("split", "_key", "cluster")):
        first = next(own)

        def records(first: dict = first, own: Iterator[dict] = own) -> Iterator[tuple]:
            for (step, known), parts in groupby((r for part in ([first], own) for r in part), itemgetter("step", "known")):
                listed = list(parts)
                yield step, known, [json.loads(r["body"]) for r in listed], [i for i, r in enumerate(listed) if r["marked"]]

        left, marked, conflicts = fold_cluster(records(), first["n"], first["n_known"])
        group = {"split": split, "_key": key}
        made = [group | {"text": json.dumps(e, ensure_ascii=False), "marked": i in set(marked)} for i, e in enumerate(left)]
        if conflicts:
            made = [group | dict(zip(("step", "known", "kind", "first", "reason"), c, strict=True)) for c in conflicts]
        yield pa.RecordBatch.from_pylist(made, schema=schema)


def merge_by_clusters(records: DataFrame) -> DataFrame:
    """Merged elements of groups: ``split, _key, elements, evidence, conflict``.

    ``records``: ``split, _key, rank, record_id, row, elements, evidence``,
    two at least of each group.  The result's row is one group's elements, as
    many as there are places.
    """
    order = F.struct(*_GROUP, "rank", F.col("record_id").isNull(), "record_id", F.col("row").isNull(), "row")
    placed = cut(numbered(records.withColumn("_order", order), "_order").drop("_order"))
    known = cut(numbered(placed.where("evidence IS NOT NULL").select(*_GROUP, F.col("_place").alias("_at")), "_at"))
    firsts = placed.groupBy(*_GROUP).agg(F.min("_place").alias("_first"), F.count("*").alias("n"))
    marks = known.groupBy(*_GROUP).agg(F.min("_place").alias("_first_known"), F.count("*").alias("n_known"))
    groups = cut(_joined(firsts, marks, _GROUP, "left").withColumn("n_known", F.coalesce("n_known", F.lit(0))))
    sizes = broadcast_if_small(groups, 256)
    own = known.select(F.col("_at").alias("_place"), F.col("_place").alias("_nth"))
    steps = _joined(placed.join(own, "_place", "left"), sizes, _GROUP)
    steps = steps.select(*_GROUP, (F.col("_place") - F.col("_first")).alias("step"), (F.col("_nth") - F.col("_first_known")).alias("known"), "elements", "evidence")
    rows = cut(with_clusters(cut(steps.mapInArrow(explode_elements, _columns()))))
    # what a cluster comes to in any order
    cluster = [*_GROUP, "cluster"]
    said = [F.min(_said(f)).alias(_said(f)) for f in (*CORE, *PROVENANCE)]
    differ = F.lit(False)
    for f in CORE:
        differ = differ | (F.min(_said(f)) < F.max(_said(f)))
    wide = F.lit(False)
    for s in _SIDES:
        wide = wide | (F.max(s) - F.min(s) > SLACK)
    stats = rows.groupBy(*cluster).agg(F.first("named").alias("named"), F.first("text").alias("text"), F.min("box").alias("box"), F.bit_or("has").alias("has"), *said, (F.coalesce(differ, F.lit(False)) | F.coalesce(wide, F.lit(False)) | (F.first("named").isNull() & ~F.bool_and("plain"))).alias("odd"))
    counts = rows.where("marked").select(*cluster, "step").distinct().groupBy(*cluster).agg(F.count("*").alias("n_marked"))
    stats = _joined(stats, counts, cluster, "left").withColumn("n_marked", F.coalesce("n_marked", F.lit(0)))
    stats = _joined(stats, sizes.select(*_GROUP, "n", "n_known"), _GROUP)
    stats = cut(stats.withColumn("odd", F.col("odd") | ~F.col("n_marked").isin(0) & (F.col("n_marked") != F.col("n_known"))))

    def ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [{"split": r["split"], "_key": r["_key"], "text": _one(r), "marked": r["n_marked"] > 0} for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(made, schema=pa.schema([("split", pa.string()), ("_key", pa.string()), ("text", pa.string()), ("marked", pa.bool_())]))

    free = stats.where("NOT odd").mapInArrow(ones, "split string, _key string, text string, marked boolean")
    bound = stats.where("odd").select(*cluster, "n", "n_known")
    entangled = _joined(rows.select(*cluster, "step", "known", "place", "body", "marked"), bound, cluster)
    folded = cut(entangled.repartition(*cluster).sortWithinPartitions(*cluster, "step", "place").mapInArrow(_folded, _FOLDED))
    # the first conflict of a group: its step is looked up where it is one that a record's absence makes
    missing = folded.where("reason IS NOT NULL")
    absent = _joined(missing.where("known IS NOT NULL").drop("step"), sizes.select(*_GROUP, "_first", "_first_known"), _GROUP).withColumn("_nth", F.col("_first_known") + F.col("known"))
    absent = absent.join(own, "_nth").withColumn("step", F.col("_place") - F.col("_first")).select(*folded.columns)
    all_ = missing.where("known IS NULL").unionByName(absent)
    conflict = all_.groupBy(*_GROUP).agg(F.min(F.struct("step", "kind", "first", "reason"))["reason"].alias("conflict"))
    parts = free.unionByName(folded.where("reason IS NULL").select(*_GROUP, "text", "marked")).groupBy(*_GROUP).agg(F.collect_list(F.struct("text", "marked")).alias("parts"))
    out = _joined(_joined(groups.select(*_GROUP, "n_known"), parts, _GROUP, "left"), conflict, _GROUP, "left")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("split", pa.string()), ("_key", pa.string()), ("elements", pa.string()), ("evidence", pa.list_(pa.int32())), ("conflict", pa.string())])
        for batch in batches:
            for at in range(batch.num_rows):  # a row may be long
                r = batch.slice(at, 1).to_pylist()[0]
                made = {"split": r["split"], "_key": r["_key"], "conflict": r["conflict"]}
                if r["conflict"] is None:
                    parts = sorted(((json.loads(p["text"]), p["marked"]) for p in r["parts"] or ()), key=lambda p: _reading_order(p[0]))
                    made |= {"elements": _text([e for e, _ in parts]), "evidence": [i for i, (_, m) in enumerate(parts) if m] if r["n_known"] else None}
                yield pa.RecordBatch.from_pylist([made], schema=schema)

    return out.mapInArrow(listed, "split string, _key string, elements string, evidence array<int>, conflict string")
