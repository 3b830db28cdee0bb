"""Accuracy, average precision, intervals and plan statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .keyed import broadcast_if_small


def accuracy_by_subset(scored: DataFrame, subset: str, ok: Column) -> DataFrame:
    """Share of right answers, overall (null subset) and by subset."""
    return scored.rollup(subset).agg(F.count("*").alias("n"), F.avg(ok.cast("int")).alias("accuracy"), F.grouping(subset).alias("_all")).select(subset, (F.col("_all") == 1).alias("overall"), "n", "accuracy")


def plan_statistics(rows: DataFrame, usable: Column, has_plan: Column, executes: Column, reproduces: Column, executed_right: Column, stated_right: Column, times: Column | None = None) -> DataFrame:
    """Counts of usable plans, and accuracies over all rows (at least one); a row stands for ``times`` alike."""
    plan = usable & has_plan
    ran = plan & executes
    times = F.lit(1).cast("long") if times is None else times
    number = lambda test: F.coalesce(F.sum(F.when(test, times).otherwise(0)), F.lit(0))
    n = F.greatest(number(F.lit(True)), F.lit(1))
    return rows.agg(
        number(plan).alias("answers_with_plan"),
        number(ran).alias("plans_that_execute"),
        number(ran & reproduces).alias("plans_reproducing_stated_answer"),
        (number(ran & executed_right) / n).alias("executed_plan_accuracy"),
        (number(ran & reproduces & stated_right) / n).alias("plan_verified_accuracy"),
    )


def match_detections(detections: DataFrame, truths: DataFrame, least_iou: float = 0.5, most: int = 100) -> DataFrame:
    """Which of an image's best detections are true.

    ``detections``: ``image, seq, score, bbox``; ``truths``: ``image, bbox``,
    in order of ``seq``.  Detections take the free truth they overlap most, in
    the order of their scores; of equal overlaps the later one.  An image is
    one group, bounded by ``most`` detections.
    """
    order = Window.partitionBy("image").orderBy(F.desc("score"), "seq")
    best = detections.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= most)
    best = best.groupBy("image").agg(F.array_sort(F.collect_list(F.struct("_nth", "seq", "score", "bbox"))).alias("found"))
    there = truths.groupBy("image").agg(F.array_sort(F.collect_list(F.struct("seq", "bbox"))).alias("there"))
    kind = detections.schema["image"].dataType.simpleString()
    return best.join(there, "image", "left").mapInArrow(_matched(least_iou), f"image {kind}, seq bigint, score double, hit boolean")


def _boxes(lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Structs of a batch's lists, their boxes, and how many each row has."""
    structs = lists.flatten()
    boxes = structs.field("bbox").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, 4)
    return structs, boxes, lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of boxes, pair by pair; -1 where both are empty."""
    inter = np.prod(np.clip(np.minimum(a[:, 2:], b[:, 2:]) - np.maximum(a[:, :2], b[:, :2]), 0, None), axis=1)
    union = np.prod(a[:, 2:] - a[:, :2], axis=1) + np.prod(b[:, 2:] - b[:, :2], axis=1) - inter
    return np.where(union > 0, inter / np.where(union > 0, union, 1), -1.0)


def greedy_hits(found: np.ndarray, n_found: np.ndarray, there: np.ndarray, n_there: np.ndarray, least_iou: float) -> np.ndarray:
    """Which detections find a free truth, in their order; all images' first ones at once, then all second ones, and so on."""
    hits, free = np.zeros(len(found), dtype=bool), np.ones(len(there), dtype=bool)
    first_found, first_there = np.cumsum(n_found) - n_found, np.cumsum(n_there) - n_there
    for k in range(int(n_found.max(initial=0))):
        images = np.flatnonzero((n_found > k) & (n_there > 0))
        sizes, edges = n_there[images], np.cumsum(n_there[images]) - n_there[images]
        pair = np.repeat(first_there[images] - edges, sizes) + np.arange(int(sizes.sum()))
        mine = first_found[images] + k
        overlap = np.where(free[pair], _overlaps(np.repeat(found[mine], sizes, axis=0), there[pair]), -1.0)
        if not len(overlap):
            continue
        best = np.maximum.reduceat(overlap, edges)
        # of equal overlaps the later truth
        last = np.maximum.reduceat(np.where(overlap == np.repeat(best, sizes), pair, -1), edges)
        hit = best >= least_iou
        hits[mine[hit]] = True
        free[last[hit]] = False
    return hits


def _matched(least_iou: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Greedy matches of batches of images, each with its sorted lists ``found`` and ``there``."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            structs, found, n_found = _boxes(batch.column(batch.schema.get_field_index("found")))
            _, there, n_there = _boxes(batch.column(batch.schema.get_field_index("there")))
            hits = greedy_hits(found, n_found, there, n_there, least_iou)
            images = batch.column(batch.schema.get_field_index("image")).take(pa.array(np.repeat(np.arange(batch.num_rows), n_found)))
            yield pa.RecordBatch.from_arrays([images, structs.field("seq").cast(pa.int64()), structs.field("score").cast(pa.float64()), pa.array(hits)], names=["image", "seq", "score", "hit"])

    return match


def precision_recall(hits: DataFrame, truths: DataFrame, ranges: int = 16) -> DataFrame:
    """Running precision and recall of each group in the order of scores: ``group, place, precision, recall``.

    ``hits``: ``groups`` (those that a detection counts for), ``score, image,
    seq, hit``; ``truths``: ``group, truths``, one row a group.  Scores are cut
    into ranges once for all groups, and sums of a group's ranges are added up
    first, so that no task sees all detections.
    """
    placed = hits.repartitionByRange(ranges, F.desc("score"), "image", "seq").sortWithinPartitions(F.desc("score"), "image", "seq")
    placed = cut(placed.select("groups", F.col("hit").cast("int").alias("_one"), F.monotonically_increasing_id().alias("_id")))
    placed = placed.select(F.explode("groups").alias("group"), "_one", "_id", F.shiftright("_id", 33).alias("_part"))
    sums = placed.groupBy("group", "_part").agg(F.sum("_one").alias("_tp"), F.count("*").alias("_n"))
    # a row for each group and range
    earlier = Window.partitionBy("group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("group", "_part", F.coalesce(F.sum("_tp").over(earlier), F.lit(0)).alias("_tp0"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"))
    inside = Window.partitionBy("group", "_part").orderBy("_id")
    run = placed.withColumn("_nth", F.row_number().over(inside)).withColumn("_sum", F.sum("_one").over(inside))
    run = run.join(sums, ["group", "_part"]).join(broadcast_if_small(truths), "group")
    place, found = F.col("_n0") + F.col("_nth"), F.col("_tp0") + F.col("_sum")
    return run.select("group", place.alias("place"), (found / place).alias("precision"), (found / F.col("truths").cast("double")).alias("recall"))


def average_precisions(hits: DataFrame, truths: DataFrame) -> DataFrame:
    """A10: ``group, ap`` for each group of ``truths``: the mean over 101 recall levels of the best precision at that recall or beyond.

    The best precision from a level on is the largest of all places with at
    least that recall: 101 maxima a group, and no sorted window over all
    places.  A group without truths or detections has 0.
    """
    truths = cut(truths)
    curve = precision_recall(hits, truths.where("truths > 0"))
    # a place counts for all levels up to its recall; only each level step's best matters
    step = F.least(F.floor(F.col("recall") * 100 + F.lit(1e-9)), F.lit(100)).cast("int")
    best = curve.groupBy("group", step.alias("step")).agg(F.max("precision").alias("precision"))
    steps = best.groupBy("group").agg(F.collect_list(F.struct("step", "precision")).alias("steps"))
    level = lambda i: F.coalesce(F.array_max(F.transform(F.filter("steps", lambda s: s["step"] >= i), lambda s: s["precision"])), F.lit(0.0))
    ap = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(100)), level), F.lit(0.0), lambda a, b: a + b) / 101
    return truths.join(steps, "group", "left").select("group", F.coalesce(F.when(F.col("steps").isNotNull(), ap), F.lit(0.0)).alias("ap"))


def average_precision(hits: DataFrame, truths: int) -> DataFrame:
    """A10: ``ap`` of ``hits`` (``score, image, seq, hit``) as one group."""
    one = hits.sparkSession.range(1).select(F.lit("all").alias("group"), F.lit(truths).cast("long").alias("truths"))
    return average_precisions(hits.withColumn("groups", F.array(F.lit("all"))), one).select("ap")


def grounding_report(answers: DataFrame, detections: DataFrame, truths: DataFrame, ok: Column, kinds: tuple[str, ...] = ("human", "machine", "pot"), least_iou: float = 0.5) -> DataFrame:
    """``kind, n, accuracy, ap`` of grounded answers, overall (null kind) and for each kind that has rows.

    ``answers``: ``image, kind`` and what ``ok`` looks at; ``detections`` and
    ``truths`` as for ``match_detections``.  All kinds' curves come from one
    order of all detections.
    """
    known = answers.select("image", "kind").distinct()
    # a detection counts overall and for its kind
    groups = F.when(F.col("kind").isin(*kinds), F.array(F.lit("all"), F.concat(F.lit("="), "kind"))).otherwise(F.array(F.lit("all")))
    # a range sort reads its input twice
    hits = cut(match_detections(detections, truths, least_iou).join(known, "image").withColumn("groups", groups))
    there = truths.join(known, "image").select(F.explode(groups).alias("group")).groupBy("group").agg(F.count("*").alias("truths"))
    ap = average_precisions(hits, there).select("group", "ap")
    shares = accuracy_by_subset(answers, "kind", ok).where(F.col("overall") | F.col("kind").isin(*kinds))
    own = F.when(F.col("overall"), F.lit("all")).otherwise(F.concat(F.lit("="), "kind"))
    return shares.withColumn("group", own).join(ap, "group", "left").select("kind", "n", "accuracy", F.coalesce("ap", F.lit(0.0)).alias("ap"))


#: Values that are drawn together, about, and values of one number that are drawn as so many single ones.
BLOCK, SINGLE = 4096, 16


def resampled_sums(values: np.ndarray, counts: np.ndarray, resamples: int, seed: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Sums and sizes of ``resamples`` draws in which each value occurs Poisson(count) times.

    Rare values are drawn together: as many as a Poisson number says, each of
    them any of the rows.  That is the same as a Poisson number for each row,
    and costs one number for each that is drawn.
    """
    random = np.random.Generator(np.random.SFC64(seed))
    often = counts > SINGLE
    total, size = np.zeros(resamples), np.zeros(resamples)
    for value, count in zip(values[often], counts[often], strict=True):
        drawn = random.poisson(count, resamples)
        total += value * drawn
        size += drawn
    rows = np.repeat(values[~often], counts[~often])
    if len(rows):
        n = random.poisson(len(rows), resamples)
        step = max(1, (1 << 17) // len(rows))
        for at in range(0, resamples, step):
            own = n[at : at + step]
            picked = np.append(rows[random.integers(0, len(rows), int(own.sum()), dtype=np.uint16 if len(rows) <= 1 << 16 else np.uint32)], 0.0)
            sums = np.add.reduceat(picked, np.cumsum(own) - own)
            total[at : at + step] += np.where(own > 0, sums, 0.0)
        size += n
    return total, size


def bootstrap_interval(values: DataFrame, column: str, resamples: int = 10_000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """Mean and percentile interval; nulls don't count, without values all three are null.

    Each row occurs a Poisson number of times in a resample (the limit of
    drawing with replacement).  Equal values are counted first, and a value
    that occurs often takes one draw a resample for all its rows.  Distinct
    values are dealt to blocks by their hash, each with numbers of its own, so
    that the interval doesn't hang on partitions; tasks add up their blocks
    and only sums are shuffled.
    """
    rows = values.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("value")).agg(F.count("*").alias("count"))
    rows = cut(rows)
    blocks = max(1, -(-rows.count() // BLOCK))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("value"), F.lit(blocks)))

    def draw(table: pa.Table) -> pa.Table:
        table = table.sort_by("value")
        total, size = resampled_sums(table.column("value").to_numpy(), table.column("count").to_numpy(), resamples, [seed, table.column("block")[0].as_py()])
        return pa.table({"i": np.arange(resamples), "total": total, "size": size})

    # blocks are few rows but much work: they aren't put together by size
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sums = rows.repartition(min(blocks, tasks), "block").groupBy("block").applyInArrow(draw, "i bigint, total double, size double").groupBy("i").agg((F.sum("total") / F.nullif(F.sum("size"), F.lit(0.0))).alias("mean"))
    bounds = sums.agg(F.percentile("mean", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("b"))
    mean = rows.agg((F.sum(F.col("value") * F.col("count")) / F.sum("count")).alias("mean"))
    return bounds.crossJoin(mean).select("mean", F.get("b", 0).alias("low"), F.get("b", 1).alias("high"))


def weighted_loss(chunks: DataFrame) -> DataFrame:
    """The mean loss of chunks ``loss, n`` by their size."""
    return chunks.agg((F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("loss"))


def training_metrics(rows: DataFrame, right: Column, valid: Column, trip: Column, ap: float) -> DataFrame:
    """Answer accuracy, shares of valid records and of plans that agree, and the mean of accuracy and AP that checkpoints are chosen by."""
    n = F.greatest(F.count("*"), F.lit(1))
    accuracy = F.count_if(right) / n
    agree = F.try_divide(F.count_if(trip == "agrees"), F.count_if(trip != "no_plan"))
    return rows.agg(accuracy.alias("answer_accuracy"), (F.count_if(valid) / n).alias("schema_valid"), agree.alias("round_trip"), F.lit(ap).alias("ap"), ((accuracy + F.lit(ap)) / 2).alias("selection"))
