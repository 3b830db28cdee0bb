"""Boxes: ``array<double>`` of x1, y1, x2, y2 on a canvas of 1000 by 1000."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDE = 1000.0


def _clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def xywh_to_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """A pixel box as clamped corners; null if a part is missing, the image is empty or an extent negative."""
    good = (width > 0) & (height > 0) & (w >= 0) & (h >= 0) & x.isNotNull() & y.isNotNull()
    box = F.array(*[_clamp(F.lit(SIDE) * a / b, 0.0, SIDE) for a, b in ((x, width), (y, height), (x + w, width), (y + h, height))])
    return F.when(good, box)


def has_area(box: Column) -> Column:
    return (box[2] > box[0]) & (box[3] > box[1])


def boxes_with_area(boxes: Column) -> Column:
    """Without boxes of no area; null (malformed) if any box is null."""
    return F.when(F.forall(boxes, lambda b: b.isNotNull()), F.filter(boxes, has_area))


def box_or_null(box: Column) -> Column:
    """Null for a bad or degenerate box."""
    return F.when(has_area(box), box)


def pixels_to_box(box: Column, width: Column, height: Column) -> Column:
    """Pixel corners to the canvas, not clamped."""
    return F.array(*[F.lit(SIDE) * box[i] / (width if i % 2 == 0 else height) for i in range(4)])


def clamp_box(box: Column, most: int = 999) -> Column:
    """Whole coordinates from 0 to 999, halves to even."""
    return F.transform(box, lambda v: _clamp(F.bround(v, 0), 0.0, float(most)).cast("int"))


def area(box: Column) -> Column:
    return F.greatest(F.lit(0.0), box[2] - box[0]) * F.greatest(F.lit(0.0), box[3] - box[1])


def iou(a: Column, b: Column) -> Column:
    """Intersection over union, 0 if both are empty."""
    wide = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    high = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    inter = wide * high
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def same_box(a: Column, b: Column, slack: float = 1.0) -> Column:
    """No coordinate differs by more than ``slack``."""
    return F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y)), lambda d: d <= slack)


def valid_box(box: Column) -> Column:
    """Four finite coordinates in order on the canvas."""
    inside = F.forall(box, lambda v: v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v <= SIDE))
    return F.coalesce((F.size(box) == 4) & inside & has_area(box), F.lit(False))


def box_errors(box: Column) -> Column:
    """What is wrong with a box's coordinates, as an array of texts."""
    infinite = F.exists(box, lambda v: F.isnan(v) | (F.abs(v) == float("inf")))
    of = lambda bad, text: F.when(bad, F.lit(text))
    return F.when(infinite, F.array(F.lit("not finite"))).otherwise(F.array_compact(F.array(of(box[0] >= box[2], "x1 is not less than x2"), of(box[1] >= box[3], "y1 is not less than y2"))))


def expand(box: Column, share: float = 0.35) -> Column:
    """Larger by a share of its extent on each side, clipped to the canvas."""
    w, h = (box[2] - box[0]) * share, (box[3] - box[1]) * share
    return clip(F.array(box[0] - w, box[1] - h, box[2] + w, box[3] + h))


def clip(box: Column) -> Column:
    """Clipped to the canvas."""
    return F.transform(box, lambda v: _clamp(v, 0.0, SIDE))


def is_degenerate(box: Column, least: float) -> Column:
    """A side is shorter than ``least``."""
    return ((box[2] - box[0]) < least) | ((box[3] - box[1]) < least)


def union_boxes(boxes: Column, slack: float = 1.0) -> Column:
    """Boxes in order, each kept unless an earlier kept one is the same within the slack."""
    start = F.array().cast("array<array<double>>")
    return F.aggregate(F.array_sort(boxes), start, lambda kept, b: F.when(F.exists(kept, lambda k: same_box(k, b, slack)), kept).otherwise(F.array_append(kept, b)))


def cited_boxes(refs: Column, facts: Column) -> Column:
    """Boxes of cited facts (``id``, ``bbox``); the last fact of an id counts, malformed boxes don't."""
    def of(ref: Column) -> Column:
        own = F.filter(facts, lambda f: f["id"] == ref)
        return F.get(own, F.size(own) - 1)["bbox"]

    return F.filter(F.transform(refs, of), lambda b: b.isNotNull() & (F.size(b) == 4) & F.forall(b, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))))


def smart_size(width: Column, height: Column, patch: int = 28, least: int = 56 * 56, most: int = 1280 * 28 * 28) -> Column:
    """Width and height as multiples of a patch within a pixel budget; null beyond an aspect of 200."""
    to = lambda v, how: how(v / F.lit(float(patch))) * F.lit(patch)
    w, h = F.greatest(F.lit(patch), to(width, lambda x: F.bround(x, 0))), F.greatest(F.lit(patch), to(height, lambda x: F.bround(x, 0)))
    shrink, grow = F.sqrt(width * height / F.lit(float(most))), F.sqrt(F.lit(float(least)) / (width * height))
    down = F.struct(F.greatest(F.lit(patch), to(width / shrink, F.floor)).cast("int").alias("width"), F.greatest(F.lit(patch), to(height / shrink, F.floor)).cast("int").alias("height"))
    up = F.struct(to(width * grow, F.ceil).cast("int").alias("width"), to(height * grow, F.ceil).cast("int").alias("height"))
    plain = F.struct(w.cast("int").alias("width"), h.cast("int").alias("height"))
    size = F.when(w * h > most, down).when(w * h < least, up).otherwise(plain)
    return F.when(F.greatest(width, height) / F.least(width, height) <= 200, size)


def bar_elements(series: Column, labels: Column, values: Column, boxes: Column, colours: Column) -> Column:
    """P20: a bar series' elements; lists of different lengths give none, boxes of no area are dropped."""
    n = F.size(boxes)
    zipped = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(series.alias("series"), F.get(labels, i).alias("label"), F.get(values, i).alias("value"), F.get(boxes, i).alias("bbox"), F.get(colours, i).alias("colour")))
    fits = (n > 0) & (F.size(values) == n) & (labels.isNull() | (F.size(labels) == n))
    none = F.filter(zipped, lambda e: F.lit(False))
    return F.when(fits, F.filter(zipped, lambda e: box_or_null(e["bbox"]).isNotNull())).when(n > 0, none)


def aligned_colours(colours: Column, one: Column, n: Column) -> Column:
    """A colour for each of ``n`` elements: the list padded with null, else the one colour; ``unk`` is null."""
    known = lambda c: F.when(c != "unk", c)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: known(F.when(colours.isNotNull(), F.get(colours, i)).otherwise(one)))


def wedge_element(label: Column, value: Column, box: Column, boxes: Column, colour: Column) -> Column:
    """A pie wedge, null without label, value or box; the first of ``boxes`` stands in for a box."""
    place = box_or_null(F.coalesce(box, F.get(boxes, 0)))
    return F.when(label.isNotNull() & value.isNotNull() & place.isNotNull(), F.struct(label.alias("label"), value.alias("value"), place.alias("bbox"), F.when(colour != "unk", colour).alias("colour")))
