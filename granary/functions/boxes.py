"""Boxes as structs (x1, y1, x2, y2) of doubles, and crop plans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions.text import fixed


def box(x1, y1, x2, y2) -> Column:
    return F.struct(*(c.cast("double").alias(n) for c, n in ((x1, "x1"), (y1, "y1"), (x2, "x2"), (y2, "y2"))))


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x2"] - b["x1"]) * F.greatest(F.lit(0.0), b["y2"] - b["y1"])


def intersection(a: Column, b: Column) -> Column:
    return box(F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]), F.least(a["x2"], b["x2"]), F.least(a["y2"], b["y2"]))


def intersects(a: Column, b: Column) -> Column:
    """Whether boxes share more than an edge."""
    return (a["x1"] < b["x2"]) & (b["x1"] < a["x2"]) & (a["y1"] < b["y2"]) & (b["y1"] < a["y2"])


def expand(b: Column, ratio: float) -> Column:
    by = F.greatest(F.lit(4.0), ratio * F.greatest(b["x2"] - b["x1"], b["y2"] - b["y1"]))
    return box(b["x1"] - by, b["y1"] - by, b["x2"] + by, b["y2"] + by)


def iou(a: Column, b: Column) -> Column:
    common = area(intersection(a, b))
    return common / F.greatest(F.lit(1e-6), area(a) + area(b) - common)


def rescale(b: Column, sx: Column, sy: Column) -> Column:
    """A box of an analysed copy in the pixels of the original."""
    return box(b["x1"] * sx, b["y1"] * sy, b["x2"] * sx, b["y2"] * sy)


def square_around(b: Column, width: Column, height: Column, factor: float, shift: float = 0.0) -> Column:
    """A square of `factor` times the longer side around a box, moved down by a share of its height and cut at the image."""
    half = F.greatest(b["x2"] - b["x1"], b["y2"] - b["y1"]) * factor / 2
    cx, cy = (b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2 + shift * (b["y2"] - b["y1"])
    zero = F.lit(0.0)
    return box(F.greatest(zero, F.bround(cx - half)), F.greatest(zero, F.bround(cy - half)), F.least(width, F.bround(cx + half)), F.least(height, F.bround(cy + half)))


def hull(boxes: Column) -> Column:
    """The smallest box around an array of boxes; null for an empty one. Null boxes don't count."""
    side = lambda n, pick: pick(F.transform(boxes, lambda b: b[n]))
    return F.when(F.size(F.filter(boxes, lambda b: b.isNotNull())) > 0, box(side("x1", F.array_min), side("y1", F.array_min), side("x2", F.array_max), side("y2", F.array_max)))


def kept_percent(kept: Column, whole: Column) -> Column:
    """Share of an area that a crop keeps, in percent with two decimals, as text; halves round to even."""
    return fixed(100.0 * kept / whole, 2)


def capped_size(width: Column, height: Column, most: int) -> Column:
    """Size of an image whose longer side may be `most` at most; one pixel at least, halves to even."""
    scale = F.least(F.lit(1.0), most / F.greatest(width, height))
    return F.struct(F.greatest(F.lit(1.0), F.bround(width * scale)).cast("long").alias("width"), F.greatest(F.lit(1.0), F.bround(height * scale)).cast("long").alias("height"))
