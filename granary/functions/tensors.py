"""Output tensors of detectors as boxes of classes: flat array columns, decoded in the row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions.boxes import box, iou

DETECTION = "struct<class_id:int,score:double,box:struct<x1:double,y1:double,x2:double,y2:double>>"


def let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def decoded(tensor: Column, boxes: Column | int, classes: int, width: Column, height: Column, scale: Column | float = 1.0, pad_left: Column | float = 0.0, pad_top: Column | float = 0.0, left: Column | float = 0.0, top: Column | float = 0.0, least: float = 0.25, by_box: bool = False) -> Column:
    """An array of DETECTION from a tensor of centre x, centre y, width, height and a score for each class.

    The flat tensor has 4 + `classes` rows of `boxes` values, or with by_box a row for each box. A box takes its best
    class, the first of equal ones, and is left out below `least`. Centres and sizes are in the padded and scaled copy
    that the model saw; boxes come back in whole pixels of the region of width and height, halves to even, cut at its
    edges and moved to where it lies in the image. Boxes that nothing is left of go. A null tensor gives null; a tensor
    of another size raises an error.
    """
    n, sizes = F.lit(boxes) if isinstance(boxes, int) else boxes, 4 + classes
    scale, pad_left, pad_top, left, top = (F.lit(float(x)) if not isinstance(x, Column) else x for x in (scale, pad_left, pad_top, left, top))

    def value(row: Column | int, i: Column) -> Column:
        row = F.lit(row) if isinstance(row, int) else row
        return F.get(tensor, i * sizes + row if by_box else row * n + i).cast("double")

    def pixel(centre: Column, half: Column, pad: Column) -> Column:
        return F.bround((centre + half - pad) / scale)

    def one(i: Column) -> Column:
        scores = F.transform(F.sequence(F.lit(4), F.lit(sizes - 1)), lambda row: value(row, i))
        return let(scores, lambda s: let(F.struct(F.array_max(s).alias("score"), value(0, i).alias("cx"), value(1, i).alias("cy"), (value(2, i) / 2).alias("w"), (value(3, i) / 2).alias("h"), s.alias("all")), found))

    def found(v: Column) -> Column:
        zero = F.lit(0.0)
        cut = box(F.greatest(zero, pixel(v["cx"], -v["w"], pad_left)), F.greatest(zero, pixel(v["cy"], -v["h"], pad_top)), F.least(width, pixel(v["cx"], v["w"], pad_left)), F.least(height, pixel(v["cy"], v["h"], pad_top)))
        class_id = (F.array_position(v["all"], v["score"]) - 1).cast("int")
        return F.struct(class_id.alias("class_id"), v["score"].alias("score"), cut.alias("box"))

    def moved(d: Column) -> Column:
        b = d["box"]
        return F.struct(d["class_id"].alias("class_id"), d["score"].alias("score"), box(b["x1"] + left, b["y1"] + top, b["x2"] + left, b["y2"] + top).alias("box"))

    fits = F.when(F.size(tensor) == n * sizes, F.sequence(F.lit(0), n - 1)).otherwise(F.raise_error(F.lit(f"a tensor of {sizes} rows was expected")))
    all_ = F.transform(F.when(tensor.isNotNull() & (n > 0), fits), one)
    kept = F.filter(all_, lambda d: (d["score"] >= least) & (d["box"]["x2"] > d["box"]["x1"]) & (d["box"]["y2"] > d["box"]["y1"]))
    return F.transform(kept, moved).cast(f"array<{DETECTION}>")


def suppressed(found: Column, overlap: float = 0.45, by_class: bool = False) -> Column:
    """Of an array of DETECTION those that stay when, by falling score, each one goes that overlaps one that stays by more.

    Ties keep the array's order. With by_class only boxes of one class hide each other.
    """
    item = "struct<rank:double,at:int,class_id:int,box:struct<x1:double,y1:double,x2:double,y2:double>>"
    order = F.array_sort(F.transform(found, lambda d, i: F.struct((-d["score"]).alias("rank"), i.alias("at"), d["class_id"].alias("class_id"), d["box"].alias("box"))))

    def step(kept: Column, d: Column) -> Column:
        def hides(k: Column) -> Column:
            near = iou(k["box"], d["box"]) > overlap
            return near & (k["class_id"] == d["class_id"]) if by_class else near

        return F.when(F.exists(kept, hides), kept).otherwise(F.concat(kept, F.array(d)))

    kept = F.aggregate(order.cast(f"array<{item}>"), F.array().cast(f"array<{item}>"), step)
    return F.transform(kept, lambda d: F.struct(d["class_id"].alias("class_id"), (-d["rank"]).alias("score"), d["box"].alias("box")))
