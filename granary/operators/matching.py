"""Matches between boxes of one image: the person of a face, and suppression of overlapping boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.boxes import iou


def match_person(faces: DataFrame, persons: DataFrame, key: str) -> DataFrame:
    """Each face with its person (id, box, score), null where none stands near.

    faces has `key` and face, persons has `key`, id, box (where the person's face is) and score. A person's weight is
    its overlap, nearness and score; the heaviest wins, of equal ones the smaller id, and is left out if the face's
    centre is more than a face away from its box. One join and one aggregation on the image.
    """
    f, p = F.col("face"), F.col("box")
    size = F.greatest(F.lit(1.0), f["x2"] - f["x1"], f["y2"] - f["y1"])
    fx, fy = (f["x1"] + f["x2"]) / 2, (f["y1"] + f["y2"]) / 2
    gap = F.hypot(fx - (p["x1"] + p["x2"]) / 2, fy - (p["y1"] + p["y2"]) / 2) / size
    weight = F.round(4.0 * iou(f, p) + F.exp(-0.5 * gap) + 0.1 * F.col("score"), 9)
    near = fx.between(p["x1"] - size, p["x2"] + size) & fy.between(p["y1"] - size, p["y2"] + size)
    order = F.struct(weight, -F.col("id"))
    best = faces.join(persons, key).groupBy(key, "face").agg(F.max_by(F.struct("id", "box", "score", near.alias("near")), order).alias("b"))
    best = best.filter("b.near").select(key, "face", F.struct("b.id", "b.box", "b.score").alias("person"))
    return faces.join(best, [key, "face"], "left")


def suppress(boxes: DataFrame, key: str, least_overlap: float = 0.30) -> DataFrame:
    """The boxes (key, id, box, score) that stay when, by falling score, each one goes that overlaps one that stays.

    Ties go to the smaller id. The boxes of one image are gathered in one row; an image holds a bounded number of them.
    """
    item = F.struct((-F.col("score")).alias("rank"), "id", "box")
    kind = "array<struct<rank:double,id:bigint,box:struct<x1:double,y1:double,x2:double,y2:double>>>"
    ordered = F.array_sort(F.collect_list(item))
    grouped = boxes.groupBy(key).agg(ordered.alias("all"))

    def step(kept, x):
        return F.when(F.exists(kept, lambda k: iou(k["box"], x["box"]) >= least_overlap), kept).otherwise(F.concat(kept, F.array(x)))

    kept = F.aggregate(F.col("all").cast(kind), F.array().cast(kind), step)
    return grouped.select(key, F.explode(kept).alias("k")).select(key, "k.id", "k.box", (-F.col("k.rank")).alias("score"))
