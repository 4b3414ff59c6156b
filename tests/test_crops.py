"""Crop plans, person matches and box suppression on hand-made cases."""

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from granary.functions.boxes import box
from granary.operators import crops, matching
from granary.plans import queries
from granary.sources.views import detections

BODY = "struct<box:struct<x1:double,y1:double,x2:double,y2:double>,confidence:double,points:array<struct<x:double,y:double,kind:string,reach:double>>,bones:array<struct<ax:double,ay:double,bx:double,by:double>>>"


def frame():
    return F.lit(1000.0), F.lit(1200.0)


def no_box():
    return F.lit(None).cast(crops.BOX)


def b(*xs):
    return box(*map(F.lit, xs))


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def body(confidence, points="array()", bones="array()"):
    text = f"named_struct('box', named_struct('x1', 300D, 'y1', 200D, 'x2', 600D, 'y2', 900D), 'confidence', {confidence}D, 'points', {points}, 'bones', {bones})"
    return F.expr(f"cast({text} as {BODY})")


def test_safe_bounds(spark):
    target, whole = b(400, 400, 500, 500), b(0, 0, 1000, 1200)
    assert tuple(value(spark, crops.safe_bounds(*frame(), target, F.array().cast(f"array<{crops.BOX}>"), whole))) == (0, 0, 1000, 1200)
    assert tuple(value(spark, crops.safe_bounds(*frame(), target, F.lit(None).cast(f"array<{crops.BOX}>"), whole))) == (0, 0, 1000, 1200)
    right = F.array(b(700, 400, 800, 500))
    assert tuple(value(spark, crops.safe_bounds(*frame(), target, right, whole))) == (0, 0, 660, 1200)
    two = F.array(b(700, 400, 800, 500), b(400, 800, 500, 900))
    assert tuple(value(spark, crops.safe_bounds(*frame(), target, two, whole))) == (0, 0, 660, 760)
    assert tuple(value(spark, crops.safe_bounds(*frame(), target, F.array(b(700, 700, 800, 800)), b(0, 0, 1000, 600)))) == (0, 0, 1000, 660)
    assert value(spark, crops.safe_bounds(*frame(), target, F.array(b(520, 400, 600, 500)), whole)) is None


@pytest.mark.parametrize(
    "scale, person, strategy, reasons",
    [
        ("far", None, "context_original", ["far_view_preserved"]),
        ("far", (0.9,), "body_crop_far", []),
        ("far", (0.4,), "context_original", ["far_view_preserved"]),
        ("close", None, "original_fallback", ["body_not_found"]),
        ("close", (0.4,), "original_fallback", ["pose_uncertain"]),
        ("close", (0.9,), "body_aware_smart_close", []),
        ("close", (0.9, "array()", "array(named_struct('ax', 500D, 'ay', 450D, 'bx', 990D, 'by', 1190D))"), "original_fallback", ["fingers_cut"]),
    ],
)
def test_body_aware_crop(spark, scale, person, strategy, reasons):
    person = F.lit(None).cast(BODY) if person is None else body(*person)
    got = value(spark, crops.body_aware_crop(*frame(), b(450, 400, 550, 500), F.lit(scale), no_box(), person))
    assert (got["strategy"], got["reasons"]) == (strategy, reasons)
    if strategy == "original_fallback":
        assert tuple(got["box"]) == (0, 0, 1000, 1200)


def test_risks(spark):
    crop = b(100, 100, 500, 500)
    hand = "array(named_struct('x', 110D, 'y', 300D, 'kind', 'hand', 'reach', null))"
    assert value(spark, crops.crop_risks(crop, *frame(), no_box(), body(1, hand))) == ["hand_near_edge"]
    assert value(spark, crops.crop_risks(crop, *frame(), b(105, 200, 300, 300), body(1))) == ["head_near_edge"]
    assert value(spark, crops.crop_risks(b(0, 0, 1000, 1200), *frame(), b(1, 1, 999, 1199), body(1, hand))) == []
    assert value(spark, crops.cuts_joint(crop, *frame(), body(1, hand.replace("hand", "joint"))))


def test_recommended_crop(spark):
    target = b(450, 400, 550, 500)
    assert tuple(value(spark, crops.recommended_crop(*frame(), target, F.lit("far"), no_box()))) == (0, 0, 1000, 1200)
    assert tuple(value(spark, crops.recommended_crop(*frame(), target, F.lit("close"), no_box()))) == (412, 365, 588, 585)
    assert tuple(value(spark, crops.parsing_region(target, *frame()))) == (360, 298, 640, 578)


def test_skip_reason(spark):
    target, other, bucket = b(0, 0, 10, 10), F.array(b(5, 5, 20, 20)), F.lit("512x512")
    assert value(spark, crops.skip_reason(no_box(), target, bucket, target, other)) == "unreadable_or_missing_target"
    assert value(spark, crops.skip_reason(target, no_box(), bucket, target, other)) == "head_zones_overlap"
    assert value(spark, crops.skip_reason(target, target, F.lit(None), target, other)) == "no_compatible_bucket"
    assert value(spark, crops.skip_reason(target, target, bucket, target, other)) == "other_face_in_crop"
    assert value(spark, crops.skip_reason(target, target, bucket, target, F.array(b(10, 0, 20, 10)))) is None


def boxes_of(spark, rows):
    return spark.createDataFrame([(k, i, s, *map(float, x)) for k, i, s, x in rows], "image long, id long, score double, x1 double, y1 double, x2 double, y2 double").select("image", "id", "score", box(*map(F.col, ("x1", "y1", "x2", "y2"))).alias("box"))


def test_match_person(spark):
    persons = boxes_of(spark, [(1, 1, 0.5, (0, 0, 10, 10)), (1, 2, 0.9, (200, 200, 210, 210)), (2, 3, 0.9, (500, 500, 510, 510))])
    faces = boxes_of(spark, [(1, 0, 1.0, (1, 1, 11, 11)), (2, 0, 1.0, (0, 0, 10, 10)), (3, 0, 1.0, (0, 0, 10, 10))]).select("image", F.col("box").alias("face"))
    got = {r["image"]: r["person"] and r["person"]["id"] for r in matching.match_person(faces, persons, "image").collect()}
    assert got == {1: 1, 2: None, 3: None}


def test_suppress(spark):
    rows = [(1, 1, 0.9, (0, 0, 10, 10)), (1, 2, 0.8, (1, 1, 11, 11)), (1, 3, 0.7, (9, 9, 19, 19)), (1, 4, 0.9, (0, 0, 10, 10)), (2, 5, 0.1, (0, 0, 10, 10))]
    assert sorted(r["id"] for r in matching.suppress(boxes_of(spark, rows), "image").collect()) == [1, 3, 5]


def overlap(p, q):
    common = max(0.0, min(p[2], q[2]) - max(p[0], q[0])) * max(0.0, min(p[3], q[3]) - max(p[1], q[1]))
    return common / max(1e-6, sum((r[2] - r[0]) * (r[3] - r[1]) for r in (p, q)) - common)


def test_suppress_plainly(spark):
    images = {}
    for r in queries._boxes(detections(spark, DATA)).collect():
        images.setdefault(r["image"], []).append((-r["score"], r["id"], tuple(r["box"])))
    want = set()
    for image, rows in images.items():
        kept = []
        for _, i, own in sorted(rows):
            if all(overlap(own, k) < 0.30 for k in kept):
                kept.append(own)
                want.add((image, i))
    assert {(r["image"], r["id"]) for r in queries.q_suppress(spark, DATA).collect()} == want
