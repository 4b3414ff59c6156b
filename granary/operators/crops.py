"""Crop plans as column expressions: bounds without other faces, crops by scale, body-aware crops, skip reasons.

A body is a struct of box, confidence and two arrays of structs: `points` (x, y, kind, reach), the reliable landmarks
with kind hand, joint or other and, for wrists, the distance to a reliable elbow; and `bones`, pairs of reliable hand
landmarks (ax, ay, bx, by) that a crop must not part. Everything stays in the row, so no plan shuffles.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.boxes import area, box, expand, intersection, intersects
from granary.functions.signals import training_focus
from granary.sources.folders import written

BOX = "struct<x1:double,y1:double,x2:double,y2:double>"
#: Growth factors of body-aware crops, least share of area a crop must save, least confidence of a body.
FACTORS, LEAST_SAVED, LEAST_CONFIDENCE = (1.0, 1.15, 1.35, 1.60), 0.08, 0.50
#: The sides of training buckets.
SIDES = (512, 768, 1024)


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once: without it, nested plans repeat each other's expressions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def contains(a: Column, b: Column) -> Column:
    return (a["x1"] <= b["x1"]) & (a["y1"] <= b["y1"]) & (a["x2"] >= b["x2"]) & (a["y2"] >= b["y2"])


def clamp(b: Column, width: Column, height: Column) -> Column:
    """A box on whole pixels, inside the image, of one pixel at least; halves round to even."""
    x1 = F.greatest(F.lit(0.0), F.least(width - 1, F.bround(b["x1"])))
    y1 = F.greatest(F.lit(0.0), F.least(height - 1, F.bround(b["y1"])))
    return box(x1, y1, F.greatest(x1 + 1, F.least(width, F.bround(b["x2"]))), F.greatest(y1 + 1, F.least(height, F.bround(b["y2"]))))


def centred(width: Column, height: Column, cx: Column, cy: Column, w: Column, h: Column) -> Column:
    """A box of the wanted size around a point, no larger than the image and shifted into it."""
    w, h = F.least(width, w), F.least(height, h)
    x = F.least(F.greatest(F.lit(0.0), cx - w / 2), width - w)
    y = F.least(F.greatest(F.lit(0.0), cy - h / 2), height - h)
    return let(box(x, y, x + w, y + h), lambda b: clamp(b, width, height))


def no_boxes() -> Column:
    return F.array().cast(f"array<{BOX}>")


def safe_bounds(width: Column, height: Column, target: Column, others: Column, preferred: Column) -> Column:
    """The rectangle that holds the guarded target and none of the padded others, null if there is none.

    Of the largest such rectangles the one that shares most area with `preferred` wins, then the larger one, then the
    one found first. Each obstacle cuts the rectangles left so far on the sides where it leaves the guard whole;
    rectangles inside another one go.
    """
    def cut(bounds: Column, o: Column, guard: Column) -> Column:
        sides = F.array(
            F.when(o["x2"] <= guard["x1"], box(F.greatest(bounds["x1"], F.ceil(o["x2"])), bounds["y1"], bounds["x2"], bounds["y2"])),
            F.when(o["x1"] >= guard["x2"], box(bounds["x1"], bounds["y1"], F.least(bounds["x2"], F.floor(o["x1"])), bounds["y2"])),
            F.when(o["y2"] <= guard["y1"], box(bounds["x1"], F.greatest(bounds["y1"], F.ceil(o["y2"])), bounds["x2"], bounds["y2"])),
            F.when(o["y1"] >= guard["y2"], box(bounds["x1"], bounds["y1"], bounds["x2"], F.least(bounds["y2"], F.floor(o["y1"])))),
        )
        return F.when(intersects(bounds, o), F.array_compact(sides)).otherwise(F.array(bounds))

    def parts(left: Column, o: Column, guard: Column) -> Column:
        return F.array_distinct(F.filter(F.flatten(F.transform(left, lambda b: cut(b, o, guard))), lambda b: contains(b, guard)))

    def largest(parts: Column) -> Column:
        return F.filter(parts, lambda b: ~F.exists(parts, lambda c: (c != b) & contains(c, b)))

    def bounds(v: Column) -> Column:
        def step(left: Column, other: Column) -> Column:
            return let(expand(other, 0.40), lambda o: F.when(intersects(v["guard"], o), no_boxes()).otherwise(let(parts(left, o, v["guard"]), largest)).cast(f"array<{BOX}>"))

        left = F.aggregate(v["others"], F.array(v["frame"]).cast(f"array<{BOX}>"), step)
        ranked = F.transform(left, lambda b, i: F.struct(area(intersection(b, v["preferred"])).alias("shared"), area(b).alias("area"), (-i).alias("i"), b.alias("box")))
        return F.array_max(ranked)["box"]

    frame = box(F.lit(0), F.lit(0), width, height)
    guard = intersection(expand(target, 0.08), frame)
    return let(F.struct(frame.alias("frame"), guard.alias("guard"), F.coalesce(others, no_boxes()).alias("others"), preferred.alias("preferred")), bounds)


def parsing_region(target: Column, width: Column, height: Column) -> Column:
    """A square of 2.8 faces around a face, a little above its middle."""
    face = F.greatest(target["x2"] - target["x1"], target["y2"] - target["y1"])
    return centred(width, height, (target["x1"] + target["x2"]) / 2, (target["y1"] + target["y2"]) / 2 - 0.12 * face, 2.8 * face, 2.8 * face)


def recommended_crop(width: Column, height: Column, target: Column, scale_bin: Column, semantic: Column) -> Column:
    """The crop of a close or medium view around its face or its semantic box; the whole frame of a far one."""
    close = scale_bin == "close"
    face = F.greatest(F.lit(1.0), target["y2"] - target["y1"])

    def by(near: float, mid: float) -> Column:
        return F.when(close, near).otherwise(mid)

    plain = semantic.isNull()
    cx = F.when(plain, (target["x1"] + target["x2"]) / 2).otherwise((semantic["x1"] + semantic["x2"]) / 2)
    top = F.when(plain, target["y1"] - 0.35 * face).otherwise(F.least(semantic["y1"], target["y1"] - 0.20 * face))
    bottom = F.when(plain, target["y2"] + by(0.85, 1.75) * face).otherwise(F.greatest(semantic["y2"], target["y2"] + by(0.75, 1.65) * face))

    def crop(v: Column) -> Column:
        tall = F.greatest(v["bottom"] - v["top"], v["least"])
        return centred(width, height, v["cx"], (v["top"] + v["bottom"]) / 2, tall * v["shape"], tall)

    around = let(F.struct(cx.alias("cx"), top.alias("top"), bottom.alias("bottom"), (face * by(2.2, 3.4)).alias("least"), by(4 / 5, 3 / 4).alias("shape")), crop)
    return F.when(scale_bin == "far", box(F.lit(0), F.lit(0), width, height)).otherwise(around)


def within(b: Column, x: Column, y: Column) -> Column:
    return (b["x1"] <= x) & (x <= b["x2"]) & (b["y1"] <= y) & (y <= b["y2"])


def near_edge(crop: Column, width: Column, height: Column, x: Column, y: Column, margin: Column) -> Column:
    """Whether a point is nearer than the margin to an edge of the crop that isn't the image's own."""
    return (
        ((crop["x1"] > 0) & (x - crop["x1"] < margin)) | ((crop["x2"] < width) & (crop["x2"] - x < margin))
        | ((crop["y1"] > 0) & (y - crop["y1"] < margin)) | ((crop["y2"] < height) & (crop["y2"] - y < margin))
    )


def edge_margin(crop: Column, share: float) -> Column:
    return F.greatest(F.lit(8.0), share * F.least(crop["x2"] - crop["x1"], crop["y2"] - crop["y1"]))


def crop_risks(crop: Column, width: Column, height: Column, semantic: Column, body: Column) -> Column:
    """Sorted reasons why a crop would hurt: fingers cut, a hand near an edge, the head near an edge."""
    m = edge_margin(crop, 0.045)
    head = near_edge(crop, width, height, semantic["x1"], semantic["y1"], m) | near_edge(crop, width, height, semantic["x2"], semantic["y2"], m)

    def hand(p: Column) -> Column:
        room = F.greatest(m, F.coalesce(0.35 * p["reach"], m))
        return (p["kind"] == "hand") & within(crop, p["x"], p["y"]) & near_edge(crop, width, height, p["x"], p["y"], room)

    parted = F.exists(body["bones"], lambda e: within(crop, e["ax"], e["ay"]) != within(crop, e["bx"], e["by"]))
    return F.array_compact(F.array(F.when(parted, "fingers_cut"), F.when(F.exists(body["points"], hand), "hand_near_edge"), F.when(head, "head_near_edge")))


def cuts_joint(crop: Column, width: Column, height: Column, body: Column) -> Column:
    """Whether a joint inside the crop is near its edge: better avoided, but no reason to refuse."""
    m = edge_margin(crop, 0.035)
    return F.exists(body["points"], lambda p: (p["kind"] == "joint") & within(crop, p["x"], p["y"]) & near_edge(crop, width, height, p["x"], p["y"], m))


def body_aware_crop(width: Column, height: Column, target: Column, scale_bin: Column, semantic: Column, body: Column) -> Column:
    """A struct of box, strategy, safety and reasons for the crop of a single person.

    Far views keep the whole frame unless the body's own crop is free of risks and saves enough. Others try growing
    crops and take the first that cuts no joint either, else the last one without risks; they fall back to the frame
    for want of a body, confidence or gain.
    """
    frame = box(F.lit(0), F.lit(0), width, height)

    def gains(b: Column) -> Column:
        return 1 - area(b) / F.greatest(F.lit(1), width * height) >= LEAST_SAVED

    def plan(b: Column, strategy: Column | str, safety: str, reasons: Column | str | None = None) -> Column:
        if isinstance(reasons, str):
            reasons = F.array(F.lit(reasons))
        reasons = F.array().cast("array<string>") if reasons is None else reasons
        return F.struct(b.alias("box"), (F.lit(strategy) if isinstance(strategy, str) else strategy).alias("strategy"), F.lit(safety).alias("safety"), reasons.alias("reasons"))

    def attempts(base: Column) -> Column:
        cx, cy, w, h = (base["x1"] + base["x2"]) / 2, (base["y1"] + base["y2"]) / 2, base["x2"] - base["x1"], base["y2"] - base["y1"]
        return F.transform(F.array(*map(F.lit, FACTORS)), lambda f: let(centred(width, height, cx, cy, w * f, h * f), attempt))

    def attempt(b: Column) -> Column:
        return F.struct(b.alias("box"), crop_risks(b, width, height, semantic, body).alias("risks"), cuts_joint(b, width, height, body).alias("joint"))

    def chosen(tries: Column) -> Column:
        sound = F.filter(tries, lambda t: F.size(t["risks"]) == 0)
        refused = F.filter(tries, lambda t: F.size(t["risks"]) > 0)
        first, last = F.get(F.filter(sound, lambda t: ~t["joint"]), F.lit(0))["box"], F.get(F.reverse(sound), F.lit(0))["box"]
        return let(F.struct(first.alias("first"), last.alias("last"), F.get(F.reverse(refused), F.lit(0))["risks"].alias("risks")), near_plan)

    def near_plan(c: Column) -> Column:
        return (
            F.when(c["first"].isNotNull() & gains(c["first"]), plan(c["first"], aware, "safe"))
            .when(c["first"].isNotNull(), plan(frame, "original_fallback", "safe_original", "crop_gain_too_small"))
            .when(c["last"].isNotNull() & gains(c["last"]), plan(c["last"], aware, "safe", "noncritical_limb_crop"))
            .otherwise(plan(frame, "original_fallback", "warning", F.coalesce(c["risks"], F.array(F.lit("unsafe_crop")))))
        )

    def far_plan(distant: Column) -> Column:
        safe = (body["confidence"] >= LEAST_CONFIDENCE) & (F.size(crop_risks(distant, width, height, semantic, body)) == 0) & gains(distant)
        return F.when(F.coalesce(safe, F.lit(False)), plan(distant, "body_crop_far", "safe")).otherwise(plan(frame, "context_original", "safe_original", "far_view_preserved"))

    aware = F.concat(F.lit("body_aware_smart_"), scale_bin)
    own = body["box"]
    bw, bh = own["x2"] - own["x1"], own["y2"] - own["y1"]
    px, py = F.greatest(F.lit(16.0), 0.15 * bw), F.greatest(F.lit(16.0), 0.10 * bh)
    wide = F.greatest((bh + 2 * py) * 0.75, bw + 2 * px)
    distant = centred(width, height, (own["x1"] + own["x2"]) / 2, (own["y1"] + own["y2"]) / 2, wide, wide / 0.75)
    return (
        F.when(scale_bin == "far", let(distant, far_plan))
        .when(body.isNull(), plan(frame, "original_fallback", "warning", "body_not_found"))
        .when(body["confidence"] < LEAST_CONFIDENCE, plan(frame, "original_fallback", "warning", "pose_uncertain"))
        .otherwise(let(let(recommended_crop(width, height, target, scale_bin, semantic), attempts), chosen))
    )


def skip_reason(target: Column, bounds: Column, bucket: Column, crop: Column, others: Column) -> Column:
    """Why a row gets no crop, null if it gets one; the first that holds."""
    return (
        F.when(target.isNull(), "unreadable_or_missing_target")
        .when(bounds.isNull(), "head_zones_overlap")
        .when(bucket.isNull(), "no_compatible_bucket")
        .when(F.exists(F.coalesce(others, no_boxes()), lambda o: intersects(o, crop)), "other_face_in_crop")
    )


def centred_in(bounds: Column, cx: Column, cy: Column, w: Column, h: Column) -> Column:
    """A box around a point, shifted into the bounds; both edges round to even on their own."""
    left = F.least(F.greatest(bounds["x1"], cx - w / 2), bounds["x2"] - w)
    top = F.least(F.greatest(bounds["y1"], cy - h / 2), bounds["y2"] - h)
    return box(F.bround(left), F.bround(top), F.bround(left + w), F.bround(top + h))


def containing(bounds: Column, required: Column, cx: Column, cy: Column, w: Column, h: Column) -> Column:
    """A box inside the bounds, around a required box and as near a point as can be; null if there is none."""
    x_low, x_high = F.greatest(bounds["x1"], F.ceil(required["x2"] - w)), F.least(bounds["x2"] - w, F.floor(required["x1"]))
    y_low, y_high = F.greatest(bounds["y1"], F.ceil(required["y2"] - h)), F.least(bounds["y2"] - h, F.floor(required["y1"]))
    x, y = F.least(F.greatest(F.bround(cx - w / 2), x_low), x_high), F.least(F.greatest(F.bround(cy - h / 2), y_low), y_high)
    return F.when((x_low <= x_high) & (y_low <= y_high), box(x, y, x + w, y + h))


def shapes(sizes: list[tuple[int, int]]) -> Column:
    """Buckets as an array of structs: sizes, their ratio in whole numbers, the multiple of it that the bucket is, and place."""

    def one(i: int, w: int, h: int) -> Column:
        unit = math.gcd(w, h)
        return F.struct(*(F.lit(float(v)).alias(k) for k, v in (("w", w), ("h", h), ("uw", w // unit), ("uh", h // unit), ("unit", unit))), F.lit(i).alias("i"))

    return F.array(*(one(i, w, h) for i, (w, h) in enumerate(sizes)))


def fit_bucket(crop: Column, bounds: Column, required: Column, least: int = 512, most: int = 1024) -> Column:
    """A struct of box, width and height: a crop grown to the nearest training bucket, never one that needs upscaling.

    Of the buckets that the crop can grow to inside the bounds, in whole multiples of their ratio, the one nearest in
    shape wins, then the smallest growth, then the larger bucket. If there is none and a required box is given, the
    largest box of a bucket's ratio around that box wins which keeps most of the crop. Null if there is none either.
    One expression serves all buckets, so that plans stay small.
    """
    sides = [x for x in SIDES if least <= x <= most]
    buckets = shapes([(w, h) for w in sides for h in sides])

    def size(b: Column) -> list[Column]:
        return [b["x2"] - b["x1"], b["y2"] - b["y1"]]

    def fits(v: Column) -> Column:
        crop, bounds, required = v["crop"], v["bounds"], v["required"]
        cx, cy, around = (crop["x1"] + crop["x2"]) / 2, (crop["y1"] + crop["y2"]) / 2, F.greatest(F.lit(1.0), v["cw"] * v["ch"])

        def miss(s: Column) -> Column:
            return F.round(F.abs(F.log(s["w"] / s["h"] / (v["cw"] / v["ch"]))), 9)

        def sized(s: Column, k: Column) -> Column:
            return F.struct(k.alias("k"), (k * s["uw"]).alias("w"), (k * s["uh"]).alias("h"))

        def found(s: Column, box: Column, *keys: Column) -> Column:
            return F.struct(*(k.alias(f"k{j}") for j, k in enumerate(keys)), s["i"].alias("i"), box.alias("box"), s["w"].cast("int").alias("width"), s["h"].cast("int").alias("height"))

        def grown(s: Column) -> Column:
            def at(z: Column) -> Column:
                return let(centred_in(bounds, cx, cy, z["w"], z["h"]), lambda spot: F.when((z["w"] <= v["bw"]) & (z["h"] <= v["bh"]) & contains(spot, crop), found(s, spot, miss(s), z["w"] * z["h"] / around, -s["w"] * s["h"])))

            return let(sized(s, F.greatest(s["unit"], F.ceil(v["cw"] / s["uw"]).cast("double"), F.ceil(v["ch"] / s["uh"]).cast("double"))), at)

        def trimmed(s: Column) -> Column:
            def kept(spot: Column) -> Column:
                return F.round(area(intersection(spot, crop)) / around, 9)

            def at(z: Column) -> Column:
                return let(containing(bounds, required, cx, cy, z["w"], z["h"]), lambda spot: F.when((z["k"] >= s["unit"]) & spot.isNotNull(), found(s, spot, -kept(spot), miss(s), -(z["w"] * z["h"]), -s["w"] * s["h"])))

            return let(sized(s, F.least(F.floor(v["bw"] / s["uw"]), F.floor(v["bh"] / s["uh"])).cast("double")), at)

        def best(tries: Column) -> Column:
            return let(F.array_min(F.array_compact(tries)), lambda x: F.when(x.isNotNull(), F.struct(x["box"].alias("box"), x["width"].alias("width"), x["height"].alias("height"))))

        return F.coalesce(best(F.transform(buckets, grown)), F.when(required.isNotNull(), best(F.transform(buckets, trimmed))))

    def measured(v: Column) -> Column:
        (cw, ch), (bw, bh) = size(v["crop"]), size(v["bounds"])
        return F.struct(v["crop"].alias("crop"), v["bounds"].alias("bounds"), v["required"].alias("required"), cw.alias("cw"), ch.alias("ch"), bw.alias("bw"), bh.alias("bh"))

    return let(let(F.struct(crop.alias("crop"), bounds.alias("bounds"), required.alias("required")), measured), fits)


def prepare_dataset(rows: DataFrame, least: int = 512, most: int = 1024, confidence: float = LEAST_CONFIDENCE) -> DataFrame:
    """rows with the crop of each: skip (a reason, or null), strategy, safety, reasons, crop, bucket and focus.

    rows has width, height, target (a box or null), others (boxes), semantic (a box or null), body (a struct or null),
    scale_bin, body_focused and mode (standard or tight). All is worked out in the row: nothing is shuffled. Skipped
    rows keep their place, so ranks show holes.
    """
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    others, semantic, target = F.coalesce("others", no_boxes()), F.col("semantic"), F.col("target")
    crowded = F.size(others) > 0
    scale = F.when(crowded & (F.col("scale_bin") == "far"), "medium").otherwise(F.col("scale_bin"))
    tight = F.struct(recommended_crop(w, h, target, F.lit("close"), semantic).alias("box"), F.lit("identity_tight").alias("strategy"), F.lit("safe").alias("safety"), F.array(F.lit("identity_only")).alias("reasons"))
    plan = F.when(F.col("mode") == "tight", tight).otherwise(body_aware_crop(w, h, target, scale, semantic, F.col("body")))
    rows = rows.withColumn("_plan", plan)
    rows = rows.withColumn("_bounds", F.when(target.isNotNull(), safe_bounds(w, h, target, others, F.col("_plan.box"))))
    rows = rows.withColumn("_crop", F.when(crowded & F.col("_bounds").isNotNull(), intersection(F.col("_plan.box"), F.col("_bounds"))).otherwise(F.col("_plan.box")))
    required = F.when(semantic.isNull(), target).otherwise(box(F.least(target["x1"], semantic["x1"]), F.least(target["y1"], semantic["y1"]), F.greatest(target["x2"], semantic["x2"]), F.greatest(target["y2"], semantic["y2"])))
    rows = rows.withColumn("_fit", F.when(F.col("_bounds").isNotNull(), fit_bucket(F.col("_crop"), F.col("_bounds"), required, least, most)))
    crop, name = F.col("_fit.box"), F.concat(F.col("_plan.strategy"), F.when(crowded, "_faces_excluded").otherwise(""), F.when(F.col("_fit.box") != F.col("_crop"), "_bucket_expanded").otherwise(""))
    skip = skip_reason(target, F.col("_bounds"), F.col("_fit.width"), crop, others)
    made = {
        "skip": skip, "strategy": F.when(skip.isNull(), name), "safety": F.when(skip.isNull(), F.col("_plan.safety")),
        "reasons": F.when(skip.isNull(), F.array_join(F.concat(F.col("_plan.reasons"), F.when(crowded, F.array(F.lit("other_faces_excluded"))).otherwise(F.array().cast("array<string>"))), ";")),
        "crop": F.when(skip.isNull(), crop), "bucket": F.when(skip.isNull(), F.concat(F.col("_fit.width").cast("string"), F.lit("x"), F.col("_fit.height").cast("string"))),
        "excluded": F.size(others), "focus": training_focus(F.col("body_focused")),
    }
    return rows.withColumns(made).drop("_plan", "_bounds", "_crop", "_fit")


#: What prepare_dataset adds to rows.
PLANNED = ("skip", "strategy", "safety", "reasons", "crop", "bucket", "excluded", "focus")


def retry_tight(planned: DataFrame, least: int = 512, most: int = 1024) -> DataFrame:
    """The rows of prepare_dataset with `retried`: rows that got no crop are planned once more, tight around the target.

    What then succeeds takes its own place again, rank and all; what doesn't keeps the reason of the first plan. Rows
    that were tight already, or have no target, aren't tried again. Nothing is shuffled; the first plans are written
    once, so that the second ones don't work them out anew.
    """
    planned = written(planned)
    again = F.col("skip").isNotNull() & (F.col("mode") != "tight") & F.col("target").isNotNull()
    kept = planned.filter(~again).withColumn("retried", F.lit(False))
    tight = planned.filter(again).withColumns({"_skip": F.col("skip"), "_mode": F.col("mode"), "mode": F.lit("tight")}).drop(*PLANNED)
    tight = prepare_dataset(tight, least, most).withColumns({"retried": F.col("skip").isNull(), "mode": F.when(F.col("skip").isNull(), "tight").otherwise(F.col("_mode")), "skip": F.when(F.col("skip").isNotNull(), F.col("_skip"))})
    return kept.unionByName(tight.drop("_skip", "_mode"))


def focused_start(total: Column, size: Column, low: Column, high: Column) -> Column:
    """Where a crop of a size begins so that it holds the range from low to high, or stands in its middle."""
    middle = F.bround((low + high - size) / 2)
    inside = F.greatest(F.greatest(F.lit(0.0), F.ceil(high - size)), F.least(F.least(total - size, F.floor(low)), middle))
    return F.when(high - low <= size, inside).otherwise(F.greatest(F.lit(0.0), F.least(total - size, middle)))


def style_plan(width: Column, height: Column, focus: Column, buckets: list[tuple[int, int]]) -> Column:
    """A struct of bucket, crop box and kept area: the bucket whose crop keeps most, then the larger one, then the first.

    The crop stands around the focus box, with a margin of a fortieth of the shorter side, or in the middle for a null
    focus. Null for images that are smaller than all buckets.
    """
    w, h = width.cast("double"), height.cast("double")
    margin = F.least(w, h) * 0.025
    low_x, low_y = (F.when(focus.isNotNull(), F.greatest(F.lit(0.0), focus[c] - margin)) for c in ("x1", "y1"))
    high_x, high_y = F.least(w, focus["x2"] + margin), F.least(h, focus["y2"] + margin)
    image = F.struct(w.alias("w"), h.alias("h"), low_x.alias("low_x"), high_x.alias("high_x"), low_y.alias("low_y"), high_y.alias("high_y"))

    def plans(v: Column) -> Column:
        def start(total: Column, size: Column, low: Column, high: Column) -> Column:
            return F.when(low.isNull(), F.floor((total - size) / 2)).otherwise(focused_start(total, size, low, high))

        def cropped(s: Column) -> Column:
            wide = v["w"] * s["h"] > v["h"] * s["w"]
            cw = F.greatest(F.lit(1.0), F.when(wide, F.floor(v["h"] * s["w"] / s["h"]).cast("double")).otherwise(v["w"]))
            ch = F.greatest(F.lit(1.0), F.when(wide, v["h"]).otherwise(F.floor(v["w"] * s["h"] / s["w"]).cast("double")))
            return let(F.struct(cw.alias("w"), ch.alias("h")), lambda z: placed(s, z))

        def placed(s: Column, z: Column) -> Column:
            corner = F.struct(start(v["w"], z["w"], v["low_x"], v["high_x"]).cast("double").alias("x"), start(v["h"], z["h"], v["low_y"], v["high_y"]).cast("double").alias("y"))
            plan = let(corner, lambda c: F.struct((z["w"] * z["h"]).alias("kept"), (s["w"] * s["h"]).cast("int").alias("size"), (-s["i"]).alias("i"), s["w"].cast("int").alias("width"), s["h"].cast("int").alias("height"), box(c["x"], c["y"], c["x"] + z["w"], c["y"] + z["h"]).alias("box")))
            return F.when((v["w"] >= s["w"]) & (v["h"] >= s["h"]), plan)

        return F.array_max(F.array_compact(F.transform(shapes(buckets), cropped)))

    return let(image, plans)
