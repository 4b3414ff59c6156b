"""The crop queries over all rows against a plain version, image by image."""

import math
from collections import Counter

from conftest import DATA

from granary.plans import media, queries

SIDES = (512, 768, 1024)


def area(b):
    return max(0.0, b[2] - b[0]) * max(0.0, b[3] - b[1])


def common(a, b):
    return max(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), min(a[3], b[3])


def meets(a, b):
    return a[0] < b[2] and b[0] < a[2] and a[1] < b[3] and b[1] < a[3]


def holds(a, b):
    return a[0] <= b[0] and a[1] <= b[1] and a[2] >= b[2] and a[3] >= b[3]


def grown(b, share):
    by = max(4, share * max(b[2] - b[0], b[3] - b[1]))
    return b[0] - by, b[1] - by, b[2] + by, b[3] + by


def centred(w, h, cx, cy, bw, bh):
    bw, bh = min(w, bw), min(h, bh)
    x, y = min(max(0, cx - bw / 2), w - bw), min(max(0, cy - bh / 2), h - bh)
    x1, y1 = max(0, min(w - 1, round(x))), max(0, min(h - 1, round(y)))
    return x1, y1, max(x1 + 1, min(w, round(x + bw))), max(y1 + 1, min(h, round(y + bh)))


def safe_bounds(w, h, target, others, preferred):
    guard, left = common(grown(target, 0.08), (0, 0, w, h)), [(0, 0, w, h)]
    for o in (grown(o, 0.40) for o in others):
        if meets(guard, o):
            return None
        parts = []
        for b in left:
            if not meets(b, o):
                parts.append(b)
                continue
            parts += [(max(b[0], math.ceil(o[2])), b[1], b[2], b[3])] if o[2] <= guard[0] else []
            parts += [(b[0], b[1], min(b[2], math.floor(o[0])), b[3])] if o[0] >= guard[2] else []
            parts += [(b[0], max(b[1], math.ceil(o[3])), b[2], b[3])] if o[3] <= guard[1] else []
            parts += [(b[0], b[1], b[2], min(b[3], math.floor(o[1])))] if o[1] >= guard[3] else []
        parts = list(dict.fromkeys(p for p in parts if holds(p, guard)))
        left = [p for p in parts if not any(q != p and holds(q, p) for q in parts)]
    return max(left, key=lambda b: (area(common(b, preferred)), area(b), -left.index(b)), default=None)


def recommended(w, h, t, scale):
    if scale == "far":
        return 0, 0, w, h
    face, close = max(1, t[3] - t[1]), scale == "close"
    top, bottom = t[1] - 0.35 * face, t[3] + (0.85 if close else 1.75) * face
    tall = max(bottom - top, face * (2.2 if close else 3.4))
    return centred(w, h, (t[0] + t[2]) / 2, (top + bottom) / 2, tall * (4 / 5 if close else 3 / 4), tall)


def body_aware(w, h, t, scale, body):
    """Without points and bones nothing is at risk, so the first attempt is the one."""
    frame, gains = (0, 0, w, h), lambda b: 1 - area(b) / max(1, w * h) >= 0.08
    if scale == "far":
        if body:
            bw, bh = body[2] - body[0], body[3] - body[1]
            wide = max((bh + 2 * max(16, 0.10 * bh)) * 0.75, bw + 2 * max(16, 0.15 * bw))
            far = centred(w, h, (body[0] + body[2]) / 2, (body[1] + body[3]) / 2, wide, wide / 0.75)
            if gains(far):
                return far, "body_crop_far", "safe", []
        return frame, "context_original", "safe_original", ["far_view_preserved"]
    if not body:
        return frame, "original_fallback", "warning", ["body_not_found"]
    b = recommended(w, h, t, scale)
    b = centred(w, h, (b[0] + b[2]) / 2, (b[1] + b[3]) / 2, b[2] - b[0], b[3] - b[1])
    return (b, f"body_aware_smart_{scale}", "safe", []) if gains(b) else (frame, "original_fallback", "safe_original", ["crop_gain_too_small"])


def fit(crop, bounds, required):
    cw, ch, bw, bh = crop[2] - crop[0], crop[3] - crop[1], bounds[2] - bounds[0], bounds[3] - bounds[1]
    cx, cy, grow, trim = (crop[0] + crop[2]) / 2, (crop[1] + crop[3]) / 2, [], []
    for i, (w, h) in enumerate((w, h) for w in SIDES for h in SIDES):
        unit = math.gcd(w, h)
        uw, uh = w // unit, h // unit
        miss = round(abs(math.log(w / h / (cw / ch))), 9)
        k = max(unit, math.ceil(cw / uw), math.ceil(ch / uh))
        left, top = min(max(bounds[0], cx - k * uw / 2), bounds[2] - k * uw), min(max(bounds[1], cy - k * uh / 2), bounds[3] - k * uh)
        spot = (round(left), round(top), round(left + k * uw), round(top + k * uh))
        if k * uw <= bw and k * uh <= bh and holds(spot, crop):
            grow.append((miss, k * uw * k * uh / max(1.0, cw * ch), -w * h, i, spot, (w, h)))
        k = min(math.floor(bw / uw), math.floor(bh / uh))
        xs, ys = (max(bounds[0], math.ceil(required[2] - k * uw)), min(bounds[2] - k * uw, math.floor(required[0]))), (max(bounds[1], math.ceil(required[3] - k * uh)), min(bounds[3] - k * uh, math.floor(required[1])))
        if k >= unit and xs[0] <= xs[1] and ys[0] <= ys[1]:
            x, y = min(max(round(cx - k * uw / 2), xs[0]), xs[1]), min(max(round(cy - k * uh / 2), ys[0]), ys[1])
            spot = (x, y, x + k * uw, y + k * uh)
            trim.append((-round(area(common(spot, crop)) / max(1.0, cw * ch), 9), miss, -k * uw * k * uh, -w * h, i, spot, (w, h)))
    best = min(grow or trim, default=None)
    return best[-2:] if best else (None, None)


def prepared(r, mode=None):
    w, h, t, others = r["width"], r["height"], r["target"] and tuple(r["target"]), [tuple(o) for o in r["others"]]
    tail = (len(others), "body" if r["body_focused"] else "identity")
    if t is None:
        return ("unreadable_or_missing_target", None, None, None, None, None, *tail)
    scale = "medium" if others and r["scale_bin"] == "far" else r["scale_bin"]
    if (mode or r["mode"]) == "tight":
        box, strategy, safety, reasons = recommended(w, h, t, "close"), "identity_tight", "safe", ["identity_only"]
    else:
        box, strategy, safety, reasons = body_aware(w, h, t, scale, r["body"] and tuple(r["body"]["box"]))
    bounds = safe_bounds(w, h, t, others, box)
    if bounds is None:
        return ("head_zones_overlap", None, None, None, None, None, *tail)
    crop = common(box, bounds) if others else box
    spot, size = fit(crop, bounds, t)
    if spot is None or any(meets(o, spot) for o in others):
        return ("no_compatible_bucket" if spot is None else "other_face_in_crop", None, None, None, None, None, *tail)
    strategy += "_faces_excluded" * bool(others) + "_bucket_expanded" * (tuple(spot) != tuple(crop))
    return (None, strategy, safety, ";".join(reasons + ["other_faces_excluded"] * bool(others)), f"{size[0]}x{size[1]}", tuple(map(float, spot)), *tail)


def test_crop_plans(spark):
    rows = {r["image"]: prepared(r) for r in media._crop_rows(spark, DATA).collect()}
    got = {r["image"]: (r["skip"], r["strategy"], r["safety"], r["reasons"], r["bucket"], None if r["x1"] is None else (r["x1"], r["y1"], r["x2"], r["y2"]), r["excluded"], r["focus"]) for r in media.q_crop_plan(spark, DATA).collect()}
    assert got == rows and len({x[0] for x in rows.values()}) >= 4 and len({x[1] for x in rows.values()}) >= 6
    counts = Counter((x[0] or "", x[1] or "") for x in rows.values())
    assert {(r["skip"], r["strategy"]): r["n"] for r in media.q_crop_skips(spark, DATA).collect()} == counts


def test_safe_bounds_of_all_images(spark):
    def plain(r):
        t = tuple(r["target"])
        face = max(t[2] - t[0], t[3] - t[1])
        return safe_bounds(1200, 1000, t, [tuple(o) for o in r["others"]], centred(1200, 1000, (t[0] + t[2]) / 2, (t[1] + t[3]) / 2 - 0.12 * face, 2.8 * face, 2.8 * face))

    rows = {r["image"]: plain(r) for r in media._crop_rows(spark, DATA).collect() if r["target"]}
    got = {r["image"]: None if r["x1"] is None else (r["x1"], r["y1"], r["x2"], r["y2"]) for r in queries.q_safe_bounds(spark, DATA).collect()}
    assert {k: v for k, v in got.items() if k in rows} == rows and None in rows.values() and len(rows) > 1000


def test_tight_retry_of_all_images(spark):
    want = {}
    for r in media._crop_rows(spark, DATA).collect():
        first, again = prepared(r), prepared(r, "tight")
        retried = first[0] is not None and r["mode"] != "tight" and r["target"] is not None and again[0] is None
        x = again if retried else first
        want[r["image"]] = (x[0], x[1], x[4], x[5], retried)
    got = {r["image"]: (r["skip"], r["strategy"], r["bucket"], None if r["x1"] is None else (r["x1"], r["y1"], r["x2"], r["y2"]), r["retried"]) for r in media.q_tight_retry(spark, DATA).collect()}
    assert got == want and any(x[4] for x in want.values()) and any(x[0] for x in want.values())
