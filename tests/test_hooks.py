"""Detectors, tensors, grids and joins on time against plain versions."""

import math

import numpy as np
import pandas as pd
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from granary.functions.boxes import kept_percent
from granary.functions.grids import blur, gradient_hash, resampled
from granary.functions.tensors import decoded, suppressed
from granary.operators.intime import nearest_in_time, pairs_within, sampled_frames
from granary.sources.detectors import detected, register_detector
from granary.sources.media import Stage, with_stages


def test_detector_rows(spark):
    """Several rows of one, none of one, error rows; the model is opened once a task."""

    def open_detector():
        opened = []

        def detect(n):
            opened.append(n)
            for k in range(n):
                if n == 4 and k == 2:
                    raise ValueError("four")
                yield k * 10, len(opened)

        return detect

    register_detector(spark, "counted", open_detector, "value int, seen int")
    rows = spark.createDataFrame([(0,), (1,), (2,), (4,)], "n int").coalesce(1)
    got = sorted((r["n"], r["det"], r["error"], r["value"]) for r in detected(rows, "counted", "n").collect())
    assert got == [(1, 0, None, 0), (2, 0, None, 0), (2, 1, None, 10), (4, -1, "ValueError: four", None)]
    assert max(r["seen"] for r in detected(rows, "counted", "n").collect() if r["seen"]) > 1
    assert detected(rows, "counted", "n", outer=True).filter("n = 0 and det is null").count() == 1

    def no_model():
        raise MemoryError("none")

    register_detector(spark, "closed", no_model, "value int")
    assert {r["error"] for r in detected(rows, "closed", "n").collect()} == {"MemoryError: none"}


def plain_decode(t, n, classes, width, height, scale, pads, offset, overlap):
    t, found = np.array(t).reshape(4 + classes, n), []
    for i in range(n):
        c = int(t[4:, i].argmax())
        (cx, cy, w, h), score = t[:4, i], t[4 + c, i]
        x1, x2 = max(0, round((cx - w / 2 - pads[0]) / scale)), min(width, round((cx + w / 2 - pads[0]) / scale))
        y1, y2 = max(0, round((cy - h / 2 - pads[1]) / scale)), min(height, round((cy + h / 2 - pads[1]) / scale))
        if score >= 0.25 and x2 > x1 and y2 > y1:
            found.append((float(score), c, (x1 + offset[0], y1 + offset[1], x2 + offset[0], y2 + offset[1])))
    kept = []
    for score, c, b in sorted(found, key=lambda x: -x[0]):
        if all(max(0, min(b[2], k[2]) - max(b[0], k[0])) * max(0, min(b[3], k[3]) - max(b[1], k[1])) <= overlap * (area(b) + area(k) - max(0, min(b[2], k[2]) - max(b[0], k[0])) * max(0, min(b[3], k[3]) - max(b[1], k[1]))) for _, _, k in kept):
            kept.append((score, c, b))
    return kept


def area(b):
    return (b[2] - b[0]) * (b[3] - b[1])


@pytest.mark.parametrize("by_box", [False, True])
def test_decode(spark, by_box):
    rng, n, classes, rows = np.random.default_rng(5), 30, 6, []
    for i in range(20):
        t = np.concatenate([rng.uniform(0, 320, (2, n)), rng.uniform(1, 150, (2, n)), rng.uniform(0, 0.6, (classes, n)).round(2)])
        rows.append((i, (t.T if by_box else t).ravel().tolist(), t.ravel().tolist()))
    frame = spark.createDataFrame([r[:2] for r in rows], "i int, t array<double>")
    found = decoded(F.col("t"), n, classes, F.lit(300.0), F.lit(200.0), 0.9, 4.0, 30.0, 7.0, 9.0, by_box=by_box)
    for r in frame.select("i", suppressed(found).alias("d")).collect():
        want = plain_decode(rows[r["i"]][2], n, classes, 300, 200, 0.9, (4, 30), (7, 9), 0.45)
        assert [(d["score"], d["class_id"], tuple(d["box"])) for d in r["d"]] == want
    each = frame.select(F.size(suppressed(found, by_class=True)).alias("n"), F.size(suppressed(found)).alias("m")).collect()
    assert all(r["n"] >= r["m"] for r in each) and any(r["n"] > r["m"] for r in each)
    odd = spark.createDataFrame([([1.0],)], "t array<double>")
    with pytest.raises(Exception, match="a tensor of"):
        odd.select(decoded(F.col("t"), 8, 4, F.lit(9.0), F.lit(9.0)).alias("d")).collect()
    assert odd.select(decoded(F.lit(None).cast("array<double>"), 8, 4, F.lit(9.0), F.lit(9.0)).alias("d")).first()["d"] is None


@pytest.mark.parametrize(("w", "h"), [(9, 8), (18, 16), (31, 23), (10, 40)])
def test_grids(spark, w, h):
    """Fractional areas, mirrored edges, the highest bit first."""
    g = np.random.default_rng(w).integers(0, 256, (h, w))
    rows = spark.createDataFrame([(g.ravel().tolist(),), ([7] * (w * h),), ([],), (None,)], "g array<int>")
    got = rows.select(resampled(F.col("g"), F.lit(w), F.lit(h), 9, 8).alias("s"), gradient_hash(F.col("g"), F.lit(w), F.lit(h)).alias("k"), blur(F.col("g"), F.lit(w), F.lit(h)).alias("b")).collect()

    def share(to, size):  # how much of each pixel each cell covers
        return np.array([[max(0.0, min((c + 1) * size / to, x + 1) - max(c * size / to, x)) for x in range(size)] for c in range(to)])

    small = share(8, h) @ g @ share(9, w).T / (w / 9 * h / 8)
    assert np.abs(np.array(got[0]["s"]).reshape(8, 9) - small).max() <= 0.5 + 1e-9
    own = np.array(got[0]["s"]).reshape(8, 9)
    bits = int("".join("01"[int(x)] for x in (own[:, 1:] >= own[:, :-1]).ravel()), 2)
    assert got[0]["k"] % 2**64 == bits and got[1]["k"] == -1 and got[2]["k"] is got[3]["k"] is None
    p = np.pad(g, 1, mode="reflect")
    lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g
    assert math.isclose(got[0]["b"], math.log1p(lap.var())) and got[1]["b"] == 0 and got[2]["b"] == 0 and got[3]["b"] is None


def test_nearest_in_time(spark):
    """A hot key over many bins and empty bins, ties, rows of one time, keys without rows, nulls."""
    rng = np.random.default_rng(2)
    rows = [(1, float(t) / 4, int(v)) for t, v in zip(rng.integers(0, 2000, 400), rng.integers(0, 99, 400), strict=True)] + [(1, 5000.0, 7), (2, 10.0, 3), (2, 10.0, 1), (None, 1.0, 1), (2, None, 1)]
    points = [(1, float(t) / 8, i) for i, t in enumerate(rng.integers(-400, 48_000, 300))] + [(2, 10.0, 900), (2, -99.0, 901), (3, 5.0, 902), (None, 5.0, 903), (1, None, 904), (1, 5000.0, 905)]
    got = nearest_in_time(spark.createDataFrame(points, "k int, t double, p int"), spark.createDataFrame(rows, "k int, t double, v int"), "k", "t", "v", 16.0)

    def plain(k, t):
        own = [(abs(t - x[1]), x[1], x[2]) for x in rows if k is not None and t is not None and x[0] == k and x[1] is not None]
        return min(own)[1:] if own else (None, None)

    assert rows_of(got) == rows_of(spark.createDataFrame([(*p, *plain(*p[:2])) for p in points], "k int, t double, p int, near_time double, near int"))


def test_pairs_within(spark):
    """Each pair once, on a hot key, over the edges of bins and before zero."""
    rng = np.random.default_rng(3)
    rows = [(1, float(t) / 10, i) for i, t in enumerate(rng.integers(-300, 300, 250))] + [(2, 0.0, 1000), (2, 1.4999, 1001), (2, 1.5, 1002), (None, 0.0, 1), (2, None, 2)]
    got = {(r["k"], r["left"], r["right"]) for r in pairs_within(spark.createDataFrame(rows, "k int, t double, v int"), "k", "t", "v", 1.5).collect()}
    want = {(a[0], a[2], b[2]) for a in rows for b in rows if a[0] == b[0] and None not in (*a, *b) and (b[1], b[2]) > (a[1], a[2]) and b[1] - a[1] < 1.5}
    assert got == want and (2, 1000, 1001) in got and (2, 1000, 1002) not in got


def test_sources_without_duration(spark):
    frames = spark.createDataFrame([("a", 5.0, i) for i in range(70)] + [("b", 1.0, 1), ("b", 9.0, 2)], "source string, seconds double, id int")
    got = sorted((r["source"], r["i"], r["id"]) for r in sampled_frames(frames).collect())
    assert got == [("a", 0, 0), ("a", 1, 30), ("a", 2, 60), ("b", 0, 1), ("b", 1, 1), ("b", 2, 2), ("b", 3, 2)]


def test_kept_percent(spark):
    """As a double's own digits round: halves that are exact go to even, others to the nearer side."""
    cases = [(90625, 100000), (1, 8), (1, 3), (2675, 100000), (99999, 100000), (1, 1), (105, 1600), (11500, 100000), (1, 100)]
    rows = spark.createDataFrame(cases, "a long, b long")
    assert [r["p"] for r in rows.select(kept_percent(F.col("a"), F.col("b")).alias("p")).collect()] == [f"{100.0 * a / b:.2f}" for a, b in cases]


def test_stages(spark):
    """Models see only what their gates let through; errors stay with their rows, and later stages go on."""

    def open_first():
        def first(part):
            if (part["n"] == 13).any():
                raise ValueError("thirteen")
            return pd.DataFrame({"a": part["n"] * 10})

        return first

    def closed():
        raise MemoryError("none")

    stages = [Stage(lambda p: p["n"] % 2 == 1, open_first, "a long"), Stage(lambda p: p["a"].notna(), lambda: lambda p: pd.DataFrame({"b": p["a"] + 1}), "b long"), Stage(lambda p: p["n"] == 2, closed, "c string")]
    rows = spark.createDataFrame([(n, None if n == 4 else "x") for n in range(6)], "n long, t string")
    got = sorted(map(tuple, with_stages(rows.coalesce(1), stages).collect()))
    assert got == [(n, None if n == 4 else "x", n * 10 if n % 2 else None, n * 10 + 1 if n % 2 else None, None, "stage 2: MemoryError: none" if n == 2 else None) for n in range(6)]
    bad = with_stages(spark.createDataFrame([(13, "x"), (2, "y")], "n long, t string").coalesce(1), stages[:2]).collect()
    assert sorted((r["n"], r["a"], r["stage_error"]) for r in bad) == [(2, None, None), (13, None, "stage 0: ValueError: thirteen")]
    assert with_stages(rows.limit(0), stages).count() == 0
