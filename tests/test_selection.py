"""Selection by cell heads, policies and backfill against plain loops over all rows."""

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from granary.operators.select import SelectOptions, backfill, greedy_select, select_with_policy
from granary.plans.queries import candidates

POOL = "media_id long, similarity double, quality_score double, base double, image_hash long, scale_bin string, pose_bin string, light_bin string, has_appearance boolean, body_focused boolean"


def plain(rows, options, seeds=(), excluded=()):
    """The turns as they are defined, over the whole pool each time."""
    by_id = {r["media_id"]: r for r in rows}
    picks, pool = [by_id[s] for s in seeds if s in by_id], [r for r in rows if r["media_id"] not in excluded]
    size, bodies = len(pool), sum(r["body_focused"] for r in pool)
    quota = min(bodies, round(options.quota_share * min(options.count, size)))

    def key(r):
        n = lambda c: sum(p[c] == r[c] for p in picks)
        near, light = (0.90, 0.02) if r["has_appearance"] else (0.75, 0.05)
        bonus = options.diversity * 1.0 * (1 / (1 + n("scale_bin"))) + options.diversity * 0.45 * (1 / (1 + n("pose_bin")))
        u = Decimal(repr(near * r["base"] + bonus + light * (1 / (1 + n("light_bin"))))).quantize(Decimal("1e-9"), ROUND_HALF_UP)
        return u, -1.0 if r["similarity"] is None else r["similarity"], r["quality_score"], -r["media_id"]

    def near(a, b):
        distance = 64 if a["image_hash"] is None or b["image_hash"] is None else ((a["image_hash"] ^ b["image_hash"]) & (2**64 - 1)).bit_count()
        return options.duplicate_bits >= 0 and distance <= options.duplicate_bits

    while len(picks) < min(options.count, size):
        left = [r for r in pool if r["media_id"] not in {p["media_id"] for p in picks} and not any(near(r, p) for p in picks)]
        body = [r for r in left if r["body_focused"]] if sum(bool(p["body_focused"]) for p in picks) < quota else []
        if not left:
            break
        picks.append(max(body or left, key=key))
    return [p["media_id"] for p in picks]


def ids(frame):
    return [r["media_id"] for r in frame.orderBy("rank").collect()]


@pytest.mark.parametrize(("seed", "bits", "heads"), [(1, 6, 32), (2, 6, 1), (3, -1, 2), (4, 20, 2), (5, 64, 3)])
def test_picks_are_those_of_the_loop(spark, seed, bits, heads):
    """Few cells with many near duplicates, ties in base, similarity and quality, null hashes and similarities."""
    rng, rows = np.random.default_rng(seed), []
    bases = [int(x) for x in rng.integers(0, 2**62, 5)]
    for i in range(300):
        h = None if i % 41 == 0 else bases[i % 5] ^ sum(1 << int(b) for b in rng.choice(60, int(rng.integers(0, 9)), replace=False))
        rows.append((i, None if i % 53 == 0 else float(rng.integers(0, 5)) / 5, float(rng.integers(0, 3)) / 3, float(rng.integers(0, 40)) / 40, h, "far" if i % 7 == 0 else "close", "frontal", ["dark", "normal"][i % 2], i % 3 == 0, i % 14 == 0))
    frame, options = spark.createDataFrame(rows, POOL), SelectOptions(25, bits)
    out = spark.createDataFrame([(3,), (9,), (14,)], "media_id long")
    assert ids(greedy_select(frame, options, heads=heads)) == plain(frame.collect(), options)
    assert ids(greedy_select(frame, options, [14, 5, 9999], out, heads)) == plain(frame.collect(), options, [14, 5, 9999], {3, 9, 14})


def test_shortfall(spark):
    rows = [(k, 0.9, 0.5, 0.9 - k / 100, (k * 0x9E3779B97F4A7C15) % 2**62, "close", "frontal", "normal", False, False, "eligible" if k < 3 else "rejected" if k < 8 else "multiple_faces_review", k > 4) for k in range(10)]
    frame = spark.createDataFrame(rows, POOL + ", status string, fallback_eligible boolean")
    few, more = SelectOptions(3, -1), SelectOptions(9, -1)
    assert ids(select_with_policy(frame, few, "fill")) == ids(select_with_policy(frame, more)) == [0, 1, 2]
    assert ids(select_with_policy(frame, more, "fill")) == [0, 1, 2, 5, 6, 7]
    assert select_with_policy(frame.limit(0), more, "fill").count() == 0
    for wrong in ({"count": 0}, {"duplicate_bits": 65}, {"diversity": -0.1}, {"quota_share": 1.1}):
        with pytest.raises(ValueError, match="must"):
            SelectOptions(**wrong)
    with pytest.raises(ValueError, match="shortfall"):
        select_with_policy(frame, more, "prompt")


def test_backfill_over_all_candidates(spark):
    """The whole table: holes of rows with several faces, filled turn by turn as a plain loop fills them."""
    pool = candidates(spark, DATA).filter("status = 'eligible'").persist()
    rows, options = pool.collect(), SelectOptions(30)
    slots, failed = plain(rows, options), set()
    good = {r["media_id"] for r in rows if r["face_count"] == 1}
    failed |= set(slots) - good
    slots = [k if k in good else None for k in slots]
    while None in slots:
        current = [k for k in slots if k is not None]
        tries = plain(rows, options, current, failed)[len(current) :][: slots.count(None)]
        if not tries:
            break
        for hole, k in zip([i for i, x in enumerate(slots) if x is None], tries, strict=False):
            slots[hole] = k if k in good else None
        failed |= set(tries) - good
    got = {r["rank"]: r["media_id"] for r in backfill(pool, greedy_select(pool, options), lambda part: part.filter(F.col("face_count") == 1), options).collect()}
    assert got == {i + 1: k for i, k in enumerate(slots) if k is not None} and failed
    pool.unpersist()
