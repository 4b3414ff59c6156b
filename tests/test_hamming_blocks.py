"""Hamming pairs at a wide radius: buckets and blocks against all with all, and what share of pairs is compared."""

import numpy as np
import pytest

from granary.functions.bits import BITS, MOST, plan, share
from granary.operators.neighbours import hamming_classes, hamming_pairs, near_blocks


def hashes(n: int) -> np.ndarray:
    """Random hashes, near copies of some, equal ones, and hashes of equal bits."""
    rng = np.random.default_rng(n)
    base = rng.integers(0, 2**64, n // 4, dtype=np.uint64)
    near = base[rng.integers(0, len(base), n // 2)]
    for k in range(len(near)):
        for bit in rng.choice(64, int(rng.integers(0, 20)), replace=False):
            near[k] ^= np.uint64(1) << np.uint64(bit)
    return np.concatenate([base, near, base[: n // 8], np.zeros(n // 16, np.uint64), np.full(n // 16, 2**64 - 1, np.uint64)]).view(np.int64)


def all_pairs(ids: list, h: np.ndarray, radius: int) -> list[tuple]:
    far = np.bitwise_count(h.view(np.uint64)[:, None] ^ h.view(np.uint64)[None, :])
    found = ((ids[i], ids[j], int(far[i, j])) for i, j in zip(*np.nonzero(far <= radius), strict=True) if ids[i] < ids[j])
    return sorted(found)


@pytest.mark.parametrize(("radius", "planned", "blocks"), [(9, 500_000, 2), (16, 100_000, 3), (16, 500_000, 1), (16, 3_000_000, 2), (24, 3_000_000, 2)])
def test_blocks_give_each_pair_once(spark, radius, planned, blocks):
    """With bands as for many more rows, whose buckets leave out most pairs."""
    h = hashes(800)
    rows = spark.createDataFrame([(k, int(x)) for k, x in enumerate(h)], "id long, h long")
    got = sorted(tuple(r) for r in near_blocks(rows, plan(planned, radius)[0], blocks, radius).collect())
    assert got == all_pairs(list(range(len(h))), h, radius)


def test_wide_pairs_of_names_nulls_and_repeated_ids(spark):
    h = hashes(200)
    ids = [f"row {k % 190}" for k in range(len(h))]  # as in the SQL, rows of one id make no pair
    rows = spark.createDataFrame([*zip(ids, map(int, h), strict=True), ("none", None)], "id string, h long")
    assert sorted(tuple(r) for r in hamming_pairs(rows, "id", "h", 16).collect()) == all_pairs(ids, h, 16)
    assert hamming_pairs(rows.filter("h IS NULL"), "id", "h", 16).count() == 0


def test_wide_classes(spark):
    h = hashes(200)
    rows = spark.createDataFrame([(k, int(x)) for k, x in enumerate(h)], "id long, h long")
    members, pairs = hamming_classes(rows, "id", "h", 16)
    first = {int(x): k for k, x in reversed(list(enumerate(h)))}
    assert {tuple(r) for r in members.collect()} == {(k, first[int(x)]) for k, x in enumerate(h)}
    alone = sorted(first.values())
    assert sorted(tuple(r) for r in pairs.collect()) == all_pairs(alone, h[alone], 16)


@pytest.mark.parametrize("radius", [9, 16, 24])
@pytest.mark.parametrize("n", [0, 1, 3000, 100_000, 2_600_000, 50_000_000])
def test_plan_is_whole(n, radius):
    """Hashes within the radius can't differ in more than `most` bits in all bands, as that makes over radius bits."""
    bands, blocks = plan(n, radius)
    assert sum(b.most + 1 for b in bands) == radius + 1
    assert [b.lo for b in bands] == [sum(b.width for b in bands[:i]) for i in range(len(bands))] and sum(b.width for b in bands) == BITS
    assert all(b.bits <= b.width for b in bands) and blocks >= 1 and blocks * MOST >= n


def test_wide_join_compares_few_pairs(spark):
    """The join on bands met over half of all pairs at a radius of 16, whatever their number, each as a row of a join."""
    assert sum(share(b.bits, b.most) for b in plan(2_600_000, 16)[0]) < 0.1
    df = hamming_pairs(spark.range(10).selectExpr("id", "xxhash64(id) AS h"), "id", "h", 16)
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
