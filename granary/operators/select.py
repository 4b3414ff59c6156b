"""Greedy diverse selection over a distributed pool."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce
from itertools import takewhile
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.functions.vectors import hamming


@dataclass(frozen=True)
class SelectOptions:
    count: int = 20
    duplicate_bits: int = 6
    diversity: float = 0.22
    quota_share: float = 0.30

    def __post_init__(self) -> None:
        if self.count < 1:
            raise ValueError("count must be 1 or more")
        if not -1 <= self.duplicate_bits <= 64:
            raise ValueError("duplicate_bits must lie between -1 and 64")
        if self.diversity < 0 or not 0 <= self.quota_share <= 1:
            raise ValueError("diversity must not be negative, and quota_share a share")


#: Bins whose rare values earn a bonus, as shares of the diversity; those of the second kind give none where unknown.
BINS, MINOR = {"scale_bin": 1.0, "pose_bin": 0.45}, {"minor_a": 0.15, "minor_b": 0.10}


#: Rows of a cell that reach the driver at first; where near duplicates use them up, twice as many each time.
HEADS = 32


def greedy_select(pool: DataFrame, options: SelectOptions = SelectOptions(), seeds: list | None = None, excluded: DataFrame | None = None, heads: int = HEADS) -> DataFrame:
    """media_id and rank (from 1) of up to `count` picks; pool has media_id, similarity, quality_score, base, image_hash,
    scale_bin, pose_bin, light_bin, has_appearance and body_focused, and may have minor_a and minor_b.

    Each turn takes the candidate of the best utility: its base score and bonuses for bins that were picked seldom.
    Near duplicates of any pick are out, and so are the ids of `excluded`. While the quota of body-focused rows isn't
    met, only those are looked at, if there are any. Ties go to the higher similarity, then quality, then the smaller
    id. Seeds are picked first, in their order, whether or not they are excluded.

    Rows that agree in all bins form a cell: their bonuses are the same whatever was picked, so within a cell the
    utility rises with the base score, and only a cell's best rows that aren't near duplicates can win. The pool is
    counted, then read once: each task keeps the first `heads` rows of its cells, and those of each cell reach the driver, which picks.
    Only where near duplicates use up a cell's rows are more of them asked for. Cells are as many as bins allow.
    """
    minor = {k: v for k, v in MINOR.items() if k in pool.columns}
    names = ("media_id", "similarity", "quality_score", "base", "image_hash", *BINS, "light_bin", "has_appearance", "body_focused", *minor)
    all_ = pool.select(*names)
    first = {r["media_id"]: r for r in all_.filter(F.col("media_id").isin(list(seeds))).collect()} if seeds else {}
    pool = all_ if excluded is None else all_.join(excluded.select("media_id"), "media_id", "left_anti")
    picks = Picks(pool, options, minor, heads).run([first[k] for k in seeds or [] if k in first])
    return pool.sparkSession.createDataFrame([(r["media_id"], i + 1) for i, r in enumerate(picks)], "media_id long, rank int")


class Picks:
    """The driver's part of one selection: the best rows of each cell, and how often each bin's value was picked."""

    def __init__(self, pool: DataFrame, options: SelectOptions, minor: dict[str, float], heads: int):
        self.pool, self.options, self.minor, self.heads = pool, options, minor, heads
        self.cell = [*BINS, "light_bin", "has_appearance", "body_focused", *minor]
        self.seen: dict[str, dict] = {name: {} for name in (*BINS, "light_bin", *minor)}
        self.picks: list = []
        #: Of each cell the best rows that may still be picked, and whether there are more.
        self.rows: dict[tuple, list] = {}
        self.more: dict[tuple, int] = {}

    def run(self, seeds: list) -> list:
        for row in seeds:
            self.add(row)
        size, bodies = self.pool.agg(F.count("*"), F.count_if("body_focused")).first()
        self.fetch(self.pool, self.heads)
        quota = min(bodies, round(self.options.quota_share * min(self.options.count, size)))
        met = sum(bool(r["body_focused"]) for r in seeds)
        while len(self.picks) < min(self.options.count, size):
            best = [x for x in map(self.best_of, list(self.rows)) if x]
            focused = [x for x in best if x[1]["body_focused"]] if met < quota else []
            if not best:
                break
            _, row = max(focused or best, key=lambda x: x[0])
            self.add(row)
            met += bool(row["body_focused"])
        return self.picks

    def add(self, row) -> None:
        self.picks.append(row)
        for name, counts in self.seen.items():
            counts[row[name]] = counts.get(row[name], 0) + 1
        self.rows = {cell: [r for r in rows if not self.near(r, row)] for cell, rows in self.rows.items()}

    def near(self, row, pick) -> bool:
        if row["media_id"] == pick["media_id"]:
            return True
        if None in (row["image_hash"], pick["image_hash"]):
            return self.options.duplicate_bits >= 64
        return ((row["image_hash"] ^ pick["image_hash"]) & (2**64 - 1)).bit_count() <= self.options.duplicate_bits

    def fetch(self, pool: DataFrame, n: int) -> None:
        """The n best rows of each cell of the pool that are no near duplicates of picks."""
        if self.picks:
            pool = pool.filter(~F.col("media_id").isin([r["media_id"] for r in self.picks]))
        if self.options.duplicate_bits >= 0:
            for pick in self.picks:
                pool = pool.filter(hamming(F.col("image_hash"), F.lit(pick["image_hash"]).cast("long")) > self.options.duplicate_bits)
        order = Window.partitionBy(*self.cell).orderBy(F.desc("base"), F.desc("similarity"), F.desc("quality_score"), "media_id")
        for row in pool.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= n).orderBy(*self.cell, "_place").collect():
            cell = tuple(row[c] for c in self.cell)
            self.rows.setdefault(cell, []).append(row)
            if row["_place"] == n:
                self.more[cell] = n

    def best_of(self, cell: tuple):
        """The best row of a cell, after its key: utility in nine decimals, similarity, quality, smaller id; None if it has none."""
        while True:
            rows = self.rows[cell]
            top = self.utility(rows[0]) if rows else None
            same = list(takewhile(lambda r: self.utility(r) == top, rows))
            if len(same) < len(rows) or cell not in self.more:
                break
            n = 2 * self.more.pop(cell)  # all that is here is used up or alike: more may be as good
            self.rows[cell] = []
            match = [F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(self.cell, cell, strict=True)]
            self.fetch(self.pool.filter(reduce(and_, match)), n)
        keyed = [((top, *(-math.inf if r[c] is None else r[c] for c in ("similarity", "quality_score")), -r["media_id"]), r) for r in same]
        return max(keyed, key=lambda x: x[0], default=None)

    def utility(self, row) -> Decimal:
        if row["base"] is None:
            return Decimal("-Infinity")
        d, rare = self.options.diversity, {name: 1 / (1 + counts.get(row[name], 0)) for name, counts in self.seen.items()}
        bonus = sum((d * share * rare[name] for name, share in BINS.items()), 0.0)
        for name, share in self.minor.items():
            bonus += 0.0 if (row[name] or "unknown") == "unknown" else d * share * rare[name]
        near, light = (0.90, 0.02) if row["has_appearance"] else (0.75, 0.05)
        return Decimal(repr(near * row["base"] + bonus + light * rare["light_bin"])).quantize(Decimal("1e-9"), ROUND_HALF_UP)


def select_with_policy(candidates: DataFrame, options: SelectOptions = SelectOptions(), shortfall: str = "strict", excluded: DataFrame | None = None) -> DataFrame:
    """The selection of strong candidates; candidates has status and fallback_eligible beside what greedy_select reads.

    Only eligible rows are looked at, and none that waits for review. If they don't reach `count`, `strict` leaves it so,
    and `fill` selects anew from eligible and fallback rows together.
    """
    if shortfall not in ("strict", "fill"):
        raise ValueError(f"shortfall is strict or fill, not {shortfall}")
    strong = F.col("status") == "eligible"
    found = greedy_select(candidates.filter(strong), options, excluded=excluded)
    if shortfall == "strict" or found.count() >= options.count:
        return found
    weak = F.col("fallback_eligible") & (F.col("status") != "multiple_faces_review")
    return greedy_select(candidates.filter(strong | weak), options, excluded=excluded)


def backfill(pool: DataFrame, picks: DataFrame, prepare: Callable[[DataFrame], DataFrame], options: SelectOptions = SelectOptions()) -> DataFrame:
    """media_id and rank of the picks that could be prepared, their holes filled with further candidates while any are left.

    prepare takes the pool's rows of some picks and returns the media_id of those that succeed. Failed ones are never
    tried again. Each turn selects with what is there as seeds and tries as many newcomers as there are holes: slots
    and failures, at most the pool's turns, pass through the driver, the pool stays in tasks.
    """
    spark, pool = pool.sparkSession, pool.persist()
    slots: list = [r["media_id"] for r in picks.orderBy("rank").collect()]
    failed: set = set()

    def attempt(ids: list) -> set:
        done = {r["media_id"] for r in prepare(pool.filter(F.col("media_id").isin(ids))).select("media_id").collect()} if ids else set()
        failed.update(set(ids) - done)
        return done

    done = attempt(slots)
    slots = [k if k in done else None for k in slots]
    while None in slots:
        current = [k for k in slots if k is not None]
        out = spark.createDataFrame([(k,) for k in failed], "media_id long")
        found = [r["media_id"] for r in greedy_select(pool, options, current, out).orderBy("rank").collect()][len(current) :]
        holes = [i for i, k in enumerate(slots) if k is None]
        tries = found[: len(holes)]
        if not tries:
            break
        done = attempt(tries)
        for i, k in zip(holes, tries, strict=False):
            slots[i] = k if k in done else None
    pool.unpersist()
    return spark.createDataFrame([(k, i + 1) for i, k in enumerate(slots) if k is not None], "media_id long, rank int")
