"""Comparison of two runs over the same images, and what it says about accepting the second one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.signals import suggested_threshold

PARTS = ("face_count", "similarity", "status", "reason", "rank", "strategy", "safety", "crop_box")


def compare_runs(base: DataFrame, candidate: DataFrame, key: str) -> DataFrame:
    """One row an image of either run: what both say (base_*, candidate_*), the difference, and what changed.

    Runs have `key` and the columns of PARTS; rank is null where an image wasn't selected, strategy, safety and crop_box
    where it has no crop. An image that one run lacks has the status `missing` there. One full join on the key.
    """
    sides = [df.select(key, F.lit(True).alias(f"{n}_there"), *(F.col(c).alias(f"{n}_{c}") for c in PARTS)) for n, df in (("base", base), ("candidate", candidate))]
    both = sides[0].join(sides[1], key, "full")
    there = F.col("base_there") & F.col("candidate_there")

    def differ(name: str) -> Column:
        return ~F.col(f"base_{name}").eqNullSafe(F.col(f"candidate_{name}"))

    missing = F.coalesce(~there, F.lit(True))
    crops = F.col("base_safety").isNotNull() & F.col("candidate_safety").isNotNull()
    both = both.withColumns({
        "similarity_delta": F.round(F.col("candidate_similarity") - F.col("base_similarity"), 6),
        "face_count_changed": missing | differ("face_count"), "status_changed": missing | differ("status") | differ("reason"),
        "selection_changed": F.col("base_rank").isNull() != F.col("candidate_rank").isNull(),
        "crop_changed": crops & (differ("strategy") | differ("safety") | differ("crop_box")),
    })
    for name in ("base", "candidate"):
        both = both.withColumns({f"{name}_{c}": F.when(F.col(f"{name}_there").isNull(), "missing").otherwise(F.col(f"{name}_{c}")) for c in ("status", "reason")})
    return both.drop("base_there", "candidate_there")


def run_summary(rows: DataFrame, base_seconds: float, candidate_seconds: float, threshold: float) -> DataFrame:
    """One row over the rows of compare_runs: statistics of the differences, counts of changes, and acceptance."""
    picked = [F.col(f"{n}_rank").isNotNull() for n in ("base", "candidate")]
    overlap = F.count_if(picked[0] & picked[1])
    safe = [F.startswith(F.col(f"{n}_safety"), F.lit("safe")) for n in ("base", "candidate")]
    delta = F.col("similarity_delta")
    out = rows.agg(
        F.count("*").alias("images"), F.count(delta).alias("pairs"), F.round(F.avg(delta), 6).alias("mean_delta"), F.round(F.median(delta), 6).alias("median_delta"), F.round(F.max(F.abs(delta)), 6).alias("most_delta"),
        *(F.count_if(f"{c}_changed").alias(f"{c}_changes") for c in ("status", "face_count", "selection", "crop")),
        F.count_if((F.col("base_face_count") > 0) & (F.col("candidate_face_count") == 0)).alias("new_misses"), overlap.alias("overlap"),
        F.round(overlap / F.greatest(F.lit(1), F.count_if(picked[0])), 4).alias("overlap_ratio"), F.count_if(safe[0] & ~safe[1]).alias("unsafe_regressions"),
    )
    speedup = round(base_seconds / candidate_seconds, 4) if candidate_seconds > 0 else None
    return out.withColumns({
        "speedup": F.lit(speedup).cast("double"), "no_new_misses": F.col("new_misses") == 0, "no_unsafe_regressions": F.col("unsafe_regressions") == 0,
        "enough_overlap": F.col("overlap_ratio") >= 0.90, "enough_speedup": F.coalesce(F.lit(speedup).cast("double") >= 1.15, F.lit(False)), "suggested_threshold": suggested_threshold(threshold, F.col("median_delta")),
    })
