"""Joins on time within a key: the nearest row on either side, and pairs within an interval. Bins of time split hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def nearest_in_time(points: DataFrame, rows: DataFrame, key: str, time: str, value: str, width: float) -> DataFrame:
    """points with near_time and near, time and value of the row of the same key that is nearest; null where there is none.

    Of rows equally near the earlier one wins, of rows of one time the one with the smallest value. Time is cut into bins
    of `width`: within a bin the rows before and after a point come from windows over the bin, beyond it from windows
    over one row a bin. So no window holds all rows of a key. Points without key or time have no nearest row.
    """
    names, bin_ = points.columns, F.floor(F.col("_t") / width)
    timed = points.filter(F.col(key).isNotNull() & F.col(time).isNotNull())
    asked = timed.select(F.col(key).alias("_key"), F.col(time).alias("_t"), F.struct(*names).alias("_point")).withColumn("_bin", bin_)
    own = rows.filter(F.col(key).isNotNull() & F.col(time).isNotNull()).groupBy(F.col(key).alias("_key"), F.col(time).alias("_t")).agg(F.min(value).alias("v"))
    own = own.select("_key", "_t", F.struct(F.col("_t").alias("t"), "v").alias("_row")).withColumn("_bin", bin_)

    both = asked.unionByName(own, allowMissingColumns=True)
    place, rows_first = Window.partitionBy("_key", "_bin"), F.col("_point").isNotNull()  # a row of the point's own time is before it
    to_here = (Window.unboundedPreceding, 0)
    both = both.withColumns({
        "_before": F.last("_row", ignorenulls=True).over(place.orderBy("_t", rows_first).rowsBetween(*to_here)),
        "_after": F.last("_row", ignorenulls=True).over(place.orderBy(F.desc("_t"), rows_first).rowsBetween(*to_here)),
    })
    ends = own.groupBy("_key", "_bin").agg(F.min("_row").alias("_first"), F.max("_row").alias("_last"))
    bins = ends.unionByName(asked.select("_key", "_bin").distinct().join(ends, ["_key", "_bin"], "left_anti"), allowMissingColumns=True)
    along, others = Window.partitionBy("_key"), (Window.unboundedPreceding, -1)
    bins = bins.select(
        "_key", "_bin", F.last("_last", ignorenulls=True).over(along.orderBy("_bin").rowsBetween(*others)).alias("_earlier"),
        F.last("_first", ignorenulls=True).over(along.orderBy(F.desc("_bin")).rowsBetween(*others)).alias("_later"),
    )
    found = both.filter(rows_first).join(bins, ["_key", "_bin"])
    before, after = F.coalesce("_before", "_earlier"), F.coalesce("_after", "_later")
    nearer = F.when(before.isNull() | (after["t"] - F.col("_t") < F.col("_t") - before["t"]), after).otherwise(before)
    found = found.withColumn("_near", nearer).select("_point.*", F.col("_near.t").alias("near_time"), F.col("_near.v").alias("near"))
    return found.unionByName(points.filter(F.col(key).isNull() | F.col(time).isNull()), allowMissingColumns=True)


def pairs_within(rows: DataFrame, key: str, time: str, value: str, interval: float) -> DataFrame:
    """key, left, right and gap of all pairs of rows of one key whose times differ by less than `interval`, left being
    the earlier one, of equal times the one with the smaller value.

    Bins of the interval's width: a row stands in its own bin and, as the later one of a pair, in the one before, so that
    an equality join on key and bin finds each pair once; what remains is tested exactly. A hot key is dealt out by its
    bins. Rows without key or time have no pair.
    """
    own = rows.select(F.col(key).alias("_key"), F.col(time).alias("t"), F.col(value).alias("v")).filter("_key is not null and t is not null").withColumn("_bin", F.floor(F.col("t") / interval).cast("long"))
    first = own.select("_key", "_bin", F.col("t").alias("t0"), F.col("v").alias("left"))
    then = own.withColumn("_bin", F.explode(F.array(F.col("_bin"), F.col("_bin") - 1))).select("_key", "_bin", F.col("t").alias("t1"), F.col("v").alias("right"))
    later = F.struct("t1", "right") > F.struct(F.col("t0").alias("t1"), F.col("left").alias("right"))
    both = first.join(then, ["_key", "_bin"]).withColumn("gap", F.col("t1") - F.col("t0")).filter(later & (F.col("gap") < interval))
    return both.select(F.col("_key").alias(key), "left", "right", "gap")


def sampled_frames(frames: DataFrame, fps: float = 0.5, most: int = 120, every: int = 30) -> DataFrame:
    """source, i, at, seconds and id: the frames (source, seconds, id) nearest to the midpoints of equal parts of a source.

    A source has `fps` parts a second of its duration, one at least and `most` at most. `at` and seconds count from its
    first whole second. A source without duration, whose frames have no times of their own, gives every 30th frame.
    """
    span = frames.groupBy("source").agg(F.floor(F.min("seconds")).alias("start"), (F.floor(F.max("seconds")) - F.floor(F.min("seconds"))).alias("duration"))
    n = F.least(F.lit(most), F.greatest(F.lit(1), F.ceil(F.col("duration") * fps))).cast("long")
    parts = span.filter("duration > 0").withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    at = F.least(F.col("duration").cast("double"), (F.col("i") + 0.5) * (F.col("duration") / F.col("n")))
    points = parts.select("source", "i", at.alias("rel"))
    timed = frames.join(span, "source").withColumn("rel", F.col("seconds") - F.col("start"))
    near = nearest_in_time(points, timed, "source", "rel", "id", 60.0).select("source", "i", F.col("rel").alias("at"), F.col("near_time").alias("seconds"), F.col("near").alias("id"))
    still = timed.filter("duration = 0").withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy("rel", "id"))).filter(F.col("k") <= every * most)
    thirtieth = still.filter((F.col("k") - 1) % every == 0).select("source", ((F.col("k") - 1) / every).cast("long").alias("i"), F.col("rel").alias("at"), F.col("rel").alias("seconds"), "id")
    return near.unionByName(thirtieth)
