"""Queries on runs: comparison, acceptance, summaries, selections that are filled up, and states of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions import signals
from granary.functions.names import contact_label, unique_names
from granary.functions.vectors import mean_of_units
from granary.operators.compare import compare_runs, run_summary
from granary.operators.select import backfill, greedy_select
from granary.plans.queries import REFERENCES, candidates, centroids, first_of_pool
from granary.operators.neighbours import reject_outliers
from granary.sources import reports
from granary.sources.views import images, observations, table


def _run(spark, sf_dir: str, least: float, floor: float, label: int) -> DataFrame:
    """A run: a detector that finds nothing under a width, and a centroid; the first twenty get crops."""
    c = candidates(spark, sf_dir, least, label).withColumn("found", F.col("width") >= floor)
    none = ~F.col("found")
    c = c.join(first_of_pool(c.filter("found")), "media_id", "left")
    return c.select(
        "media_id", F.when(none, 0).otherwise(F.col("face_count")).alias("face_count"), F.when(F.col("found"), F.col("similarity")).alias("similarity"),
        F.when(none, "rejected").otherwise(F.col("status")).alias("status"), F.when(none, "no_face").otherwise(F.coalesce("reason", F.lit(""))).alias("reason"), "rank",
        F.when(F.col("rank").isNotNull(), F.col("scale_bin")).alias("strategy"), F.when(F.col("rank").isNotNull(), F.when(F.col("base") >= 0.5, "safe").otherwise("warning")).alias("safety"),
        F.when(F.col("rank").isNotNull(), F.col("pose_bin")).alias("crop_box"),
    )


def _compared(spark, sf_dir) -> DataFrame:
    return compare_runs(_run(spark, sf_dir, 0.05, 22.0, 0), _run(spark, sf_dir, 0.02, 26.0, 1), "media_id")


def q_run_compare(spark, sf_dir):
    return _compared(spark, sf_dir)


def q_acceptance(spark, sf_dir):
    """Statistics of the differences of two runs, and whether the second one may take the first one's place."""
    return run_summary(_compared(spark, sf_dir), 10.0, 8.0, 0.05)


def q_delta_stats(spark, sf_dir):
    return q_acceptance(spark, sf_dir).select("pairs", "mean_delta", "median_delta", "most_delta", "new_misses", "suggested_threshold")


def q_summary(spark, sf_dir):
    """Counts of a run, and its distributions, one row a kind and value."""
    c = candidates(spark, sf_dir)
    s = reports.summary(reports.decided(c, first_of_pool(c), "media_id"), 20)
    maps = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"{k}_distribution").alias("m")) for k in ("status", "scale_bin", "pose_bin", "light_bin"))))
    return s.select("requested", "selected", "multiple_faces_review", "rejected", maps.alias("x")).select("requested", "selected", "multiple_faces_review", "rejected", "x.kind", F.explode("x.m").alias("value", "n"))


def q_backfill(spark, sf_dir):
    """The greedy selection of rows, those with several faces failing, filled up from what is left of the pool."""
    pool = candidates(spark, sf_dir).filter("status = 'eligible' or fallback_eligible")
    return backfill(pool, greedy_select(pool), lambda rows: rows.filter("face_count = 1"))


def q_mean_centroid(spark, sf_dir):
    """Unit means of each label's references, by component."""
    refs = observations(spark, sf_dir).filter(F.col("media_id") < REFERENCES)
    return mean_of_units(refs, "vector", ["label"]).select("label", F.posexplode("centroid").alias("pos", "x")).select("label", "pos", F.round("x", 6).alias("x"))


def q_reference_centroid(spark, sf_dir):
    """Quality-weighted centroids of the references that stay once outliers are dropped."""
    refs = observations(spark, sf_dir).filter(F.col("media_id") < REFERENCES)
    kept = reject_outliers(refs, "media_id", "label", "vector").filter("kept").select("media_id")
    return centroids(refs.join(kept, "media_id")).select("label", F.posexplode("centroid").alias("pos", "x")).select("label", "pos", F.round("x", 6).alias("x"))


def q_session_status(spark, sf_dir):
    """The status of sessions that prepared some of what they wanted, by the action that ended them."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 25).alias("prepared"), F.element_at(F.array(F.lit("finish"), F.lit("tight"), F.lit("backfill")), (F.col("o_custkey") % 3 + 1).cast("int")).alias("action"), (F.col("o_orderkey") % 7 != 0).alias("crops"))
    return o.select("o_orderkey", signals.session_status(F.col("prepared"), F.lit(20), F.col("action"), F.col("crops")).alias("status"))


def q_unique_names(spark, sf_dir):
    """File names for images that share names, the first by path as it is, others with a digest."""
    i = images(spark, sf_dir).select("image", F.concat(F.lit("IMG"), (F.col("image") % 500).cast("string"), F.lit(".jpg")).alias("name"), F.concat(F.lit("/in/"), F.col("image").cast("string")).alias("path"))
    return unique_names(i, "image", "name", "path").select("image", "file")


def q_source_state(spark, sf_dir):
    """Found, reused, processed and failed sources of a run over files, some of which an earlier run finished."""
    i = images(spark, sf_dir)
    files = i.select(F.col("image").cast("string").alias("path"), F.col("width").cast("long").alias("bytes"), F.timestamp_seconds("height").alias("modified"))
    state = files.select("path", F.when(F.col("bytes") % 4 == 0, "error").otherwise("ok").alias("status"), (F.col("bytes") + F.when(F.col("bytes") % 5 == 0, 1).otherwise(0)).alias("bytes"), "modified", F.lit("a").alias("config"), F.lit(None).cast("string").alias("error"))
    left = reports.to_process(files, state, "a")
    news = left.select("path", F.when(F.col("bytes") % 3 == 0, "error").otherwise("ok").alias("status"), "bytes", "modified", F.lit("a").alias("config"), F.lit(None).cast("string").alias("error"))
    return reports.run_counters(files, state, news, "a")


def q_contact_labels(spark, sf_dir):
    """Labels and places of a selection in a sheet of four columns."""
    c = candidates(spark, sf_dir)
    top = c.join(F.broadcast(first_of_pool(c)), "media_id")
    return top.select("rank", contact_label(*(F.col(c) for c in ("rank", "scale_bin", "pose_bin", "similarity"))).alias("label"), F.floor((F.col("rank") - 1) / 4).alias("row"), ((F.col("rank") - 1) % 4).alias("place"))
