"""Queries on what models give: rows of detectors, decoded tensors, grids of pixels, frames looked up by time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from granary.functions.grids import blur, gradient_hash
from granary.functions.tensors import decoded, suppressed
from granary.operators.intime import pairs_within, sampled_frames
from granary.plans.queries import candidates
from granary.sources.detectors import detected, register_detector
from granary.sources.folders import shared_folder
from granary.sources.media import Stage, with_stages
from granary.sources.sidecars import read_sidecars, write_sidecars
from granary.sources.views import frames, images, table


def stub_detector():
    """Stands for a model: up to three boxes an image; every 29th image breaks off after its first."""

    def detect(image, width, height):
        for j in range(image % 4):
            if image % 29 == 0 and j == 1:
                raise ValueError(f"image {image}")
            x, y = float(j * 50 + image % 97), float(image % 53)
            yield (image * 31 + j * 17) % 1000 / 1000, x, y, min(float(width), x + 40 + j), min(float(height), y + 60)

    return detect


def q_detect_rows(spark, sf_dir):
    """The detections of every image, a row each, and the errors of images whose detection fails."""
    register_detector(spark, "stub_detector", stub_detector, "score double, x1 double, y1 double, x2 double, y2 double")
    return detected(images(spark, sf_dir), "stub_detector", "image", "width", "height").drop("width", "height")


def q_decode_classes(spark, sf_dir):
    """Boxes of classes from the vectors, read as tensors of four classes and eight boxes, less those that others hide."""
    x = F.col("x")
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))

    def value(x, k):
        row = F.floor(k / 8)
        return F.when(row < 2, 160 + 600 * x).when(row < 4, 40 + 300 * F.abs(x)).otherwise(F.least(F.lit(1.0), 3 * F.abs(x)))

    tensors = e.select("vec_id", F.transform("e", value).alias("x"))
    found = decoded(x, 8, 4, F.lit(300.0), F.lit(280.0), scale=0.8, pad_left=10.0, pad_top=6.0, left=100.0, top=50.0)
    kept = tensors.select("vec_id", F.explode(suppressed(found)).alias("d"))
    return kept.select("vec_id", "d.class_id", "d.score", "d.box.*")


def q_sample_frames(spark, sf_dir):
    """The frames nearest to the sampled positions of each source."""
    f = sampled_frames(frames(spark, sf_dir).select("source", "seconds", "id"))
    return f.select("source", "i", F.round("at", 6).alias("at"), F.round("seconds", 6).alias("seconds"), "id")


def q_near_frames(spark, sf_dir):
    """Pairs of frames of one source less than half an hour apart."""
    f = frames(spark, sf_dir)
    return pairs_within(f, "source", "seconds", "id", 1800.0).withColumn("gap", F.round("gap", 6))


def q_grid_signals(spark, sf_dir):
    """Gradient hash and blur of each vector, spread over a grid of 18 by 16 pixels."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    pixel = lambda k: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(128 + 400 * F.get("e", (F.floor(k / 18) * 18 + k % 18 * 7).cast("int") % 64)))).cast("int")
    g = e.select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(18 * 16 - 1)), pixel).alias("g"))
    w, h = F.lit(18), F.lit(16)
    return g.select("vec_id", gradient_hash(F.col("g"), w, h).alias("hash"), F.round(blur(F.col("g"), w, h), 6).alias("blur"))


def q_sidecars(spark, sf_dir):
    """One text file for each conversation, its turns in order, written all at once and read back."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")))).alias("t"))  # one file's text
    lines = F.transform("t", lambda x: F.concat(x["role"], F.lit(": "), x["text"]))
    folder = shared_folder(spark)
    write_sidecars(c.select(F.concat(F.lpad(F.col("conv_id").cast("string"), 9, "0"), F.lit(".txt")).alias("name"), F.array_join(lines, "\n").alias("text")), folder, "name", "text")
    return read_sidecars(spark, folder).select("name", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.length("text").cast("long").alias("n_chars"))


def q_scorer_stages(spark, sf_dir):
    """A cascade of two models: rows that pass the cheap gates get an appearance, and only confident ones of them a body."""
    c = candidates(spark, sf_dir).select("media_id", "quality_score", (F.col("similarity") >= F.round(F.col("threshold") - 0.15, 6)).alias("near"), F.coalesce("body_confidence", F.lit(0.0)).alias("confidence"))

    def open_appearance():
        return lambda part: pd.DataFrame({"look": (part["quality_score"] * 0.5 + part["media_id"] % 2 * 0.25).round(6)})

    def open_body():
        return lambda part: pd.DataFrame({"body": (part["look"] + part["confidence"]).round(6)})

    stages = [
        Stage(lambda p: p["near"] & (p["quality_score"] >= 0.3), open_appearance, "look double"),
        Stage(lambda p: p["look"].notna() & (p["confidence"] >= 0.5), open_body, "body double"),
    ]
    return with_stages(c, stages).select("media_id", "look", "body", "stage_error")
