"""Observations, detections, frames and images, derived from the test tables by integer arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.boxes import box
from granary.functions.vectors import sign_hash


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, i = table(spark, sf_dir, "embeddings"), F.col("vec_id")
    width = (20 + i * 7 % 200).cast("double")
    return df.select(
        i.alias("media_id"), F.col("embedding").alias("vector"), "label", sign_hash(F.col("embedding")).alias("image_hash"),
        F.when(i % 11 != 0, (i * 37 % 181 - 90).cast("double")).alias("yaw"), width.alias("width"), (i * 13 % 100 / 250).alias("ratio"),
        (i * 17 % 90 / 10).alias("blur"), (i * 29 % 101 / 100).alias("exposure"), F.least(F.lit(1.0), width / 160).alias("resolution"),
        (i * 31 % 101 / 100).alias("margin"), (i * 23 % 101 / 100).alias("luma"), F.when(i % 7 == 0, 2).otherwise(1).alias("face_count"),
        F.when(i % 3 == 0, i * 19 % 101 / 100).alias("appearance"), F.when(i % 5 == 0, i * 41 % 101 / 100).alias("body_confidence"),
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    x, y = F.col("l_partkey") % 1000, (F.col("l_partkey") * 7 + F.col("l_suppkey") * 13) % 800
    return df.select(
        F.col("l_orderkey").alias("image"), F.col("l_linenumber").cast("long").alias("det"), ((F.col("l_partkey") * 31 + F.col("l_linenumber") * 17) % 1000 / 1000).alias("score"),
        box(x, y, x + 40 + F.col("l_partkey") % 160, y + 40 + F.col("l_suppkey") * 11 % 160).alias("box"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return df.select(F.col("user_id").alias("source"), F.col("event_id").alias("id"), seconds.alias("seconds"), F.col("value").alias("score"), (F.col("event_id") * 2654435761 % 4611686018427387904).alias("hash"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images_of(table(spark, sf_dir, "part"))


def images_of(parts: DataFrame) -> DataFrame:
    p = F.col("p_partkey")
    return parts.select(p.alias("image"), (400 + p * 37 % 1800).alias("width"), (400 + (p * 53 + F.col("p_size") * 29) % 1800).alias("height"))
