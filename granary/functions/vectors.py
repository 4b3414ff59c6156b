"""Vectors and bit hashes as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in doubles; -1 where either vector is zero."""
    den = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(den == 0, F.lit(-1.0)).otherwise(dot(a, b) / den)


def unit(v: Column) -> Column:
    norm = F.greatest(F.lit(1e-12), F.sqrt(dot(v, v)))
    return F.transform(v, lambda x: x.cast("double") / norm)


def sign_hash(v: Column) -> Column:
    """64 sign bits, the first component first."""
    return F.aggregate(v, F.lit(0).cast("long"), lambda h, x: F.shiftleft(h, 1).bitwiseOR((x >= 0).cast("long")))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two hashes; 64 where either is null."""
    return F.coalesce(F.bit_count(a.bitwiseXOR(b)), F.lit(64))


def weighted_centroid(df: DataFrame, vector: str, weight: Column, keys: list[str]) -> DataFrame:
    """keys and the unit vector of the weighted mean of raw vectors; weights count 0.01 at least.

    Where the weighted mean is zero the plain mean is taken. Sums are taken by place, with partial aggregation.
    """
    w = F.greatest(weight, F.lit(0.01))
    long = df.select(*keys, w.alias("_w"), F.posexplode(vector).alias("_pos", "_x"))
    sums = long.groupBy(*keys, "_pos").agg(F.sum(F.col("_x").cast("double") * F.col("_w")).alias("s"), F.sum(F.col("_x").cast("double")).alias("p"))
    both = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_pos", "s", "p"))).alias("a"))
    weighted = F.transform("a", lambda x: x["s"])
    plain = F.transform("a", lambda x: x["p"])
    return both.select(*keys, unit(F.when(dot(weighted, weighted) > 0, weighted).otherwise(plain)).alias("centroid"))


def mean_of_units(df: DataFrame, vector: str, keys: list[str]) -> DataFrame:
    """keys and the unit vector of the mean of unit vectors; a zero vector, mixed lengths or a zero mean raise."""
    norm = F.sqrt(dot(F.col(vector), F.col(vector)))
    long = df.withColumn("_n", F.when(norm > 0, norm).otherwise(F.raise_error(F.lit("a reference is a zero vector"))))
    long = long.select(*keys, "_n", F.size(vector).alias("_size"), F.posexplode(vector).alias("_pos", "_x"))
    sums = long.groupBy(*keys, "_pos").agg(F.avg(F.col("_x").cast("double") / F.col("_n")).alias("s"), F.min("_size").alias("lo"), F.max("_size").alias("hi"))
    both = sums.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "s"))), lambda x: x["s"]).alias("a"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    mean = F.col("a")
    out = F.when(F.col("lo") != F.col("hi"), F.raise_error(F.lit("references have different lengths")).cast("array<double>")).when(dot(mean, mean) == 0, F.raise_error(F.lit("references average to zero")).cast("array<double>")).otherwise(unit(mean))
    return both.select(*keys, out.alias("centroid"))
