"""Exact near-duplicate joins of 64-bit hashes, and outlier rejection among references."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.functions.bits import BITS, Band, near_places, plan
from granary.functions.vectors import cosine, hamming

#: Radius from which hashes are compared in blocks; below, a join on bands meets under 1 % of random pairs.
WIDE = 9
#: Rows of a group of references at most: their pairs are compared.
REFERENCES = 64


def bands(radius: int) -> tuple[list[tuple[int, int]], bool]:
    """First bit and width of the bands that two hashes within the radius share one of; whether one bit of it may differ.

    Of radius + 1 bands one is alike; of radius // 2 + 1 bands one differs in a bit at most, which keeps bands wide.
    Of n bands of w bits a random pair shares one with a chance of about n (w + 1) / 2**w: 0.1 % at a radius of 6, 1 %
    at 8, 4 % at 10, and over a half from 16 on: from WIDE on, near_blocks takes the place of the join.
    """
    loose = radius > 3
    n = min(BITS, radius // 2 + 1 if loose else radius + 1)
    edges = [BITS * i // n for i in range(n + 1)]
    return [(lo, hi - lo) for lo, hi in zip(edges[:-1], edges[1:], strict=True)], loose


def near_hashes(hashes: DataFrame, radius: int) -> DataFrame:
    """h, g of all pairs of distinct hashes within `radius` bits, h < g; hashes has one column, h, of distinct values."""
    parts, loose = bands(radius)

    def band(i: int, lo: int, width: int, flip: int = 0):
        value = F.shiftright("h", lo).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))
        return F.struct(F.lit(i).alias("band"), value.bitwiseXOR(F.lit(flip)).alias("bits"))

    own = [band(i, lo, w) for i, (lo, w) in enumerate(parts)]
    wide = own + [band(i, lo, w, 1 << b) for i, (lo, w) in enumerate(parts) for b in range(w)] if loose else own
    left = hashes.select("h", F.explode(F.array(*own)).alias("k")).select("h", "k.*")
    right = hashes.select(F.col("h").alias("g"), F.explode(F.array(*wide)).alias("k")).select("g", "k.*")
    near = left.join(right, ["band", "bits"]).filter((F.col("h") < F.col("g")) & (hamming(F.col("h"), F.col("g")) <= radius))
    return near.select("h", "g").distinct()


def near_blocks(rows: DataFrame, bands: list[Band], blocks: int, radius: int) -> DataFrame:
    """left, right, distance of all pairs of rows (id, h) within `radius` bits, left < right, by bands and blocks of granary.functions.bits.plan.

    Rows are dealt to blocks by id, so blocks are even whatever the hashes; a task compares two blocks by the buckets of a band.
    """
    tasks = [(k, i, j) for k in range(len(bands)) for i in range(blocks) for j in range(i, blocks)]
    asked = [[t for t, (_, i, j) in enumerate(tasks) if c in (i, j)] for c in range(blocks)]
    kind = rows.schema["id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column("block").to_numpy()
            for c in np.unique(place):
                own = batch.filter(pa.array(place == c))
                packed = [pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own.column(x)) for x in ("id", "h")]
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([asked[c]], pa.list_(pa.int32())), *packed], ["block", "tasks", "ids", "hashes"])

    def compare(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, i, j = tasks[key[0].as_py()]
        ids, hashes = {i: [], j: []}, {i: [], j: []}
        for batch in batches:
            for at, c in enumerate(batch.column("block").to_pylist()):
                ids[c].append(batch.column("ids")[at].values)
                hashes[c].append(batch.column("hashes")[at].values.to_numpy())
        if not (ids[i] and ids[j]):
            return
        own = {c: pa.concat_arrays(x) for c, x in ids.items()}
        h = {c: np.concatenate(x).view(np.uint64) for c, x in hashes.items()}
        for a, b, d in near_places(h[i], None if i == j else h[j], bands, k, radius):
            yield pa.RecordBatch.from_arrays([own[i].take(pa.array(a)), own[j].take(pa.array(b)), pa.array(d, pa.int64())], ["a", "b", "distance"])

    rows = rows.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), "id", F.col("h").cast("long").alias("h"))
    packed = rows.mapInArrow(pack, f"block int, tasks array<int>, ids array<{kind}>, hashes array<bigint>")
    sent = packed.select(F.explode("tasks").alias("task"), "block", "ids", "hashes").repartition(4 * len(tasks), "task")  # few tasks share a partition
    pairs = sent.groupBy("task").applyInArrow(compare, f"a {kind}, b {kind}, distance bigint")
    return pairs.filter("a <> b").select(F.least("a", "b").alias("left"), F.greatest("a", "b").alias("right"), "distance")


def hamming_classes(df: DataFrame, id_col: str, hash_col: str, radius: int) -> tuple[DataFrame, DataFrame]:
    """Membership (id, class: the smallest id of its hash) and pairs of classes (left, right, distance) within the radius.

    However many rows share a hash, they make one row each in the membership and none in the pairs.
    """
    rows = df.filter(F.col(hash_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(hash_col).alias("h"))
    groups = rows.groupBy("h").agg(F.min("id").alias("class"))
    if radius >= WIDE:
        return rows.join(groups, "h").select("id", "class"), near_blocks(groups.select(F.col("class").alias("id"), "h"), *plan(df.select(id_col).count(), radius), radius)
    found = near_hashes(groups.select("h"), radius)
    pairs = found.join(groups.withColumnRenamed("class", "a"), "h").join(groups.select(F.col("h").alias("g"), F.col("class").alias("b")), "g")
    pairs = pairs.select(F.least("a", "b").alias("left"), F.greatest("a", "b").alias("right"), hamming(F.col("h"), F.col("g")).cast("long").alias("distance"))
    return rows.join(groups, "h").select("id", "class"), pairs


def hamming_pairs(df: DataFrame, id_col: str, hash_col: str, radius: int) -> DataFrame:
    """left, right, distance of all pairs of rows within `radius` bits, left < right; null hashes are near nothing.

    Where many rows share a hash, hamming_classes says the same in fewer rows.
    """
    if radius >= WIDE:
        rows = df.filter(F.col(hash_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(hash_col).alias("h"))
        return near_blocks(rows, *plan(df.select(id_col).count(), radius), radius)
    members, pairs = hamming_classes(df, id_col, hash_col, radius)
    equal = members.alias("a").join(members.alias("b"), "class").filter("a.id < b.id").select(F.col("a.id").alias("left"), F.col("b.id").alias("right"), F.lit(0).cast("long").alias("distance"))
    a, b = (members.select(F.col("class").alias(c), F.col("id").alias(i)) for c, i in (("left", "a"), ("right", "b")))
    other = pairs.join(a, "left").join(b, "right").select(F.least("a", "b").alias("left"), F.greatest("a", "b").alias("right"), "distance")
    return other.unionByName(equal)


def reject_outliers(df: DataFrame, id_col: str, group_col: str, vector: str) -> DataFrame:
    """group, id, mean similarity to the others of the group, and whether it is kept. A group of over REFERENCES rows is an error.

    Fewer than three are all kept. Else the two best stay, and others whose mean is 0.60 or more and no more than
    0.15 below the group's median.
    """
    rows = df.select(F.col(group_col).alias("g"), F.col(id_col).alias("id"), F.col(vector).alias("v"))
    sizes = rows.groupBy("g").agg(F.count("*").alias("n")).filter(F.when(F.col("n") > REFERENCES, F.raise_error(F.lit("too many references in a group"))).otherwise(F.lit(True)).cast("boolean"))
    rows = rows.join(sizes.select("g"), "g")
    pairs = rows.alias("a").join(rows.alias("b"), (F.col("a.g") == F.col("b.g")) & (F.col("a.id") != F.col("b.id")))
    means = pairs.groupBy(F.col("a.g").alias("g"), F.col("a.id").alias("id")).agg(F.round(F.avg(cosine(F.col("a.v"), F.col("b.v"))), 6).alias("mean_similarity"))
    whole = Window.partitionBy("g")
    place = F.row_number().over(whole.orderBy(F.desc("mean_similarity"), "id"))
    level = F.median("mean_similarity").over(whole)
    keep = (F.count("*").over(whole) < 3) | (place <= 2) | ((F.col("mean_similarity") >= 0.60) & (F.col("mean_similarity") >= F.round(level - 0.15, 6)))
    return means.select(F.col("g").alias(group_col), F.col("id").alias(id_col), "mean_similarity", keep.alias("kept"))
