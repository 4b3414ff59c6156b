"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents stand in one random order, cut into blocks of a fixed number of words. The mix takes each
source's first blocks up to its target, a second round of them where the target is over the source's size. The exact
block quotas of all sources are split from the root of a binary tree down to the output shards: each node hands a
random, multivariate-hypergeometric part of its blocks to its left half. A leaf then owns, of each source, a range of
places in a permutation of the source's taken blocks, so the draws of different shards are disjoint. Rows are at last
shuffled inside their shard.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.llm.common import materialize, stamped, words_of

#: Words to a block, blocks of all sources at most (larger corpora have larger blocks, so that numpy draws exactly),
#: documents (on average) to a slice of a source's order, slices that are summed together, words to an output shard.
BLOCK_WORDS, MOST_BLOCKS, SLICE_DOCS, SLICES, SHARD_WORDS = 256, 400_000_000, 512, 4096, 8_000_000
#: The driver splits the tree down to so many nodes; tasks split the rest.
TOP_NODES = 64
#: No document is used more often.
MOST = 2


def cyclic_weights(*weights: float) -> Callable[[list], list[float]]:
    """Weights that repeat over the sources in the order of their names, null last."""
    return lambda names: [weights[i % len(weights)] for i in range(len(names))]


def targets(sizes: list[float], weights: list[float], total: float) -> list[float]:
    """Shares of the total by weight. A share stops at MOST times its source's size; the others take the excess."""
    out, open_, rest = [0.0] * len(sizes), set(range(len(sizes))), total
    while open_:
        unit = sum(weights[i] for i in open_)
        over = {i for i in open_ if rest * weights[i] / unit > MOST * sizes[i]} if unit else open_
        if not over:
            for i in open_:
                out[i] = rest * weights[i] / unit
            break
        for i in over:
            out[i] = float(MOST * sizes[i])
        rest -= sum(out[i] for i in over)
        open_ -= over
    return out


def split(quotas: np.ndarray, lo: int, hi: int, stop: int, seed: int) -> list[tuple[int, int, np.ndarray]]:
    """Splits the blocks of shards lo to hi down to nodes of at most `stop` shards. Each node has its own generator."""
    if hi - lo <= stop:
        return [(lo, hi, quotas)]
    mid = (lo + hi) // 2
    total = int(quotas.sum())
    take, left, pool = round(total * (mid - lo) / (hi - lo)), np.zeros_like(quotas), total
    rng = np.random.default_rng([seed, lo, hi])
    for i, quota in enumerate(quotas):  # one source after another, given what is left: together multivariate
        quota, rest = int(quota), pool - int(quota)
        left[i] = draw(rng, quota, rest, take)
        take, pool = take - int(left[i]), rest
    return split(left, lo, mid, stop, seed) + split(quotas - left, mid, hi, stop, seed)


def draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """A hypergeometric number."""
    return int(rng.hypergeometric(good, bad, n)) if n else 0


def mix_plan(docs: DataFrame, weights: Callable[[list], list[float]], share: float = 1.5, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rid_col: str | None = None) -> DataFrame:
    """One row a document: key (hash of id and text), rid, id, source, size, source_size, target, draws.

    draws is an array of (shard, round) of at most MOST entries, empty for documents that the mix leaves out. The
    null source is a source of its own and the last; null and empty texts have size 0 and are never drawn. Rows that
    repeat an id and text are documents of their own, and stand in any order. Reruns over the same rows agree, however
    they are partitioned. A document belongs to the block that holds its middle word, so each source's taken words
    miss its target by half a document and half a block at most. rid is rid_col's value, or a new number of each row.
    Per source, a few numbers pass through the driver; blocks, documents and the tree's lower part stay in tasks.
    An empty table gives no rows; other columns aren't read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), words_of(F.col(text_col)).alias("size"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("key"), (F.col(rid_col) if rid_col else F.monotonically_increasing_id()).alias("rid"))
    rows = materialize(rows)
    stats = rows.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("docs")).collect()
    stats = sorted(stats, key=lambda r: (r["source"] is None, r["source"] or ""))
    spark, names = docs.sparkSession, [r["source"] for r in stats]
    sizes = [int(r["words"]) for r in stats]
    goals = targets(sizes, weights(names), share * sum(sizes))
    words = max(BLOCK_WORDS, -(-sum(sizes) // MOST_BLOCKS))
    blocks = [-(-size // words) for size in sizes]
    quotas = np.array([min(MOST * b, round(goal / words + (b - size / words) * (goal // size))) if size else 0 for b, goal, size in zip(blocks, goals, sizes, strict=True)], np.int64)
    shards = max(1, math.ceil(sum(goals) / SHARD_WORDS))
    slices = [1 << max(0, math.ceil(math.log2(max(1, r["docs"] / SLICE_DOCS)))) for r in stats]
    rng = np.random.default_rng([seed, 0])
    steps = [coprime(rng, int(q)) for q in quotas]
    shifts = [int(rng.integers(0, max(1, q))) for q in quotas]
    facts = [(i, names[i], sizes[i], goals[i], blocks[i], int(quotas[i]), slices[i], steps[i], shifts[i]) for i in range(len(stats))]
    facts = spark.createDataFrame(facts, "s int, source string, source_size long, target double, n_blocks long, quota long, slices long, step long, shift long")
    rows = rows.join(F.broadcast(facts), rows["source"].eqNullSafe(facts["source"]), "left").drop(facts["source"])
    empty, rows = rows.filter("size = 0"), rows.filter("size > 0")

    # Words before each document in its source's order: those of earlier slices, then those earlier in its slice.
    rows = rows.withColumn("slice", F.floor(F.shiftrightunsigned("key", 34) * F.col("slices") / F.lit(float(1 << 30))).cast("long"))
    before = Window.partitionBy("s", "slab").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("s").orderBy("slab").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(rows.groupBy("s", "slice").agg(F.sum("size").alias("w")).withColumn("slab", F.floor(F.col("slice") / SLICES)))
    slabs = offsets.groupBy("s", "slab").agg(F.sum("w").alias("w")).select("s", "slab", F.coalesce(F.sum("w").over(earlier), F.lit(0)).alias("slabs"))
    offsets = offsets.withColumn("own", F.coalesce(F.sum("w").over(before), F.lit(0))).join(slabs, ["s", "slab"]).select("s", "slice", (F.col("own") + F.col("slabs")).alias("base"))
    inner = Window.partitionBy("s", "slice").orderBy(F.shiftrightunsigned("key", 1), "key", "id", "rid").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(offsets, ["s", "slice"])
    rows = rows.withColumn("block", F.floor((F.col("base") + F.col("inner") + F.floor(F.col("size") / 2)) / words))

    taken = block_shards(spark, facts, quotas, shards, seed).groupBy("s", "block").agg(F.array_sort(F.collect_list(F.struct("shard", "round"))).alias("draws"))
    out = rows.join(taken, ["s", "block"], "left").unionByName(empty, allowMissingColumns=True)
    none = F.array().cast("array<struct<shard:int,round:int>>")
    return out.select("key", "rid", "id", "source", "size", "source_size", "target", F.coalesce("draws", none).alias("draws"))


def coprime(rng: np.random.Generator, n: int) -> int:
    """A step that visits all of n places. Steps stay small, so that step times place fits in 64 bits."""
    while n > 2:
        if math.gcd(step := int(rng.integers(1, min(n, 1 << 28))), n) == 1:
            return step
    return 1


def block_shards(spark, facts: DataFrame, quotas: np.ndarray, shards: int, seed: int) -> DataFrame:
    """Source, block, round and shard of each block that the mix takes."""
    nodes = split(quotas, 0, shards, max(1, -(-shards // TOP_NODES)), seed)
    start, rows = np.zeros_like(quotas), []
    for lo, hi, part in nodes:
        rows.append((lo, hi, start.tolist(), part.tolist()))
        start = start + part

    def leaves(batches):
        for batch in batches:
            for lo, hi, first, part in zip(batch["lo"], batch["hi"], batch["first"], batch["part"], strict=True):
                at = np.array(first, np.int64)
                for leaf, _, own in split(np.array(part, np.int64), lo, hi, 1, seed):
                    yield pd.DataFrame({"s": np.arange(len(own), dtype=np.int32), "shard": np.int32(leaf), "at": at, "n": own})[own > 0]
                    at = at + own

    tree = spark.createDataFrame(rows, "lo int, hi int, first array<long>, part array<long>").repartition(len(rows))
    places = tree.mapInPandas(leaves, "s int, shard int, at long, n long").withColumn("place", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1)))
    places = places.join(F.broadcast(facts.select("s", "n_blocks", "quota", "step", "shift")), "s")
    turn = F.pmod(F.col("place") * F.col("step") + F.col("shift"), F.col("quota"))
    return places.select("s", "shard", F.pmod(turn, F.col("n_blocks")).alias("block"), F.floor(turn / F.col("n_blocks")).cast("int").alias("round"))


def mix_sources(docs: DataFrame, weights: Callable[[list], list[float]], share: float = 1.5, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", seed: int = 7) -> DataFrame:
    """The mixed rows: the columns of docs, once for each draw, dealt to shards and shuffled inside them.

    Columns come back as they were, whatever their names. The rows are written once with their numbers, which the
    draws are joined by. An empty table stays empty.
    """
    rows = stamped(docs)
    own = [f"c{docs.columns.index(c)}" for c in (source_col, id_col, text_col)]
    plan = mix_plan(rows, weights, share, *own, seed, rid_col="rid").filter("size(draws) > 0")
    rows = rows.join(materialize(plan.select("rid", "key", "draws")), "rid").withColumn("draw", F.explode("draws"))
    shards = rows.repartition(F.col("draw.shard")).sortWithinPartitions("draw.shard", F.xxhash64("key", "rid", "draw.round"))
    return shards.drop("rid", "key", "draws", "draw").toDF(*docs.columns)
