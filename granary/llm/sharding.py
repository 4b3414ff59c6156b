"""Sharding by extendible hashing: a directory over the first bits of a hash, where only oversized buckets split."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.llm.common import materialize, stamped

#: Production limit of a shard's text bytes.
SHARD_BYTES = 8 * 1024 * 1024
#: Bits by which the first, and the later readings of the keys look deeper at once.
STEP_BITS, LATER_BITS = 14, 6
#: 62 bits of a hash of id and text, then 62 bits of the row's number for rows that repeat both.
MOST_BITS = 124


def begin(high: str, low: str, bits: int):
    """The first bits of two columns of 62 bits, zeros after them: where the bucket of that depth begins."""
    keep = [((1 << 62) - 1) ^ ((1 << (62 - min(bits, 62))) - 1), ((1 << 62) - 1) ^ ((1 << (124 - max(bits, 62))) - 1)]
    return [F.col(c).bitwiseAND(F.lit(k)) for c, k in zip((high, low), keep, strict=True)]


#: A bucket: its depth in bits, where it begins among h1 (l1) and h2 (l2), and what it holds.
BUCKET = "depth int, l1 long, l2 long, bytes long, rows long"


def shard_directory(keys: DataFrame, limit: int) -> DataFrame:
    """The buckets, with the columns of BUCKET. keys has h1, h2 (62 bits each) and bytes.

    A bucket splits on its next bit while its bytes are over the limit and it has more than one row. Each turn sums
    the rows under the buckets that are still too large by their next bits, and those sums for each bit less; what
    fits while the bucket one bit up doesn't is done. Buckets stay in tables, only how many are left reaches the
    driver; every row is summed about once for each STEP_BITS bits of the directory's depth.
    """
    total, rows = keys.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    left = int(rows > 1 and total > limit)
    done = keys.sparkSession.createDataFrame([(0, 0, 0, total, rows)] if rows and not left else [], BUCKET)
    usual = max(0, math.ceil(math.log2(max(1, total / limit)))) + 3
    depth, open_ = 0, None
    over = (F.col("bytes") > limit) & (F.col("rows") > 1)
    while left and depth < MOST_BITS:
        to = min(MOST_BITS, depth + (min(STEP_BITS, usual - depth) if depth < usual else LATER_BITS))
        own = keys if open_ is None else keys.withColumns(dict(zip(("l1", "l2"), begin("h1", "h2", depth), strict=True))).join(open_.select("l1", "l2"), ["l1", "l2"], "left_semi")
        fine = own.select(*(c.alias(n) for n, c in zip(("l1", "l2"), begin("h1", "h2", to), strict=True)), "bytes").groupBy("l1", "l2").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows"))
        above = F.explode(F.array(*(F.struct(F.lit(d).alias("depth"), *(c.alias(n) for n, c in zip(("l1", "l2"), begin("l1", "l2", d), strict=True))) for d in range(depth + 1, to + 1)))).alias("at")
        nodes = fine.select(above, "bytes", "rows").groupBy("at").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).select("at.*", "bytes", "rows")
        nodes = materialize(nodes)
        higher = nodes.filter(over & (F.col("depth") < to)).select((F.col("depth") + 1).alias("depth"), F.col("l1").alias("u1"), F.col("l2").alias("u2"))
        last = [F.when(F.col("depth") <= 62, F.expr("shiftleft(1L, 62 - least(depth, 62))")).otherwise(0), F.when(F.col("depth") > 62, F.expr("shiftleft(1L, 124 - greatest(depth, 62))")).otherwise(0)]
        lower = nodes.filter(F.col("depth") > depth + 1).withColumns({u: F.col(x).bitwiseAND(F.bitwise_not(bit.cast("long"))) for u, x, bit in zip(("u1", "u2"), ("l1", "l2"), last, strict=True)})
        found = nodes.filter(F.col("depth") == depth + 1).unionByName(lower.join(higher, ["depth", "u1", "u2"], "left_semi").select(*nodes.columns))
        rest = over & (F.col("depth") == to) & F.lit(to < MOST_BITS)
        done, open_, depth = done.unionByName(found.filter(~over | ((F.col("depth") == to) & ~rest))), materialize(found.filter(rest)), to
        left = open_.count()
    return done


def numbered(buckets: DataFrame) -> DataFrame:
    """Buckets with shard, a number from 0 in the order of their prefixes."""
    rows = materialize(buckets.repartitionByRange("l1", "l2").sortWithinPartitions("l1", "l2").withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # a row a partition
    return rows.join(F.broadcast(parts), "part").withColumn("shard", (F.col("base") + F.col("at") - F.shiftleft(F.col("part").cast("long"), 33)).cast("long")).drop("part", "at", "base")


def assign_shards(docs: DataFrame, limit: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with shard, shard_bits, shard_prefix, shard_bytes and shard_rows.

    A shard's texts hold at most `limit` bytes of UTF-8; a text that alone is longer has a shard of its own. Shards
    are numbered by the order of their prefixes, and no shard is empty. Null and empty texts have no bytes and go
    where their hash says. Rows that repeat id and text are split by their number in the written input. Columns of docs
    with the names above are replaced; all others come back as they were. An empty table has no shards.

    The directory has an entry for each prefix of a common depth, with the shards that begin under it: one, or a chain
    of deeper ones. A row looks up its entry and takes the last shard of the chain that begins at or before its hash.
    Rows that repeat id and text share a hash: where they are split further, they have a directory of their own by the
    bits of their numbers, so that they neither meet in one task nor carry a long chain.
    """
    added = ("shard", "shard_bits", "shard_prefix", "shard_bytes", "shard_rows")
    docs = docs.drop(*added)
    rows, mask = stamped(docs), F.lit((1 << 62) - 1)
    text = F.col(f"c{docs.columns.index(text_col)}")
    keyed = rows.withColumns({"h1": F.xxhash64(F.lit(11), F.col(f"c{docs.columns.index(id_col)}"), text).bitwiseAND(mask), "h2": F.xxhash64(F.lit(12), F.col("rid")).bitwiseAND(mask)})
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    facts = materialize(numbered(shard_directory(materialize(keyed.select("h1", "h2", size.alias("bytes"))), limit)))
    deepest, count = facts.agg(F.coalesce(F.max("depth"), F.lit(0)), F.count("*")).first()
    depth = min(62, deepest, 4 + max(0, math.ceil(math.log2(max(1, count)))))
    facts = facts.select("l1", "l2", "shard", F.col("depth").alias("shard_bits"), F.substr(F.concat(*(F.lpad(F.conv(F.col(c).cast("string"), 10, 2), 62, "0") for c in ("l1", "l2"))), F.lit(1), F.col("depth")).alias("shard_prefix"), F.col("bytes").alias("shard_bytes"), F.col("rows").alias("shard_rows"))
    flat, repeats = facts.filter("shard_bits <= 62"), facts.filter("shard_bits > 62")
    first = F.shiftrightunsigned("l1", 62 - depth)
    entries = flat.withColumn("entry", F.explode(F.sequence(first, first + F.expr(f"shiftleft(1L, greatest(0, {depth} - shard_bits))") - 1)))
    chain = F.array_sort(F.collect_list(F.struct("l1", "l2", *added)))  # as long as hashes happen to crowd
    directory = bounded_broadcast(entries.groupBy("entry").agg(chain.alias("chain")), 1 << depth)
    if deepest > 62:
        hot = repeats.groupBy(F.col("l1").alias("h1")).agg((F.max("shard_bits") - 62).alias("bits"))
        groups = hot.count()
        hot = bounded_broadcast(hot, groups)
        own = repeats.join(hot.withColumnRenamed("h1", "l1"), "l1").withColumn("low", F.expr("shiftrightunsigned(l2, 62 - bits)"))
        own = own.withColumn("low", F.explode(F.expr("sequence(low, low + shiftleft(1L, bits - (shard_bits - 62)) - 1)"))).select(F.col("l1").alias("h1"), "low", F.struct("l1", "l2", *added).alias("at"))
        crowded = keyed.join(hot, "h1").withColumn("low", F.expr("shiftrightunsigned(h2, 62 - bits)")).join(own, ["h1", "low"])
        keyed = keyed.join(hot, "h1", "left_anti")
    begun = F.filter("chain", lambda x: (x["l1"] < F.col("h1")) | ((x["l1"] == F.col("h1")) & (x["l2"] <= F.col("h2"))))
    found = keyed.withColumn("entry", F.shiftrightunsigned("h1", 62 - depth)).join(directory, "entry").withColumn("at", F.element_at(begun, -1))
    names = [*(f"c{i}" for i in range(len(docs.columns))), "at"]
    found = found.select(*names).unionByName(crowded.select(*names)) if deepest > 62 else found
    return found.select(*names[:-1], *(F.col("at")[c] for c in added)).toDF(*docs.columns, *added)


def bounded_broadcast(rows: DataFrame, size: int) -> DataFrame:
    """rows, to be broadcast if they are 2 ** 18 at most."""
    return F.broadcast(rows) if size <= 1 << 18 else rows


def write_shards(assigned: DataFrame, path: str) -> None:
    """Writes a folder a shard. A shard is within its byte limit, so one task can write it."""
    assigned.repartition("shard").sortWithinPartitions("shard").write.partitionBy("shard").parquet(path)
