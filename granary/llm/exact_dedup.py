"""Exact dedup by skew-safe combining: local, then salted, then global groups of whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import join_groups, materialize

#: Groups of one digest are first merged in so many parts.
PARTS = 16
#: A run of white space that isn't one space already.
RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), RUNS, " ")


def assign_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=None) -> DataFrame:
    """One row a document: id_col, keep_id, group_size, kept, text_sha256.

    Texts are copies of each other when they are equal after each run of white space became one space; null counts
    as empty, and all empty texts are one group. The smallest id stays (null ids last); of rows that repeat that id,
    one stays. Group sizes count every row. Columns other than the two named are not read, so their names can't clash.

    Partial aggregation merges whole texts inside each input task, a shuffle by (digest, part, text) merges a
    digest's parts, and a second one merges the parts' winners: the smallest id and the number of rows go along. Each
    step compares the texts themselves. Members then find their group by its digest, which one text has; if several
    texts have it, those rows find it by digest and text. An empty table gives no rows.
    """
    digest = digest or (lambda text: F.sha2(text.cast("binary"), 256))
    rows = docs.select(F.col(id_col).alias("id"), normalized(F.col(text_col)).alias("body"))
    rows = rows.withColumn("digest", digest(F.col("body")))
    part = F.pmod(F.spark_partition_id(), F.lit(PARTS))
    # The smallest id that isn't null is null only where all are: plain minima, so that aggregation hashes and sorts no texts.
    local = rows.groupBy("digest", part.alias("part"), "body").agg(F.count("*").alias("n"), F.min("id").alias("best"))
    bodies = local.groupBy("digest", "body").agg(F.sum("n").alias("n"), F.min("best").alias("best"))
    found = bodies.groupBy("digest").agg(F.count("*").alias("bodies"), F.sum("n").alias("group_size"), F.min("best").alias("keep_id"))
    found = materialize(found.select("digest", "bodies", "group_size", "keep_id", F.col("digest").alias("class")))
    members = rows.select("id", "digest", F.sha2(F.col("body").cast("binary"), 256).alias("text_sha256"))
    members = materialize(members.withColumn("rid", F.monotonically_increasing_id()))
    out = join_groups(members, found, "digest", "group_size", members.count(), F.xxhash64("rid"))
    if not found.filter("bodies > 1").isEmpty():
        clash = found.filter("bodies > 1").select("digest")
        own = bodies.join(clash, "digest", "left_semi").select(F.col("digest"), F.sha2(F.col("body").cast("binary"), 512).alias("class"), "body", F.col("n").alias("group_size"), F.col("best").alias("keep_id"))
        other = rows.join(clash, "digest", "left_semi").withColumn("text_sha256", F.sha2(F.col("body").cast("binary"), 256)).join(own, ["digest", "body"]).drop("body")
        out = out.filter("bodies = 1").drop("bodies").unionByName(materialize(other.withColumn("rid", -1 - F.monotonically_increasing_id())))
    again = out.groupBy("class", "id").agg(F.min("rid").alias("first"), F.count("*").alias("times")).filter("times > 1").drop("times")
    again = materialize(again)
    if not again.isEmpty():  # of rows that repeat an id and a text one stays
        out = out.alias("o").join(again.alias("a"), F.expr("o.class = a.class and o.id <=> a.id"), "left").select("o.*", "first")
    else:
        out = out.withColumn("first", F.col("rid"))
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("rid") == F.coalesce("first", "rid"))
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), "text_sha256")
