"""Names of files, labels and configurations as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.functions.text import fixed, json_text


def safe_stem(stem: Column) -> Column:
    """A stem with an underscore for each character but letters, numbers, - and _; 48 characters at most, `video` if empty."""
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(stem, r"[^\p{L}\p{N}_-]", "_"), 1, 48), F.lit("")), F.lit("video"))


def frame_name(stem: Column, path: Column, seconds: Column) -> Column:
    """Stem, ten digits of the path's SHA-256, and milliseconds in ten places."""
    return F.concat_ws("_", safe_stem(stem), F.left(F.sha2(path.cast("binary"), 256), F.lit(10)), F.concat(F.lpad(F.bround(seconds * 1000).cast("long").cast("string"), 10, "0"), F.lit(".jpg")))


def ranked_name(rank: Column, name: Column) -> Column:
    return F.concat(F.lpad(rank.cast("string"), 3, "0"), F.lit("_"), name)


def contact_label(rank: Column, scale_bin: Column, pose_bin: Column, similarity: Column) -> Column:
    """Rank and bins in one line, the similarity in the next."""
    return F.concat(rank.cast("string"), F.lit(": "), scale_bin, F.lit(", "), pose_bin, F.lit("\nsim="), F.coalesce(fixed(similarity, 3), F.lit("n/a")))


def parsed_bucket(text: Column, sides: tuple[int, ...] = (512, 768, 1024)) -> Column:
    """width and height of a text like 768x512; null unless both are allowed sides."""
    parts = F.split(F.lower(F.trim(text)), "x")
    w, h = (F.try_element_at(parts, F.lit(i)).try_cast("long") for i in (1, 2))
    return F.when((F.size(parts) == 2) & w.isin(*sides) & h.isin(*sides), F.struct(w.alias("width"), h.alias("height")))


def config_digest(**values: tuple[Column, str]) -> Column:
    """SHA-256 of values, each with its type, as JSON: keys in order, a space after commas and colons, nulls written."""
    parts = [F.concat(F.lit(f'"{k}": '), json_text(*values[k])) for k in sorted(values)]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")).cast("binary"), 256)


def unique_names(rows: DataFrame, key: str, name: str, path: str) -> DataFrame:
    """rows with `file`: the name, or for all but the first path of a name (without case) its stem, ten digits of the
    path's SHA-256 and suffix, and a counter where even that repeats."""
    stem, suffix = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"(\.[^.]*)?$", 1)
    rows, own = rows.withColumn("_name", F.lower(name)), F.struct(F.col(path).alias("p"), F.col(key).alias("k"))
    # A name that stands everywhere is one row here; only rows of such names by other paths are ranked, by their digests.
    first = rows.groupBy("_name").agg(F.min(own).alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    rows = rows.join(first, "_name", "left").withColumn("_other", F.col("_first").isNotNull() & ~F.col("_first").eqNullSafe(own)).withColumn("_digest", F.left(F.sha2(F.col(path).cast("binary"), 256), F.lit(10)))
    again = F.row_number().over(Window.partitionBy("_name", "_digest", "_other").orderBy(path, key))
    counter = F.when(again > 1, F.concat(F.lit("_"), again.cast("string"))).otherwise("")
    return rows.withColumn("file", F.when(F.col("_other"), F.concat(stem, F.lit("_"), F.col("_digest"), counter, suffix)).otherwise(F.col(name))).drop("_name", "_first", "_other", "_digest")
