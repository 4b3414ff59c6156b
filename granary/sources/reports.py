"""What a run leaves behind: reports, manifests, states of sources, and the guard of the output folder."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.signals import decision_reason
from granary.sources.folders import advance, delete, files_of, published, read_published

#: What a run writes and may delete; frames and their state stay, so that runs can go on.
ARTIFACTS = ("report", "summary", "dataset_manifest", "crop_skips", "comparison", "manifest", "selected", "prepared")


def exists(spark: SparkSession, path: str) -> bool:
    files, there = files_of(spark, path)
    return files.exists(there)


def prepare_output(spark: SparkSession, root: str, overwrite: bool = False) -> None:
    """Raises for an output folder that holds anything, unless it may be overwritten: then ARTIFACTS in it go, nothing else."""
    files, there = files_of(spark, root)
    if files.exists(there) and len(files.listStatus(there)):
        if not overwrite:
            raise FileExistsError(f"{root} is not empty")
        for name in ARTIFACTS:
            delete(spark, f"{root}/{name}")


def outside(paths: list[str], root: str) -> None:
    """Raises if a path lies in the output tree."""
    inner = [p for p in paths if p == root.rstrip("/") or p.startswith(f"{root.rstrip('/')}/")]
    if inner:
        raise ValueError(f"{inner[0]} lies in the output {root}")


def reference_set(files: DataFrame, most: int = 5) -> DataFrame:
    """The distinct paths of references, in order; raises unless there are 1 to `most`."""
    paths = files.select("path").dropDuplicates().orderBy(F.lower("path"), "path")
    n = paths.limit(most + 1).count()
    if not 1 <= n <= most:
        raise ValueError(f"1 to {most} references are needed")
    return paths


def decided(records: DataFrame, selected: DataFrame, key: str) -> DataFrame:
    """records with rank, selected and decision_reason; selected has the key and rank."""
    rows = records.join(selected.select(key, "rank"), key, "left").withColumn("selected", F.col("rank").isNotNull())
    return rows.withColumn("decision_reason", decision_reason(F.col("selected"), F.col("status"), F.col("reason")))


def distributions(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """kind, value, n: how often each value stands in some columns; null counts as `None`."""
    kinds = F.explode(F.array(*(F.struct(F.lit(c).alias("kind"), F.coalesce(F.col(c).cast("string"), F.lit("None")).alias("value")) for c in columns)))
    return rows.select(kinds.alias("k")).groupBy("k.kind", "k.value").agg(F.count("*").alias("n"))


def summary(rows: DataFrame, requested: int, columns: tuple[str, ...] = ("scale_bin", "pose_bin", "light_bin")) -> DataFrame:
    """One row over the decided rows: counts, and the distributions of status and, among selected ones, of bins as maps."""
    counts = rows.agg(F.lit(requested).alias("requested"), *(F.count_if(c).alias(n) for n, c in (("selected", F.col("selected")), ("multiple_faces_review", F.col("status") == "multiple_faces_review"), ("rejected", F.col("status") == "rejected"))))
    found = distributions(rows, ("status",)).unionByName(distributions(rows.filter("selected"), columns))
    maps = [F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kind") == c, F.struct("value", "n"))))).alias(f"{c}_distribution") for c in ("status", *columns)]
    return counts.crossJoin(found.agg(*maps))  # one row each


def write_reports(root: str, records: DataFrame, selected: DataFrame, key: str, requested: int, settings: dict) -> None:
    """report (CSV with a header, a row a record) and summary (JSON: counts, distributions and settings)."""
    rows = decided(records, selected, key)
    plain = [F.col(f.name) if f.dataType.simpleString() in ("string", "boolean") or not any(x in f.dataType.simpleString() for x in "<") else F.to_json(f.name).alias(f.name) for f in rows.schema]
    rows.select(*plain).write.mode("overwrite").csv(f"{root}/report", header=True)
    summary(rows, requested).withColumn("settings", F.lit(json.dumps(settings, sort_keys=True))).write.mode("overwrite").json(f"{root}/summary")


def write_ranked(path: str, rows: DataFrame, bom: bool = False, order: tuple[str, ...] = ("rank",)) -> None:
    """Rows of a selection, in order, as one CSV file; where there are none, an earlier one goes.

    A selection has as many rows as were asked for, so that one task writes them. With `bom` the first column's name
    begins with the mark by which spreadsheets know UTF-8.
    """
    if rows.isEmpty():
        delete(rows.sparkSession, path)
        return
    ordered = rows.orderBy(*order).coalesce(1)
    ordered = ordered.withColumnRenamed(rows.columns[0], "\ufeff" + rows.columns[0]) if bom else ordered
    ordered.write.mode("overwrite").csv(path, header=True)


def write_crops(root: str, planned: DataFrame, key: str) -> None:
    """dataset_manifest and crop_skips from the crop plans of ranked rows: what each prepared row's crop is, and why the
    others have none. Both keep the ranks of the selection, so the manifest shows holes where rows were skipped."""
    box = (F.col(f"crop.{c}").cast("long").alias(c) for c in ("x1", "y1", "x2", "y2"))
    made = planned.filter("skip is null").select("rank", key, "strategy", "safety", "reasons", "bucket", *box, "focus", "excluded")
    write_ranked(f"{root}/dataset_manifest", made)
    write_ranked(f"{root}/crop_skips", planned.filter("skip is not null").select("rank", key, F.col("skip").alias("reason")))


def write_comparison(root: str, compared: DataFrame, key: str, summary: DataFrame) -> None:
    """comparison (CSV, by key without case, in as many files as the table needs) and its one-row summary (JSON)."""
    compared.orderBy(F.lower(F.col(key).cast("string")), key).write.mode("overwrite").csv(f"{root}/comparison", header=True)
    summary.write.mode("overwrite").json(f"{root}/summary")


def file_digests(spark: SparkSession, root: str, names: DataFrame) -> DataFrame:
    """name, path, bytes and sha256 of the files that a registry (name, file) lists; nulls for those that aren't there."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    return F.broadcast(names).join(files, "file", "right").filter(F.col("name").isNotNull()).unionByName(names.join(files.select("file"), "file", "left_anti"), allowMissingColumns=True).select("name", "file", "path", "bytes", "sha256")


STATE = "path string, status string, bytes long, modified timestamp, config string, error string"


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """What earlier runs noted of each source; empty where there is nothing. Rows of another layout have nulls and fit no file."""
    return read_published(spark, path, STATE)


def to_process(files: DataFrame, state: DataFrame, config: str) -> DataFrame:
    """Files (path, bytes, modified) that no earlier run finished with the same size, time and configuration."""
    done = state.filter(F.col("status") == "ok").filter(F.col("config") == config).select("path", "bytes", "modified")
    return files.join(done, ["path", "bytes", "modified"], "left_anti")


def write_state(path: str, state: DataFrame, news: DataFrame) -> None:
    """The state with newer rows in place of older ones of the same path, as a version that replaces the old one at once."""
    spark = state.sparkSession
    version = published(spark, path)
    advance(spark, path, 0 if version is None else version + 1, lambda _: state.join(news.select("path"), "path", "left_anti").unionByName(news))


def run_counters(files: DataFrame, state: DataFrame, news: DataFrame, config: str) -> DataFrame:
    """found, reused, processed and failed sources of one run."""
    found = files.agg(F.count("*").alias("found"))
    left = to_process(files, state, config).agg(F.count("*").alias("left"))
    done = news.agg(F.count_if(F.col("status") == "ok").alias("processed"), F.count_if(F.col("status") != "ok").alias("failed"))
    return found.crossJoin(left).crossJoin(done).select("found", (F.col("found") - F.col("left")).alias("reused"), "processed", "failed")  # one row each
