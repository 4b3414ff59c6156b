"""Folders that driver and executors share, and versions of tables in them that appear whole or not at all."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; on one machine, where it is unset, the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/curation/{uuid.uuid4().hex}"


def written(rows: DataFrame) -> DataFrame:
    """rows, written to a shared folder and read back: what follows plans from there, and lost executors lose none of it."""
    path = shared_folder(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def files_of(spark: SparkSession, path: str):
    """The file system of a path, and the path in it."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), there


def delete(spark: SparkSession, path: str) -> None:
    files, there = files_of(spark, path)
    files.delete(there, True)


def names_in(spark: SparkSession, path: str) -> list[str]:
    files, there = files_of(spark, path)
    return sorted(x.getPath().getName() for x in files.listStatus(there)) if files.exists(there) else []


def published(spark: SparkSession, path: str) -> int | None:
    """The newest version of a table that is whole; None if there is none."""
    marks = [int(x) for x in names_in(spark, f"{path}/published") if x.isdigit()]
    return max(marks, default=None)


def version_path(path: str, version: int) -> str:
    return f"{path}/version={version:012d}"


def advance(spark: SparkSession, path: str, version: int, rows: Callable[[int | None], DataFrame]) -> bool:
    """Writes a version of a table and then publishes it by one new, empty file: readers see the old one or the new one.

    rows gets the version before and returns what to write. A version that is published already is left as it is, and
    False returned: a step that runs again after a loss changes nothing. One that broke off is written anew. The version
    before stays, for readers that have opened it; older ones go.
    """
    before = published(spark, path)
    if before is not None and before >= version:
        return False
    rows(before).write.mode("overwrite").parquet(version_path(path, version))
    files, mark = files_of(spark, f"{path}/published/{version:012d}")
    files.create(mark, False).close()
    for name in names_in(spark, path):
        if name.startswith("version=") and int(name[8:]) < (before if before is not None else version):
            delete(spark, f"{path}/{name}")
    return True


def read_published(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The newest whole version of a table, empty where there is none. Errors of the store are raised, not taken for emptiness."""
    version = published(spark, path)
    return spark.createDataFrame([], schema) if version is None else spark.read.schema(schema).parquet(version_path(path, version))
