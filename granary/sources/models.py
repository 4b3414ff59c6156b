"""The registry of models as a table, and whether a folder holds them as they are registered."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.sources.reports import file_digests


@dataclass(frozen=True)
class ModelSpec:
    """What a model is for, the profile it belongs to, its file, the file's SHA-256 (null: any), its number format and licence."""

    profile: str
    role: str
    file: str
    sha256: str | None = None
    precision: str = "fp32"
    licence: str | None = None


def registry(spark: SparkSession, specs: list[ModelSpec]) -> DataFrame:
    """A row for each spec. A profile has one model a role; a second one raises an error."""
    roles = [(s.profile, s.role) for s in specs]
    if len(set(roles)) < len(roles):
        raise ValueError("a profile has two models of one role")
    return spark.createDataFrame([tuple(asdict(s).values()) for s in specs], "profile string, role string, file string, sha256 string, precision string, licence string")


def model_manifest(spark: SparkSession, root: str, models: DataFrame, profile: str) -> DataFrame:
    """role, file, precision, licence, path, bytes, found_sha256 and status of a profile's models: ok, missing or corrupt.

    Files are looked for below root, whole and by name; one that stands at several places has a row for each. They are
    hashed where they lie, by Spark's tasks. A profile that isn't registered raises an error.
    """
    own = models.filter(F.col("profile") == profile)
    if own.isEmpty():
        raise ValueError(f"no profile {profile} is registered")
    found = file_digests(spark, root, own.select(F.col("role").alias("name"), "file")).withColumnsRenamed({"name": "role", "sha256": "found_sha256"})
    fits = F.col("sha256").isNull() | (F.col("sha256") == F.col("found_sha256"))
    rows = own.join(found, ["role", "file"])  # a few rows a profile
    return rows.select("role", "file", "precision", "licence", "path", "bytes", "found_sha256", F.when(F.col("path").isNull(), "missing").when(fits, "ok").otherwise("corrupt").alias("status"))
