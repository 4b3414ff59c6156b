"""The training-corpus pipeline: five stages over documents, each on all that its predecessor kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import cleared, limit_batches, shared_dir, small_batches
from granary.llm.decontaminate import remove_contaminated
from granary.llm.mixing import cyclic_weights, mix_sources
from granary.llm.near_dup import keep_one_of_each
from granary.llm.quality import keep_good
from granary.llm.sharding import assign_shards


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go: low quality or toxic ones."""
    limit_batches(spark)  # for the session: whole texts pass through Python when the caller writes what this gives
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    limit_batches(spark)
    return remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources at their target weights; a document stands in it once for each time it is drawn."""
    return mix_sources(docs, cyclic_weights(5, 2, 1), share=1.5)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with the shard it belongs to."""
    shards = assign_shards(docs)
    return shards.select("doc_id", "source", "shard", "shard_bits", "shard_prefix", "shard_bytes", "shard_rows", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("mixing sources", mixing), ("sharding", sharding)]

#: The classifier is trained and the mix is drawn at random, which SQL can't express; a test runs each stage on its own input, holds near duplicates and decontamination against plain versions, the others to what must be true of them, and run() to the same documents.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written to the shared folder and read again.

    What a stage wrote on its way is deleted once its result is there. An empty table goes through all stages; rows
    that repeat a document are one after the second stage, and stand in the mix as often as they are drawn.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/{uuid.uuid4().hex}-{name.replace(' ', '-')}"
        with cleared(spark), small_batches(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
