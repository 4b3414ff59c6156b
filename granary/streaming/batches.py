"""What streams write: one folder a batch, written again as it was if a batch runs again."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession, provider: str = ROCKS):
    """Streams that start inside keep their state in RocksDB: on the executors' disks, changes only in the checkpoint."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, provider)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def batch_path(folder: str, batch: int) -> str:
    return f"{folder}/rows/batch={batch}"


def write_batch(folder: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the rows of a batch, under its number. The same batch run twice leaves one copy."""

    def write(part: DataFrame, batch: int) -> None:
        part.write.mode("overwrite").parquet(batch_path(folder, batch))

    return write


def run_available(rows: DataFrame, folder: str, mode: str, handle: Callable[[DataFrame, int], None] | None = None) -> None:
    """Reads what is there, from where an earlier run of the same folder stopped, batch by batch."""
    query = rows.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state")
    with state_store(rows.sparkSession):
        query.foreachBatch(handle or write_batch(folder)).trigger(availableNow=True).start().awaitTermination()


def read_batches(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The rows of all batches, each with its number."""
    return spark.read.schema(schema).option("basePath", f"{folder}/rows").parquet(f"{folder}/rows/batch=*").withColumn("batch", F.col("batch").cast("long"))
