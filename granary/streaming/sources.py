"""Runs over sources that fail one by one: error rows in place of failed tasks, and states that outlive a broken run."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from granary.sources.folders import advance, published, read_published
from granary.streaming.batches import batch_path, read_batches, run_available

STATE = "path string, status string, bytes long, modified timestamp, config string, error string"
#: What `isolated` adds before the processor's own columns.
OUTCOME = "path string, bytes long, modified timestamp, status string, error string"
#: Rows that a task hands on at once.
ROWS = 2000


class AllFailedError(RuntimeError):
    """Not one source of a batch could be processed: the cause is not in the sources."""


def isolated(sources: DataFrame, open_processor: Callable[[], Callable[[dict], Iterable[tuple]]], schema: str) -> DataFrame:
    """OUTCOME and `schema`: the rows that a processor makes of each source, and one closing row for each source.

    A task opens its processor once. Rows of a source have a null status; its closing row says ok, or error and why, and
    then none of its rows are given. A source whose column `known` is true isn't processed: its closing row says reused.
    The rows of one source are held until it ends. A processor that can't be opened makes an error of every source.
    """
    names = [*(x.split()[0] for x in OUTCOME.split(", ")), *(x.split()[0] for x in schema.split(", "))]
    own = len(names) - 5

    def run(batches):
        process, broken = None, None
        for part in batches:
            rows: list[tuple] = []
            for source in part.to_dict("records"):
                key = (source["path"], source["bytes"], source["modified"])
                if source.get("known"):
                    rows.append((*key, "reused", None, *[None] * own))
                    continue
                try:
                    if process is None and broken is None:
                        try:
                            process = open_processor()
                        except Exception as error:  # noqa: BLE001  whatever a model raises is the sources' error
                            broken = error
                    if broken is not None:
                        raise broken
                    made = [(*key, None, None, *x) for x in process(source)]
                except Exception as error:  # noqa: BLE001  one source's error must not end the others
                    rows.append((*key, "error", f"{type(error).__name__}: {error}", *[None] * own))
                else:
                    rows += [*made, (*key, "ok", None, *[None] * own)]
                if len(rows) >= ROWS:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return sources.mapInPandas(run, f"{OUTCOME}, {schema}")


def marked(sources: DataFrame, state: DataFrame, config: str) -> DataFrame:
    """sources with `known`: whether an earlier run finished them with the same size, time and configuration."""
    done = state.filter((F.col("status") == "ok") & (F.col("config") == config)).select("path", "bytes", "modified", F.lit(True).alias("known"))
    return sources.join(done, ["path", "bytes", "modified"], "left").withColumn("known", F.coalesce("known", F.lit(False)))


def run_sources(sources: DataFrame, open_processor: Callable[[], Callable[[dict], Iterable[tuple]]], schema: str, folder: str, config: str, guard: bool = True) -> list[dict]:
    """Processes a stream of sources (path, bytes, modified and more), batch by batch, into a folder; the counters of each batch.

    Known sources are left as they are, failed ones tried again when they come again. A batch writes its rows under its
    number, then publishes the next version of the state; run again after a loss at any point, it does what is left of
    that and leaves one copy. The counters are observed while the rows are written: nothing is read twice for them.
    With `guard` a batch in which all sources fail raises AllFailedError before its state is published.
    """
    counters: list[dict] = []

    def handle(part: DataFrame, batch: int) -> None:
        spark = part.sparkSession
        if (before := published(spark, f"{folder}/sources")) is not None and before >= batch:
            return
        state, seen = read_published(spark, f"{folder}/sources", STATE), Observation()
        rows = isolated(marked(part, state, config), open_processor, schema)
        counts = {k: F.count_if(F.col("status") == v) for k, v in (("processed", "ok"), ("failed", "error"), ("reused", "reused"))}
        rows = rows.observe(seen, *(c.alias(k) for k, c in counts.items()), F.count("*").alias("rows"))
        rows.write.mode("overwrite").parquet(batch_path(folder, batch))
        if guard and seen.get["failed"] and not seen.get["processed"] + seen.get["reused"]:
            raise AllFailedError(f"all {seen.get['failed']} sources of batch {batch} failed")
        own = spark.read.schema(f"{OUTCOME}, {schema}").parquet(batch_path(folder, batch))
        news = own.filter("status in ('ok', 'error')").select("path", "status", "bytes", "modified", F.lit(config).alias("config"), "error")
        advance(spark, f"{folder}/sources", batch, lambda _: state.join(news.select("path"), "path", "left_anti").unionByName(news))
        counters.append({"batch": batch, **seen.get})

    run_available(sources, folder, "append", handle)
    return counters


def source_state(spark: SparkSession, folder: str) -> DataFrame:
    return read_published(spark, f"{folder}/sources", STATE)


def source_rows(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """What the processor last made of each source that its state calls ok."""
    found = read_batches(spark, folder, f"{OUTCOME}, {schema}, batch long").filter(F.col("batch") <= F.lit(published(spark, f"{folder}/sources")))
    last = found.filter("status = 'ok'").groupBy("path").agg(F.max("batch").alias("batch"))
    good = source_state(spark, folder).filter("status = 'ok'").select("path")
    return found.filter("status is null").join(last, ["path", "batch"]).join(good, "path", "left_semi").drop("status", "error", "batch")
