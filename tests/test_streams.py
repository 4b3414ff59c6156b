"""Streams against the same work on tables: files in any order, late frames, runs that break off, sources that fail."""

import pytest
from conftest import DATA, rows_of
from pyspark.sql import functions as F

from granary.operators.retain import retain
from granary.sources.folders import advance, delete, names_in, published, read_published
from granary.sources.views import frames
from granary.streaming import sources as runs
from granary.streaming.batches import read_batches, run_available
from granary.streaming.ordered import OUTPUT, mended, retain_stream
from granary.streaming.sources import isolated, run_sources, source_rows, source_state
from granary.streaming.windows import first_seen, read_frames, window_counts


def shuffled(spark, folder, files):
    """The events, in files that aren't in time order."""
    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.repartition(files, F.xxhash64("event_id")).write.parquet(folder)
    return read_frames(spark, folder, events.schema)


def timed_frames(events):
    time = F.col("ts").cast("timestamp")
    return events.select(time.alias("time"), F.col("user_id").alias("source"), F.col("event_id").alias("id"), (F.unix_micros(time) / 1e6).alias("seconds"), F.col("value").alias("score"), (F.col("event_id") * 2654435761 % 4611686018427387904).alias("hash"))


@pytest.mark.parametrize("files", [1, 4, 16])
def test_streams_lose_nothing(spark, tmp_path, files):
    stream, table = shuffled(spark, f"{tmp_path}/in", files), spark.read.parquet(f"{DATA}/events.parquet")
    run_available(window_counts(stream), f"{tmp_path}/w", "update")
    found = read_batches(spark, f"{tmp_path}/w", "start long, event_type string, n long, cents long, batch long")
    last = found.groupBy("start", "event_type").agg(F.max_by(F.struct("n", "cents"), "batch").alias("x")).select("start", "event_type", "x.*")
    assert rows_of(last) == rows_of(window_counts(table)) and last.agg(F.sum("n")).first()[0] == table.count()
    run_available(first_seen(stream), f"{tmp_path}/d", "append")
    assert rows_of(read_batches(spark, f"{tmp_path}/d", "event_id long")) and rows_of(spark.read.parquet(f"{tmp_path}/d/rows").select("event_id")) == rows_of(table.select("event_id").distinct())


@pytest.mark.parametrize(("files", "delay", "late"), [(1, "10 minutes", False), (4, "10 minutes", True), (4, "400 days", False), (16, "1 day", True)])
def test_frames_in_time_order(spark, tmp_path, files, delay, late):
    """What a stream keeps is what the table gives; frames that come too late are handed on, all of them, and mended."""
    stream = timed_frames(shuffled(spark, f"{tmp_path}/in", files))
    run_available(retain_stream(stream, F.col("time"), delay), f"{tmp_path}/out", "update")
    found = read_batches(spark, f"{tmp_path}/out", f"{OUTPUT}, batch long")
    assert (found.filter("late").count() > 0) == late
    assert rows_of(mended(found, frames(spark, DATA))) == rows_of(retain(frames(spark, DATA)))
    if late:  # without mending, some sources would be wrong or could be
        assert found.filter("late").select("source", "id").distinct().count() == found.filter("late").count()


SCHEMA = "k int, value double"


def numbered(spark, folder, files=4, rows=40, shift=0):
    """A stream of sources in some files: path, bytes, modified."""
    table = spark.range(rows).select(F.col("id").cast("string").alias("path"), (F.col("id") + shift).alias("bytes"), F.timestamp_seconds("id").alias("modified"))
    table.repartition(files, "path").write.mode("append").parquet(folder)
    return read_frames(spark, folder, table.schema)


def opener():
    def opened():
        def process(source):
            n = int(source["path"])
            yield 0, float(source["bytes"])
            if n % 10 == 7:
                raise ValueError(f"source {n}")
            yield 1, float(n)

        return process

    return opened  # a function of a function: tasks get it by value


def check_whole(spark, folder, rows=40):
    good = [i for i in range(rows) if i % 10 != 7]
    assert sorted((int(r["path"]), r["status"]) for r in source_state(spark, folder).collect()) == [(i, "ok" if i in good else "error") for i in range(rows)]
    assert sorted((int(r["path"]), r["k"]) for r in source_rows(spark, folder, SCHEMA).collect()) == [(i, k) for i in good for k in (0, 1)]


@pytest.mark.parametrize("when", ["before the state", "after the state", "in the rows"])
def test_runs_that_break_off(spark, tmp_path, monkeypatch, when):
    """A run that is stopped between or in batches and started again loses no source and doubles none."""
    folder, stream, calls = f"{tmp_path}/out", numbered(spark, f"{tmp_path}/in"), []
    real = runs.advance

    def broken(spark, path, version, rows):
        calls.append(version)
        if len(calls) == 2 and when == "after the state":
            real(spark, path, version, rows)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return real(spark, path, version, rows)

    def open_broken():
        raise MemoryError("no model")

    if when == "in the rows":
        with pytest.raises(Exception, match="all .* failed"):
            run_sources(stream, open_broken, SCHEMA, folder, "a")
        assert published(spark, f"{folder}/sources") is None
    else:
        monkeypatch.setattr(runs, "advance", broken)
        with pytest.raises(Exception, match="lost"):
            run_sources(stream, opener(), SCHEMA, folder, "a")
        monkeypatch.setattr(runs, "advance", real)
    counters = run_sources(stream, opener(), SCHEMA, folder, "a")
    check_whole(spark, folder)
    if when == "in the rows":
        assert sum(c["processed"] for c in counters) == 36 and sum(c["failed"] for c in counters) == 4
    assert run_sources(stream, opener(), SCHEMA, folder, "a") == []


def test_known_sources_are_reused(spark, tmp_path):
    """Sources that come again are reused unless they failed, changed, or another configuration asks."""
    folder, stream = f"{tmp_path}/out", numbered(spark, f"{tmp_path}/in", files=1)
    assert [(c["processed"], c["failed"], c["reused"], c["rows"]) for c in run_sources(stream, opener(), SCHEMA, folder, "a")] == [(36, 4, 0, 112)]
    stream = numbered(spark, f"{tmp_path}/in", files=1)
    assert [(c["processed"], c["failed"], c["reused"]) for c in run_sources(stream, opener(), SCHEMA, folder, "a")] == [(0, 4, 36)]
    check_whole(spark, folder)
    stream = numbered(spark, f"{tmp_path}/in", files=1, shift=1000)
    assert [(c["processed"], c["reused"]) for c in run_sources(stream, opener(), SCHEMA, folder, "a")] == [(36, 0)]
    check_whole(spark, folder)
    assert {r["value"] for r in source_rows(spark, folder, SCHEMA).filter("k = 0").collect()} == {1000.0 + i for i in range(40) if i % 10 != 7}


def test_isolated_errors(spark):
    rows = spark.createDataFrame([("1", 5, None), ("7", 6, None)], "path string, bytes long, modified timestamp")
    got = [(r["path"], r["status"], r["error"], r["k"]) for r in isolated(rows, opener(), SCHEMA).collect()]
    assert got == [("1", None, None, 0), ("1", None, None, 1), ("1", "ok", None, None), ("7", "error", "ValueError: source 7", None)]
    assert isolated(rows.limit(0), opener(), SCHEMA).count() == 0


def test_versions(spark, tmp_path):
    """A version that broke off is never read; the one before stays until the next is whole."""
    path = f"{tmp_path}/t"
    assert read_published(spark, path, "id long").isEmpty()
    assert advance(spark, path, 3, lambda before: spark.range(3)) and published(spark, path) == 3
    assert not advance(spark, path, 3, lambda before: spark.range(9))
    with pytest.raises(Exception, match="broken"):
        advance(spark, path, 4, lambda before: spark.range(4).select(F.raise_error(F.lit("broken")).cast("long").alias("id")))
    assert read_published(spark, path, "id long").count() == 3
    assert advance(spark, path, 4, lambda before: spark.range(4)) and advance(spark, path, 5, lambda before: spark.range(before))
    assert read_published(spark, path, "id long").count() == 4 and [x for x in names_in(spark, path) if x.startswith("version")] == ["version=000000000004", "version=000000000005"]
    delete(spark, path)
    assert published(spark, path) is None
