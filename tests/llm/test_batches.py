"""Whole texts reach Python workers in small Arrow batches, in sums and in what the pipeline's stages give."""

import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA

import corpus_pipeline
from granary.llm import common

NAME = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.fixture
def seven(spark, monkeypatch):
    rows = spark.conf.get(NAME)
    monkeypatch.setattr(common, "BATCH_ROWS", 7)
    yield rows
    spark.conf.set(NAME, rows)


def test_sums_read_small_batches(spark, seven):
    def largest(batches):
        yield common.packed(np.array([max((b.num_rows for b in batches), default=0)], float))

    rows = spark.range(100).coalesce(1).mapInArrow(largest, "sums binary")
    assert common.summed(rows, 1)[0] == 7
    assert spark.conf.get(NAME) == seven


@pytest.mark.parametrize("stage", [corpus_pipeline.quality, corpus_pipeline.decontamination])
def test_stages_give_small_batches(spark, seven, stage):
    """Who writes a stage's result runs its Python over the texts: by then the session's batches must be small."""

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    docs = spark.read.parquet(f"{DATA}/documents.parquet").coalesce(1)
    got = [r["n"] for r in stage(spark, docs, DATA).mapInArrow(sizes, "n long").collect()]
    assert sum(got) > 100 and max(got) <= 7


def test_small_batches_end(spark, seven):
    with pytest.raises(ValueError), common.small_batches(spark):
        assert spark.conf.get(NAME) == "7"
        raise ValueError
    assert spark.conf.get(NAME) == seven
