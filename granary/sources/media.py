"""Scans of media folders, and scorers that stand behind a mapInPandas boundary."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The suffixes of images and videos.
IMAGES = ("jpg", "jpeg", "png", "webp", "bmp", "tif", "tiff")
VIDEOS = ("avi", "m4v", "mkv", "mov", "mp4", "webm")


def scan_media(spark: SparkSession, root: str, suffixes: tuple[str, ...] = IMAGES, recursive: bool = True, outside: str | None = None, content: bool = False) -> DataFrame:
    """path, bytes and modified time (and content, if asked for) of media files under root, by path without case.

    Files under `outside` (an output tree) are left out. Without content the files' bytes aren't read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(root)
    files = files.filter(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*suffixes))
    if outside:
        tree = f"{outside.rstrip('/')}/"
        own = F.when(F.lit("://" in tree or tree.startswith("file:")), F.col("path")).otherwise(F.regexp_replace("path", "^[a-z]+:/*/", "/"))
        files = files.filter(~own.startswith(tree))
    columns = [F.col("path"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified")] + ([F.col("content")] if content else [])
    return files.select(*columns).orderBy(F.lower("path"), "path")


def with_scores(df: DataFrame, open_scorer: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str, where=None) -> DataFrame:
    """Rows scored by a model that each task opens once. Rows outside `where` never reach it and come back with nulls.

    A scorer takes a part of the rows and returns the columns of `schema` for them, in the same order.
    """
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = open_scorer()
        for part in parts:
            yield pd.concat([part.reset_index(drop=True), scorer(part).reset_index(drop=True)], axis=1)

    asked = df if where is None else df.filter(where)
    scored = asked.mapInPandas(run, f"{own}, {schema}")
    return scored if where is None else scored.unionByName(df.filter(~F.coalesce(where, F.lit(False))), allowMissingColumns=True)


class Stage(NamedTuple):
    """A model of a cascade: which rows reach it, judged by their columns and what earlier stages gave, how it is opened, and what it gives."""

    gate: Callable[[pd.DataFrame], pd.Series]
    open: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]
    schema: str


def with_stages(df: DataFrame, stages: list[Stage]) -> DataFrame:
    """Rows with the columns of a cascade of models, cheap ones first, and stage_error.

    Rows are read once and pass all stages in one task, a part at a time: a model sees only the rows that its gate lets
    through, and is opened when the first such row comes. What a row doesn't reach stays null. A model that fails on a
    part, or can't be opened, gives nulls and its error to that part's rows; later stages go on with what is there.
    """
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    names = [[c.split()[0] for c in s.schema.split(", ")] for s in stages]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorers: list = [None] * len(stages)
        for part in parts:
            part = part.reset_index(drop=True)
            errors = pd.Series([None] * len(part), dtype=object)
            for i, stage in enumerate(stages):
                part = part.assign(**dict.fromkeys(names[i]))
                asked = part
                try:
                    asked = part[stage.gate(part).fillna(False).astype(bool)]
                    if len(asked):
                        scorers[i] = scorers[i] or stage.open()
                        found = scorers[i](asked).set_index(asked.index)
                        for c in names[i]:
                            part[c] = found[c].reindex(part.index)
                except Exception as error:  # noqa: BLE001  a stage's error belongs to its rows
                    errors.loc[asked.index] = f"stage {i}: {type(error).__name__}: {error}"
            yield part.assign(stage_error=errors)

    return df.mapInPandas(run, ", ".join([own, *(s.schema for s in stages), "stage_error string"]))
