"""Detectors that make several rows of one: table functions for LATERAL joins, one model a task, error rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

#: Columns that come before the detector's own: the place of a detection among its row's, and why there is none.
PLACE = "det int, error string"


def register_detector(spark: SparkSession, name: str, open_detector: Callable[[], Callable[..., Iterable[tuple]]], schema: str) -> None:
    """Registers a table function: for a row's arguments PLACE and `schema`, a row for each detection.

    A task opens its detector once, when its first row comes. A row whose detection fails gives one row with det -1 and
    the error, and none of what it had found until then; the detections of one row are held until it ends.
    """
    own = schema.count(",") + 1

    class Detect:
        def __init__(self):
            self.detect = None

        def eval(self, *given):
            try:
                if self.detect is None:
                    self.detect = open_detector()
                found = [(i, None, *x) for i, x in enumerate(self.detect(*given))]
            except Exception as error:  # noqa: BLE001  whatever a model raises is that row's error
                found = [(-1, f"{type(error).__name__}: {error}", *[None] * own)]
            yield from found

    spark.udtf.register(name, udtf(Detect, returnType=f"{PLACE}, {schema}", useArrow=True))


def detected(rows: DataFrame, name: str, *arguments: str, outer: bool = False) -> DataFrame:
    """rows with the columns of a registered detector, a row for each detection; `outer` keeps rows without any."""
    spark = rows.sparkSession
    view = f"_detected_{name}"
    rows.createOrReplaceTempView(view)
    join = "LEFT JOIN LATERAL" if outer else "CROSS JOIN LATERAL"  # a row meets its own detections, no others
    return spark.sql(f"SELECT r.*, d.* FROM {view} r {join} {name}({', '.join(f'r.{a}' for a in arguments)}) d{' ON TRUE' if outer else ''}")
