"""Best frames of each source in time order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

KEEP, NEAR_SECONDS, NEAR_BITS = 3, 1.5, 6


def offer(kept: list[tuple], frame: tuple, keep: int = KEEP) -> list[tuple]:
    """What stays of the kept frames (score, seconds, hash, id), best first, once another one is offered.

    A frame near a kept one, in time or by hash, takes the place of the best such if its score is higher, else it goes.
    """
    near = next((i for i, other in enumerate(kept) if abs(frame[1] - other[1]) < NEAR_SECONDS or (frame[2] ^ other[2]).bit_count() <= NEAR_BITS), None)
    if near is not None:
        if frame[0] <= kept[near][0]:
            return kept
        kept = kept[:near] + kept[near + 1 :]
    return sorted([*kept, frame], key=lambda x: (-x[0], x[1], x[3]))[:keep]


def retain(frames: DataFrame, batch_rows: int = 10_000) -> DataFrame:
    """source, id and score of each source's kept frames: sources are dealt out and read in time order, a few kept frames at a time in memory."""

    def run(batches):
        source, kept = None, []
        for part in batches:
            out = []
            for row in part.itertuples(index=False):
                if row.source != source:
                    out += [(source, x[3], x[0]) for x in kept]
                    source, kept = row.source, []
                kept = offer(kept, (row.score, row.seconds, int(row.hash), int(row.id)))
            if out:
                yield pd.DataFrame(out, columns=["source", "id", "score"])
        if kept:
            yield pd.DataFrame([(source, x[3], x[0]) for x in kept], columns=["source", "id", "score"])

    ordered = frames.select("source", "id", "seconds", "score", "hash").repartition("source").sortWithinPartitions("source", "seconds", "id")
    return ordered.mapInPandas(run, "source long, id long, score double")
