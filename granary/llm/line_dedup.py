"""Line dedup by winnowing: fingerprints of line windows, joined positions, matches extended to whole runs."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import id_table, in_table, join_groups, materialize, stamped

#: Repeated runs of at least so many lines are deleted.
RUN_LINES = 2


def repeated_lines(docs: DataFrame, run: int = RUN_LINES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document with the texts that stay: id_col, rid, n_lines, n_removed, kept_text.

    Lines are what newlines separate; null and empty texts have none. A line is deleted if it lies in `run` or more
    consecutive lines that also stand, alike, at an earlier place: in a document with a smaller id (null ids last;
    rows that repeat an id in input order), or further up in the same one. The first place of each run stays. What is
    earlier is judged on the input, not on what is left, so an overlap of a run with itself is deleted too.

    Every window of `run` line hashes selects its smallest, the last of equal ones; a line that windows select is a
    fingerprint, so alike windows select alike fingerprints at the same offset, and there are fewer of them than windows.
    Only fingerprints are counted; those that stand at several places are read again with their neighbours. Each later
    place is joined to the first place of its fingerprint and extended from there to the left and right, line by line:
    where the match reaches over a whole window that selected the fingerprint, the window goes, and matches of
    neighbouring fingerprints grow together to whole runs. Windows that differ from the first place's have their first
    place elsewhere: only for those is a digest of the whole window made, and its first place stays. Work and rows
    follow the number of lines: a hot line makes one row for each place, never pairs of places. Very long texts are
    lists of lines like others, one document at a time. Texts are written once with their numbers; other columns aren't
    read; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType
    rows = stamped(docs.select(id_col, text_col)).select(F.col("c0").cast("string").alias("id"), "rid", F.col("c1").alias("body"))
    prints = rows.mapInPandas(lambda batches: selected(batches, run), "print binary, key long")
    again = materialize(prints.groupBy("print", "key").agg(F.count("*").alias("n")).filter("n > 1"))
    table = id_table(again, "key")
    spots = rows.mapInPandas(lambda batches: fingerprints(batches, run, table), "rid long, id string, line int, print binary, starts array<int>, left array<binary>, right array<binary>")
    spots = materialize(spots.select("rid", F.col("id").isNull().alias("nul"), F.col("id").cast(kind).alias("id"), "line", "print", "starts", "left", "right"))
    order = F.struct("nul", "id", "rid", "line")
    first = materialize(spots.groupBy("print").agg(F.min(F.struct("nul", "id", "rid", "line", "left", "right")).alias("first"), F.count("*").alias("n")).filter("n > 1"))
    later = join_groups(spots, first, "print", "n", spots.count(), F.xxhash64("rid", "line"), "inner")
    later = later.filter((F.col("rid") != F.col("first.rid")) | (F.col("line") != F.col("first.line")))
    reach = [F.col("line") - alike("left", "first.left"), F.col("line") + alike("right", "first.right")]
    windows = later.select("rid", "nul", "id", "line", "print", "left", "right", reach[0].alias("low"), reach[1].alias("high"), F.explode("starts").alias("start"))
    windows = materialize(windows.withColumn("met", (F.col("start") >= F.col("low")) & (F.col("start") + (run - 1) <= F.col("high"))))
    back = F.col("line") - F.col("start")
    context = F.concat(F.slice("left", F.lit(1), back), F.slice("right", F.lit(1), run - 1 - back))
    rest = windows.filter("not met").select("rid", "nul", "id", "line", "start", F.md5(F.concat(back.cast("string").cast("binary"), F.col("print"), F.array_join(F.transform(context, F.hex), "").cast("binary"))).alias("key"))
    heads = materialize(rest.groupBy("key").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1"))
    other = join_groups(rest, heads, "key", "n", windows.count(), F.xxhash64("rid", "line"), "inner")
    other = other.filter((F.col("rid") != F.col("first.rid")) | (F.col("line") != F.col("first.line")))
    marks = windows.filter("met").select("rid", "start").unionByName(other.select("rid", "start")).groupBy("rid").agg(F.sort_array(F.collect_list("start")).alias("marks"))  # at most the windows of one document
    kept = rows.join(marks, "rid", "left").mapInPandas(lambda batches: cut(batches, run), "id string, rid long, n_lines long, n_removed long, kept_text string")
    return kept.select(F.col("id").cast(kind).alias(id_col), "rid", "n_lines", "n_removed", "kept_text")


def alike(own: str, other: str) -> Column:
    """How many lines from here on, in one direction, are those of the other place too."""
    same = F.zip_with(F.col(own), F.col(other), lambda a, b: F.coalesce(a == b, F.lit(False)))
    end = F.array_position(same, False)
    return F.when(end > 0, end - 1).otherwise(F.size(same)).cast("int")


def lines_of(text: str | None) -> list[str]:
    return text.split("\n") if text else []


def picks_of(digests: list[bytes], run: int) -> dict[int, list[int]]:
    """The selected lines of a document, each with the starts of the windows that select it."""
    picks: dict[int, list[int]] = {}
    for i in range(len(digests) - run + 1):
        picks.setdefault(min(range(i, i + run), key=lambda j: (digests[j], -j)), []).append(i)
    return picks


def digests_of(body: str | None) -> list[bytes]:
    return [hashlib.blake2b(x.encode(), digest_size=16).digest() for x in lines_of(body)]


def keys_of(prints: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(prints), np.int64)[::2]


def selected(batches, run: int):
    """The fingerprints of each document, without their places."""
    for batch in batches:
        prints = []
        for body in batch["body"]:
            digests = digests_of(body)
            prints += [digests[line] for line in picks_of(digests, run)]
        yield pd.DataFrame({"print": prints, "key": keys_of(prints)})


def fingerprints(batches, run: int, table: np.ndarray | None = None):
    """The selected lines of each document that may stand in a table, with the starts of the windows that selected them
    and the digests of the lines to the left and right, the nearest first, as far as a window reaches."""
    for batch in batches:
        out = []
        for id_, rid, body in zip(batch["id"], batch["rid"], batch["body"], strict=True):
            digests = digests_of(body)
            picks = picks_of(digests, run)
            may = in_table(table, keys_of([digests[line] for line in picks])) if table is not None else np.ones(len(picks), bool)
            for (line, starts), ok in zip(picks.items(), may, strict=True):
                if ok:
                    out.append((rid, id_, line, digests[line], starts, digests[max(0, line - run + 1) : line][::-1], digests[line + 1 : line + run]))
        yield pd.DataFrame(out, columns=["rid", "id", "line", "print", "starts", "left", "right"])


def cut(batches, run: int):
    for batch in batches:
        out = []
        for id_, rid, body, marks in zip(batch["id"], batch["rid"], batch["body"], batch["marks"], strict=True):
            lines, gone = lines_of(body), set()
            for i in marks if marks is not None else ():
                gone.update(range(i, i + run))
            kept = "\n".join(x for i, x in enumerate(lines) if i not in gone)
            out.append((id_, rid, len(lines), len(gone), kept))
        yield pd.DataFrame(out, columns=["id", "rid", "n_lines", "n_removed", "kept_text"])
