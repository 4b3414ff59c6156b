"""Benchmark decontamination: suffix arrays over shards of the documents, searched for every benchmark suffix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import Words, lean, mix, slices, string_bytes

#: Words to a window; bytes of documents to a shard; bytes of benchmark text that go to the tasks at once.
WINDOW, SHARD_BYTES, BLOCK_BYTES = 10, 1 << 20, 8 << 20
#: Word bytes are digits, small letters and whatever is beyond ASCII.
WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True
#: A suffix is sorted by so many words at least; a longest match is followed further word by word.
SORTED_WORDS = 64


class Benchmark:
    """The suffixes of some items, as numbers of a small vocabulary; 0 ends each item."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int):
        words = Words(*string_bytes(pa.array(texts, pa.string())), WORD)
        hashes = words.hashes()
        self.vocabulary = np.unique(hashes)
        self.ids = sorted(set(ids))
        place = {x: i for i, x in enumerate(self.ids)}
        number = np.searchsorted(self.vocabulary, hashes) + 1
        at = np.arange(len(number)) + words.row
        self.text = np.zeros(len(number) + len(ids) + window + 1, np.int64)
        self.text[at] = number
        left = words.first[1:][words.row] - np.arange(len(number))
        counts = words.counts[words.row]
        whole = (left >= window) | ((counts < window) & (left == counts))
        self.start, self.length = at[whole], np.minimum(left, window)[whole]
        self.item = np.array([place[ids[r]] for r in words.row[whole]], np.int64)
        self.shortest = int(self.length.min(initial=window))
        self.pairs = np.unique(mix(hashes[:-1] * np.uint64(3) + hashes[1:])) if len(hashes) > 1 else np.zeros(0, np.uint64)
        self.filters = [self.bits(self.vocabulary), self.bits(self.pairs)]

    @staticmethod
    def bits(keys: np.ndarray) -> np.ndarray:
        table = np.zeros(1 << 20, bool)
        table[(keys >> np.uint64(44)).astype(np.int64)] = True
        return table

    def known(self, hashes: np.ndarray, which: int = 0) -> np.ndarray:
        keys = (self.vocabulary, self.pairs)[which]
        maybe = np.flatnonzero(self.filters[which][(hashes >> np.uint64(44)).astype(np.int64)])
        found = np.zeros(len(hashes), bool)
        if len(keys) and len(maybe):
            at = np.minimum(np.searchsorted(keys, hashes[maybe]), len(keys) - 1)
            found[maybe] = keys[at] == hashes[maybe]
        return found


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of text, but those of 0, in the order of what follows, by `depth` words or more."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step = 1
    while step < depth:
        then = np.zeros_like(rank)
        then[:-step] = rank[step:] + 1
        both = rank * (len(rank) + 2) + then
        rank = np.unique(both, return_inverse=True)[1].astype(np.int64)
        if rank.max(initial=0) == len(rank) - 1:
            break
        step *= 2
    order = np.argsort(rank, kind="stable")
    return order[text[order] > 0]


def bound(text: np.ndarray, suffixes: np.ndarray, b: Benchmark, after: bool) -> np.ndarray:
    """For each benchmark suffix, the first place whose suffix isn't before it (after: is past it), by its window."""
    lo, hi = np.zeros(len(b.start), np.int64), np.full(len(b.start), len(suffixes))
    while (lo < hi).any():
        mid = np.minimum((lo + hi) // 2, len(suffixes) - 1)
        sign, place = np.zeros(len(lo), np.int64), suffixes[mid]
        for j in range(int(b.length.max(initial=0))):
            open_ = (sign == 0) & (j < b.length)
            sign = np.where(open_, np.sign(text[np.minimum(place + j, len(text) - 1)] - b.text[b.start + j]), sign)
        less = (sign <= 0) if after else (sign < 0)
        go = lo < hi
        lo, hi = np.where(go & less, mid + 1, lo), np.where(go & ~less, mid, hi)
    return lo


def search(hashes: np.ndarray, words: Words, b: Benchmark):
    """Start, length, item and longest match of each occurrence of a window among the words of one shard."""
    none = np.zeros(0, np.int64)
    known = b.known(hashes)
    if b.shortest > 1 and len(hashes) > 1:  # only suffixes inside runs of known pairs can hold a match
        pair = b.known(mix(hashes[:-1] * np.uint64(3) + hashes[1:]), 1) & (words.row[:-1] == words.row[1:])
        known = np.zeros(len(hashes), bool)
        known[:-1] |= pair
        known[1:] |= pair
    places = np.flatnonzero(known)
    if not len(places) or not len(b.start):
        return none, none, none, none
    new = np.ones(len(places), bool)
    new[1:] = (np.diff(places) > 1) | (words.row[places[1:]] != words.row[places[:-1]])
    run = np.cumsum(new) - 1
    keep = np.bincount(run)[run] >= b.shortest
    places, run = places[keep], run[keep]
    if not len(places):
        return none, none, none, none
    run = np.unique(run, return_inverse=True)[1]
    text, back = np.zeros(len(places) + run[-1] + 2, np.int64), np.zeros(len(places) + run[-1] + 2, np.int64)
    at = np.arange(len(places)) + run
    text[at], back[at] = np.searchsorted(b.vocabulary, hashes[places]) + 1, places
    suffixes = suffix_array(text, SORTED_WORDS)
    first, last = bound(text, suffixes, b, False), bound(text, suffixes, b, True)
    n = last - first
    which = np.repeat(np.arange(len(n)), n)
    found = suffixes[np.repeat(first, n) + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)]
    longest, more = b.length[which].copy(), np.arange(len(which))
    while len(more):
        end, other = found[more] + longest[more], b.start[which[more]] + longest[more]
        same = text[end] > 0
        same &= text[end] == b.text[np.minimum(other, len(b.text) - 1)]
        more = more[same]
        longest[more] += 1
    return back[found], b.length[which], b.item[which], longest


SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
FOUND = pa.schema([("n_words", pa.int64()), ("spans", SPAN), ("items", pa.list_(pa.string())), ("longest", pa.int32()), ("longest_item", pa.string()), ("longest_start", pa.int32())])
FOUND_SQL = "n_words long, spans array<struct<start:int,end:int>>, items array<string>, longest int, longest_item string, longest_start int"


def scan(texts: pa.Array, b: Benchmark) -> list[pa.Array]:
    """The columns of FOUND for some texts."""
    out = []
    data, offsets = string_bytes(texts)
    for lo, hi in slices(offsets, SHARD_BYTES):
        words = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], WORD)
        start, length, item, longest = search(words.hashes(), words, b)
        row = words.row[start] if len(start) else start
        order = np.lexsort((item, start, row))
        start, length, item, longest, row = (x[order] for x in (start, length, item, longest, row))
        edges = np.searchsorted(row, np.arange(hi - lo + 1))
        for i in range(hi - lo):
            a, z = edges[i], edges[i + 1]
            if a == z:
                out.append((int(words.counts[i]), [], [], 0, None, None))
                continue
            own = start[a:z] - words.first[i]
            ends = np.maximum.accumulate(own + length[a:z])
            new = np.flatnonzero(np.concatenate([[True], own[1:] > ends[:-1]]))
            spans = [{"start": int(s), "end": int(e)} for s, e in zip(own[new], ends[np.append(new[1:], len(own)) - 1], strict=True)]
            top = int(np.argmax(longest[a:z]))
            out.append((int(words.counts[i]), spans, [b.ids[j] for j in np.unique(item[a:z])], int(longest[a + top]), b.ids[item[a + top]], int(own[top])))
    return [pa.array([x[k] for x in out], field.type) for k, field in enumerate(FOUND)]


def with_matches(rows: DataFrame, text_col: str, b) -> DataFrame:
    """rows with the columns of FOUND; b is a broadcast Benchmark."""

    def run(batches):
        for batch in batches:
            columns = scan(batch.column(text_col), b.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *FOUND.names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(lean(run), f"{schema}, {FOUND_SQL}")


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row a document: id_col, n_words, n_hit, spans, items, longest, longest_item, longest_start.

    spans are merged ranges of words inside occurrences of a window (`window` words of an item, or all of a shorter
    item); items are the sorted item ids with occurring windows; longest is the longest verbatim match in words that
    such an occurrence grows to, with its item and the word where it starts (of equal ones the first, then the smaller
    id). Null and empty texts have no words;
    items without words match nothing; items that repeat a text all count. Ids may repeat or be null.

    The benchmark goes to the tasks in blocks of BLOCK_BYTES of text: one pass of the documents for a block, and
    where there are several, their results are combined by document. Each task sorts suffixes of about a MB of text at once;
    a longer text is one such shard, whole.
    """
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("rid"), F.col(text_col).alias("body"))
    parts = [with_matches(rows, "body", sc.broadcast(b)).drop("body") for b in blocks(benchmark, window, item_col, item_text_col)]
    found = parts[0]
    if len(parts) > 1:
        for part in parts[1:]:
            found = found.unionByName(part)
        match, order = F.struct("longest", "longest_item", "longest_start"), F.struct(-F.col("longest"), "longest_start", "longest_item")
        found = found.groupBy("rid").agg(F.any_value("id").alias("id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.min_by(match, order).alias("best"))
        found = found.select("id", "rid", "n_words", merged("spans").alias("spans"), F.array_sort("items").alias("items"), "best.*")
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + (x["end"] - x["start"]).cast("long"))
    return found.select(F.col("id").alias(id_col), "n_words", hit.alias("n_hit"), "spans", "items", "longest", "longest_item", "longest_start")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs without any occurrence of a benchmark window, their columns as they were."""
    kept = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    text = f"c{docs.columns.index(text_col)}"
    for b in blocks(benchmark, window, item_col, item_text_col):
        kept = with_matches(kept, text, docs.sparkSession.sparkContext.broadcast(b)).filter(F.size("items") == 0).select(*kept.columns)
    return kept.toDF(*docs.columns)


def merged(name: str):
    """Spans in order, those that meet made one."""
    none = F.array().cast("array<struct<start:int,end:int>>")

    def add(acc, x):
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= x["start"]), grown).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.array_sort(name), none, add)


def blocks(benchmark: DataFrame, window: int, item_col: str, text_col: str):
    """The benchmark in blocks of at most BLOCK_BYTES of text (or one item), and at least one."""
    ids, texts, size, any_ = [], [], 0, False
    for id_, text in benchmark.select(F.col(item_col).cast("string"), text_col).toLocalIterator():
        ids.append(id_ or "")
        texts.append(text)
        size += len((text or "").encode())
        if size >= BLOCK_BYTES:
            yield Benchmark(ids, texts, window)
            ids, texts, size, any_ = [], [], 0, True
    if ids or not any_:
        yield Benchmark(ids, texts, window)
