"""Ranked lexical search: an index of compressed posting blocks with their maximum impacts, searched by Block-Max WAND.

The index is a table with one row a term and segment. A segment holds the documents of some SEGMENT_BYTES of text, so
what a task holds at once is bounded. A term's postings lie in blocks of BLOCK: first and last document, largest impact,
and the gaps between documents and the counts, in as few bytes as the block allows. A search joins the index to the terms
asked for, deals it out by segment, and moves over each segment in document order: shallow moves add up the largest
impacts of the blocks that a stretch of documents lies in, and stretches below the score of the twentieth document so
far are passed over without reading their postings. The threshold is kept from one segment of a task to the next.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.llm.common import Words, lean, materialize, slices, string_bytes

#: Postings to a block; bytes of text to a segment; bytes of queries (16 a term) that go to the tasks at once.
BLOCK, SEGMENT_BYTES, QUERY_BYTES = 128, 16 << 20, 4 << 20
#: Documents that a search scores at once, at least.
STRETCH = 1024
#: Term bytes are digits, letters and whatever is beyond ASCII.
TERM = np.zeros(256, bool)
TERM[0x30:0x3A] = TERM[0x41:0x5B] = TERM[0x61:0x7B] = TERM[0x80:] = True
#: A posting's gap and count take 1, 2, 4 or 8 bytes.
WIDTHS = np.array([1, 2, 4, 8])

INDEX = "segment long, term long, df int, firsts binary, lasts binary, impacts binary, widths binary, postings binary"


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and terms with repeats, of all documents."""

    @lean
    def run(batches):
        some = terms = 0
        for batch in batches:
            data, offsets = string_bytes(batch.column("text"))
            for a, b in slices(offsets):
                counts = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], TERM, lower=False).counts
                some, terms = some + int((counts > 0).sum()), terms + int(counts.sum())
        yield pa.RecordBatch.from_pydict({"some": pa.array([some], pa.int64()), "terms": pa.array([terms], pa.int64())})

    found = docs.select("text").mapInArrow(run, "some long, terms long").agg(F.sum("some").alias("some"), F.sum("terms").alias("terms")).first()
    return found["some"] or 0, found["terms"] or 0


def length_norm(n, some: int, terms: int):
    """A document's m, from its number of terms."""
    return 75 + (25 * n * some) // max(terms, 1)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of each term of some texts, and the number of terms of each text."""
    data, offsets = string_bytes(texts)
    hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, b in slices(offsets):
        words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], TERM)
        hashes.append(words.hashes())
        counts.append(words.counts)
    return np.concatenate(hashes), np.concatenate(counts)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each size, one after the other."""
    return np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else starts, sizes) + np.arange(sizes.sum())


def width_of(most: np.ndarray) -> np.ndarray:
    return np.searchsorted(np.array([1 << 8, 1 << 16, 1 << 32]), most, "right").astype(np.uint8)


def put(out: np.ndarray, at: np.ndarray, values: np.ndarray, width: np.ndarray) -> None:
    for byte in range(int(width.max(initial=0))):
        some = width > byte
        out[at[some] + byte] = (values[some] >> (8 * byte)) & 255


def take(data: np.ndarray, at: np.ndarray, width: np.ndarray) -> np.ndarray:
    values = np.zeros(len(at), np.int64)
    for byte in range(int(width.max(initial=0))):
        some = width > byte
        values[some] |= data[at[some] + byte].astype(np.int64) << (8 * byte)
    return values


def binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values that end at `ends`, counted in items of data."""
    offsets = np.concatenate([[0], ends]) * data.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def segment_rows(number: int, ids: pa.Array, texts: pa.Array, some: int, terms: int) -> pa.RecordBatch:
    """The index of some documents: a row for their ids and norms (without a term), and one for each term."""
    order = pc.array_sort_indices(ids, null_placement="at_end")
    ids, texts = ids.take(order), texts.take(order)
    hashes, counts = hashed(texts)
    m, row = length_norm(counts, some, terms), np.repeat(np.arange(len(counts)), counts)
    by = np.argsort(hashes, kind="stable")
    h, r = hashes[by], row[by]
    new_term = np.ones(len(h), bool)
    new_term[1:] = h[1:] != h[:-1]
    new = new_term.copy()
    new[1:] |= r[1:] != r[:-1]
    at = np.flatnonzero(new)
    tf, doc, first = np.diff(np.concatenate([at, [len(h)]])), r[at], new_term[at]
    term_at = np.flatnonzero(first)
    df = np.diff(np.concatenate([term_at, [len(at)]]))
    place = ranges(np.zeros(len(df), np.int64), df)
    block = np.flatnonzero(place % BLOCK == 0)
    size = np.diff(np.concatenate([block, [len(at)]]))
    gap = np.diff(np.concatenate([[-1], doc])) - 1
    gap[block] = 0
    best = np.maximum.reduceat(impact(tf, m[doc]), block) if len(block) else np.zeros(0, np.int64)
    wide = [width_of(np.maximum.reduceat(x, block)) if len(block) else np.zeros(0, np.uint8) for x in (gap, tf - 1)]
    each = [np.repeat(WIDTHS[w], size) for w in wide]
    both = each[0] + each[1]
    ends = np.cumsum(both)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    put(out, ends - both, gap, each[0])
    put(out, ends - each[1], tf - 1, each[1])
    last_block, last = np.cumsum(-(-df // BLOCK)), np.cumsum(df)
    lists = [binaries(doc[block].astype(np.int32), last_block), binaries(doc[block + size - 1].astype(np.int32), last_block), binaries(best, last_block), binaries(wide[0] * 4 + wide[1], last_block), binaries(out, ends[last - 1] if len(last) else last)]
    named = np.asarray(ids.is_valid())
    own = [binaries(ids.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False), np.array([len(ids)])), binaries(named.astype(np.uint8), np.array([len(ids)])), binaries(m, np.array([len(ids)])), pa.array([b""]), pa.array([b""])]
    columns = [pa.concat_arrays([a, b]) for a, b in zip(own, lists, strict=True)]
    names = [pa.array(np.full(len(df) + 1, number)), pa.concat_arrays([pa.array([None], pa.int64()), pa.array(h[at][term_at].view(np.int64))]), pa.array(np.concatenate([[len(ids)], df]).astype(np.int32))]
    return pa.RecordBatch.from_arrays(names + columns, names=["segment", "term", "df", "firsts", "lasts", "impacts", "widths", "postings"])


def build_index(docs: DataFrame, id: str = "doc_id") -> tuple[DataFrame, int, int]:
    """The index of all documents, written once; how many have a term, and how many terms they have."""
    docs = docs.select(F.col(id).cast("long").alias("id"), F.col("text"))
    some, terms = corpus_size(docs)

    @lean
    def run(batches):
        number, ids, texts, held = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            offsets = string_bytes(batch.column("text"))[1]
            for a, b in slices(offsets):
                if held and held + offsets[b] - offsets[a] > SEGMENT_BYTES:
                    yield segment_rows(number, pa.concat_arrays(ids), pa.concat_arrays(texts), some, terms)
                    number, ids, texts, held = number + 1, [], [], 0
                ids.append(batch.column("id").slice(a, b - a))
                texts.append(batch.column("text").slice(a, b - a).cast(pa.large_string()))
                held += offsets[b] - offsets[a]
        if ids:
            yield segment_rows(number, pa.concat_arrays(ids), pa.concat_arrays(texts), some, terms)

    return materialize(docs.mapInArrow(run, INDEX)), some, terms


class Segment:
    """One segment's documents, and the blocks of the terms asked for; postings are read when they are first needed."""

    def __init__(self, rows: list[dict]):
        self.ids, self.named, self.m = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)
        own = next((r for r in rows if r["term"] is None), None)
        if own:
            self.ids, self.named, self.m = np.frombuffer(own["firsts"], np.int64), np.frombuffer(own["lasts"], bool), np.frombuffer(own["impacts"], np.int64)
        rows = [r for r in rows if r["term"] is not None]

        def joined(name, kind):
            return np.frombuffer(b"".join(r[name] for r in rows), kind)

        self.first, self.last, self.best = joined("firsts", np.int32).astype(np.int64), joined("lasts", np.int32).astype(np.int64), joined("impacts", np.int64)
        wide, self.data = joined("widths", np.uint8), joined("postings", np.uint8)
        self.gap_width, self.tf_width = WIDTHS[wide >> 2], WIDTHS[wide & 3]
        df = np.array([r["df"] for r in rows], np.int64)
        blocks = -(-df // BLOCK)
        edge = np.concatenate([[0], np.cumsum(blocks)])
        self.blocks_of = {r["term"]: (int(edge[i]), int(edge[i + 1])) for i, r in enumerate(rows)}
        self.size = np.full(len(self.first), BLOCK)
        self.size[edge[1:] - 1] = df - (blocks - 1) * BLOCK
        bytes_ = self.size * (self.gap_width + self.tf_width)
        self.byte, self.post = np.cumsum(bytes_) - bytes_, np.cumsum(self.size) - self.size
        self.read = np.zeros(len(self.first), bool)
        self.doc, self.impact = np.zeros(int(self.size.sum()), np.int32), np.zeros(int(self.size.sum()), np.int32)

    def decompress(self, blocks: np.ndarray) -> None:
        blocks = blocks[~self.read[blocks]]
        if not len(blocks):
            return
        size, at = self.size[blocks], ranges(self.post[blocks], self.size[blocks])
        gap_width, tf_width = np.repeat(self.gap_width[blocks], size), np.repeat(self.tf_width[blocks], size)
        byte = np.repeat(self.byte[blocks], size) + ranges(np.zeros(len(size), np.int64), size) * (gap_width + tf_width)
        step = take(self.data, byte, gap_width) + 1
        begin = np.cumsum(size) - size
        step[begin] = 0
        total = np.cumsum(step)
        self.doc[at] = total - np.repeat(total[begin], size) + np.repeat(self.first[blocks], size)
        self.impact[at] = impact(take(self.data, byte + gap_width, tf_width) + 1, self.m[self.doc[at]])
        self.read[blocks] = True

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, least: int):
        """Documents that may be among the best k, and their scores; `least` is the score to reach. Highest first."""
        found = [(*self.blocks_of[t], w) for t, w in zip(terms.tolist(), weights.tolist(), strict=True) if t in self.blocks_of]
        none = np.zeros(0, np.int64)
        if not found:
            return none, none
        starts, stops, weight = (np.array(x, np.int64) for x in zip(*found, strict=True))
        block = ranges(starts, stops - starts)
        weight = np.repeat(weight, stops - starts)
        # Shallow moves: stretches of documents between the edges of blocks, and what their blocks can give at most.
        edges = np.unique(np.concatenate([self.first[block], self.last[block] + 1]))
        left, right = np.searchsorted(edges, self.first[block]), np.searchsorted(edges, self.last[block] + 1)
        change = np.zeros(len(edges), np.int64)
        np.add.at(change, left, weight * self.best[block])
        np.subtract.at(change, right, weight * self.best[block])
        most = np.cumsum(change)[:-1]
        width = np.diff(edges)
        docs, scores, done = none, none, most <= 0
        order = np.argsort(-most, kind="stable")
        picked = order[: int(np.searchsorted(np.cumsum(width[order]), 4 * k)) + 1]  # the most promising ones first, for a threshold
        at = 0
        while True:
            picked = picked[~done[picked] & (most[picked] >= least)]
            if len(picked):
                done[picked] = True
                wanted = np.zeros(len(most) + 1, np.int64)
                wanted[picked + 1] = 1
                wanted = np.cumsum(wanted)
                hit = wanted[right] > wanted[left]
                self.decompress(block[hit])
                size = self.size[block[hit]]
                post = ranges(self.post[block[hit]], size)
                lo, hi = edges[picked.min()], edges[picked.max() + 1]
                near = (self.doc[post] >= lo) & (self.doc[post] < hi)
                total = np.zeros(hi - lo, np.int64)
                np.add.at(total, self.doc[post[near]] - lo, np.repeat(weight[hit], size)[near] * self.impact[post[near]])
                own = ranges(edges[picked], width[picked])
                better = total[own - lo] >= max(least, 1)
                docs, scores = np.concatenate([docs, own[better]]), np.concatenate([scores, total[own[better] - lo]])
                best = np.lexsort((docs, -scores))[:k]
                docs, scores = docs[best], scores[best]
                if len(scores) == k:
                    least = max(least, int(scores[-1]))
            if at == len(most):
                return docs, scores
            alive = np.flatnonzero(~done[at:] & (most[at:] >= least)) + at
            if not len(alive):
                return docs, scores
            stop = int(np.searchsorted(np.cumsum(width[alive]), STRETCH)) + 1
            picked, at = alive[:stop], int(alive[:stop][-1]) + 1 if stop < len(alive) else len(most)


class Best:
    """The best k documents of each query so far: score, null or not, id."""

    def __init__(self, queries: int, k: int):
        self.k, self.kept = k, [np.zeros((0, 3), np.int64)] * queries

    def least(self, query: int) -> int:
        return int(self.kept[query][-1, 0]) if len(self.kept[query]) == self.k else 1

    def add(self, query: int, scores: np.ndarray, named: np.ndarray, ids: np.ndarray) -> None:
        both = np.concatenate([self.kept[query], np.column_stack([scores, ~named, ids])])
        self.kept[query] = both[np.lexsort((both[:, 2], both[:, 1], -both[:, 0]))[: self.k]]


def search_block(index: DataFrame, queries: list[tuple[int, np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """The best k documents of each query in each task: query, id, score. queries: number, terms and their weights."""
    spark = index.sparkSession
    asked = spark.createDataFrame(pa.table({"term": np.unique(np.concatenate([q[1] for q in queries]))}))  # bounded by QUERY_BYTES
    own = index.join(F.broadcast(asked), "term", "left_semi").unionByName(index.filter(F.col("term").isNull()))
    sent = spark.sparkContext.broadcast(queries)

    @lean
    def run(batches):
        best, held, segment = Best(len(sent.value), k), [], None

        def close():
            part = Segment(held)
            for i, (_, terms, weights) in enumerate(sent.value):
                docs, scores = part.search(terms, weights, k, best.least(i))
                if len(docs):
                    best.add(i, scores, part.named[docs], part.ids[docs])

        for batch in batches:
            for row in batch.to_pylist():
                if row["segment"] != segment and held:
                    close()
                    held = []
                segment = row["segment"]
                held.append(row)
        if held:
            close()
        rows = [(q[0], *x) for q, kept in zip(sent.value, best.kept, strict=True) for x in kept.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([None if r[2] else r[3] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["query", "id", "score"])

    return own.repartition("segment").sortWithinPartitions("segment").mapInArrow(run, "query long, id long, score long")


def term_weight(df: Column, some: int) -> Column:
    return F.floor(1000 * F.log(F.lit(2.0 * some + 2) / (2 * df + 1))).cast("long")


def ranked_search(docs: DataFrame, items: DataFrame, id: str = "doc_id", item: str = "item_id", k: int = 20) -> DataFrame:
    """The k highest-scoring documents of each item: item, rank, id, score; equal scores by id, null ids last.

    All documents are indexed, whole, and all items searched, in blocks of QUERY_BYTES. Each row of `items` is an item,
    whether or not its id repeats or is null; items without terms, and documents without or with null text, give no
    rows. Repeated rows and ids of documents are documents of their own. Empty tables give no rows. Extra columns are
    not read. Terms are compared by 64-bit hashes.
    """
    index, some, terms = build_index(docs, id)

    @lean
    def split(batches):
        for batch in batches:
            hashes, counts = hashed(batch.column("text"))
            number = np.repeat(batch.column("query").to_numpy(), counts)
            yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(hashes.view(np.int64))], names=["query", "term"])

    asked = materialize(items.select(F.monotonically_increasing_id().alias("query"), F.col(item).alias("item"), F.col("text")))
    counted = materialize(asked.select("query", "text").mapInArrow(split, "query long, term long").groupBy("query", "term").agg(F.count("*").alias("times")))
    blocks = max(1, -(-counted.count() * 16 // QUERY_BYTES))
    found = None
    for block in range(blocks):
        own = counted.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block)
        df = index.filter(F.col("term").isNotNull()).join(F.broadcast(own.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
        rows = own.join(F.broadcast(df), "term").select("query", "term", (F.col("times") * term_weight(F.col("df"), some)).alias("weight")).toArrow()
        query, order = rows.column("query").to_numpy(), np.lexsort((rows.column("term").to_numpy(), rows.column("query").to_numpy()))
        query, term, weight = query[order], rows.column("term").to_numpy()[order], rows.column("weight").to_numpy()[order]
        edges = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1], [True]])) if len(query) else np.zeros(1, np.int64)
        parts = [(int(query[a]), term[a:b], weight[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
        if parts:
            top = search_block(index, parts, k)
            found = top if found is None else found.unionByName(top)
    if found is None:
        found = counted.select("query", F.lit(None).cast("long").alias("id"), F.col("times").alias("score")).filter(F.lit(False))
    by = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    top = found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
    return asked.select("query", "item").join(top, "query").select("item", "rank", "id", "score")
