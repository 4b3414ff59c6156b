"""Suffix-array dedup: two-stage suffix sorting over blocks of text that may repeat, and adjacent common prefixes.

Every window of `length` bytes is led by its smallest k-byte hash, its anchor. Windows that are equal have equal
anchors, so only windows whose anchor stands at two places or more can repeat. Pieces of text that hold all such
windows of one anchor come together, a few MB to a block. In a block, the suffixes that are smaller than their
successors are sorted directly, all others are induced from them by bucket scans, and windows that share `length`
bytes with a neighbour in the suffix array repeat. Pieces of an anchor with many places go to several blocks; the
windows which those leave single, and one of each repeated kind, are then combined by their digests.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.llm.common import _BYTE, id_table, in_table, join_groups, lean, materialize, mix, powers, slices, string_bytes

#: Bytes of a repeated string; bytes of an anchor's hash; bytes of pieces in a block; places of an anchor in a block.
LENGTH, ANCHOR, BLOCK_BYTES, BLOCK_PLACES = 400, 24, 2 << 20, 4096
#: Bytes of the stretches inside a window that need an anchor of their own.
STRETCH = 104
#: A longer text is read in segments that overlap by a window.
SEGMENT = 1 << 22
_PLACE_BITS = 23
#: Texts that a task remembers; part of all places from which an anchor is hot.
SEEN_MOST, HOT_SHARE = 1 << 20, 1024


def rolling(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes from each position on; the last k - 1 positions are left out."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[data] * up[:-1], out=sums[1:])
    return mix((sums[k:] - sums[:n]) * down[:n])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours, from minima that run forwards and backwards inside blocks of w."""
    n = len(x)
    full = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = x
    blocks = full.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def anchors_at(data: np.ndarray, ends: np.ndarray, length: int):
    """Start of each stretch of `length` bytes that stays in its text, place of its anchor, and all hashes.

    ends holds, for each byte, where its text ends.
    """
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64)
    hashes = rolling(data, ANCHOR)
    order = (hashes >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | np.arange(len(hashes), dtype=np.uint64)
    at = (sliding_min(order, length - ANCHOR + 1) & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    start = np.flatnonzero(np.arange(len(at)) + length <= ends[: len(at)])
    return start, at[start], hashes


def segments(offsets: np.ndarray, length: int):
    """Ranges of rows that are read together, with the byte range; a long row comes in overlapping segments."""
    for lo, hi in slices(offsets):
        begin, end = int(offsets[lo]), int(offsets[hi])
        step = SEGMENT - length + 1
        for at in range(begin, max(end, begin + 1), step) if end - begin > SEGMENT else (begin,):
            yield lo, hi, at, min(end, at + SEGMENT)
            if at + SEGMENT >= end:
                break


def segment_rows(data: np.ndarray, offsets: np.ndarray, length: int):
    """The segments with, for each byte, its row and where the row ends in the segment."""
    for lo, hi, begin, end in segments(offsets, length):
        inner = np.clip(offsets[lo : hi + 1], begin, end) - begin
        row = np.repeat(np.arange(lo, hi), np.diff(inner))
        yield begin, data[begin:end], row, inner[1:][row - lo]


def all_anchors(data: np.ndarray, offsets: np.ndarray, length: int):
    """Row, hash, first stretch and number of stretches of the anchors of all texts that are long enough for a window.

    The stretches of a text that have one anchor start at neighbouring places. Rows and stretches stand in order.
    """
    stretch, out = min(STRETCH, length), []
    long = np.diff(offsets) >= length
    for begin, part, row, ends in segment_rows(data, offsets, length):
        start, at, hashes = anchors_at(part, ends, stretch)
        keep = long[row[start]]
        if begin + len(part) < offsets[row[-1] + 1] if len(row) else False:  # the next segment reads the rest
            keep &= start < SEGMENT - length + 1
        start, at = start[keep], at[keep]
        new = np.ones(len(start), bool)
        new[1:] = (at[1:] != at[:-1]) | (np.diff(start) > 1)
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(start)))
        start, at = start[first], at[first]
        out.append((row[start], start + begin - offsets[row[start]], size, hashes[at], at + begin - offsets[row[start]]))
    if not out:
        return [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)]
    row, start, size, hashes, at = (np.concatenate(x) for x in zip(*out, strict=True))
    new = np.ones(len(row), bool)  # an anchor may go on in the next segment
    new[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1]) | (start[1:] != start[:-1] + size[:-1])
    first = np.flatnonzero(new)
    size = np.add.reduceat(size, first) if len(first) else size
    return [row[first], start[first], size, hashes[first]]


def lists(values: np.ndarray, edges: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(values, kind))


def digests(data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
    """SHA-256 of each text, and its first 64 bits, by which equal texts are known."""
    sha = [hashlib.sha256(data[s:e].tobytes()).hexdigest() for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return sha, np.array([int(x[:16], 16) for x in sha], np.uint64).view(np.int64)


def unseen(ids: np.ndarray, seen: set) -> np.ndarray:
    """Which ids this task meets for the first time, as far as it remembers."""
    if len(seen) > SEEN_MOST:
        seen.clear()
    fresh = np.zeros(len(ids), bool)
    fresh[np.unique(ids, return_index=True)[1]] = True
    fresh &= np.array([x not in seen for x in ids.tolist()], bool)
    seen.update(ids.tolist())
    return fresh


def read_anchors(batches, length: int):
    """A row for each document: its digest, and its anchors unless the task has met the text before."""
    seen: set[int] = set()
    for batch in batches:
        data, offsets = string_bytes(batch.column("body"))
        n = batch.num_rows
        sha, tid = digests(data, offsets)
        row, start, size, hashes = all_anchors(data, offsets, length)
        own = unseen(tid, seen)[row]
        row, start, size, hashes = row[own], start[own], size[own], hashes[own]
        edges = np.searchsorted(row, np.arange(n + 1))
        yield pa.RecordBatch.from_arrays([
            batch.column("id"), batch.column("rid"), pa.array(np.diff(offsets)), pa.array(sha), pa.array(tid),
            lists(hashes.view(np.int64), edges, pa.int64()), lists(start, edges, pa.int64()), lists(size, edges, pa.int32()),
        ], names=["id", "rid", "bytes", "sha", "tid", "keys", "starts", "sizes"])


def plan_pieces(batches, length: int):
    """From the repeated anchors of each text alone: the pieces that hold its candidate windows, by anchor.

    A window is a candidate if all stretches in it have repeated anchors. Its anchor is the least of theirs; of equal
    ones, the first. Neighbouring windows with one anchor's hash are a piece.
    """
    inner = length - min(STRETCH, length)
    for batch in batches:
        marks = batch.column("marks")
        flat = marks.flatten()
        start, size, key, number = (flat.field(c).to_numpy().astype(np.int64) for c in ("start", "size", "key", "n"))
        row = np.repeat(np.arange(batch.num_rows), marks.value_lengths().to_numpy())
        order = np.lexsort((start, row))
        row, start, size, key, number = (x[order] for x in (row, start, size, key, number))
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + size[:-1])
        edges = np.append(np.flatnonzero(new), len(row))
        out = []
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            total = int(size[lo:hi].sum())
            for at in range(0, total - inner, SEGMENT):
                part = np.repeat(np.arange(lo, hi), size[lo:hi])[at : at + SEGMENT + inner] if at or total > SEGMENT + inner else np.repeat(np.arange(lo, hi), size[lo:hi])
                rank = (key[part].view(np.uint64) >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | (part - part[0]).astype(np.uint64)
                best = (sliding_min(rank, inner + 1) & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64) + part[0]
                first = np.flatnonzero(np.concatenate([[True], key[best[1:]] != key[best[:-1]]]))
                out.append((np.full(len(first), row[lo]), start[lo] + at + first, np.diff(np.append(first, len(best))), key[best[first]], number[best[first]]))
        if not out:
            continue
        row, begin, windows, key, number = (np.concatenate(x) for x in zip(*out, strict=True))
        live = np.unique(row)
        edges = np.append(np.searchsorted(row, live), len(row))
        yield pa.RecordBatch.from_arrays([batch.column("tid").take(pa.array(live)), *(lists(x, edges, pa.int64()) for x in (begin, windows, key, number))], names=["tid", "begin", "windows", "keys", "numbers"])


def cut_pieces(batches, length: int):
    """The bytes of the planned pieces."""
    for batch in batches:
        data, offsets = string_bytes(batch.column("body"))
        row = np.repeat(np.arange(batch.num_rows), batch.column("begin").value_lengths().to_numpy())
        begin, windows, key, number = (batch.column(c).flatten().to_numpy() for c in ("begin", "windows", "keys", "numbers"))
        tid = batch.column("tid").to_numpy()[row]
        left = offsets[row] + begin
        parts = [data[s : s + m].tobytes() for s, m in zip(left.tolist(), (windows + length - 1).tolist(), strict=True)]
        slots = -(-number // BLOCK_PLACES)
        slot = (mix(mix(tid.view(np.uint64)) + begin.astype(np.uint64)) % slots.astype(np.uint64)).astype(np.int32) if len(row) else np.zeros(0, np.int32)
        yield pa.RecordBatch.from_arrays([
            pa.array(key), pa.array(slot, pa.int32()), pa.array(slots > 1), pa.array(tid), pa.array(begin), pa.array(windows), pa.array(parts, pa.binary()),
        ], names=["key", "slot", "hot", "tid", "start", "windows", "piece"])


def words_at(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as a number, so that numbers compare as bytes do; zeros follow the end."""
    full = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(text), np.uint64)
    for j in range(8):
        out |= full[j : j + len(text)] << np.uint64(56 - 8 * j)
    return out


def sort_direct(at: np.ndarray, words: np.ndarray, windows: np.ndarray, matter: np.ndarray, length: int) -> np.ndarray:
    """Suffixes in the order of their first `length` bytes, those that don't matter by their first 8 only.

    windows is a hash of `length` bytes: of equal ones one is sorted. Groups that are alike so far are parted by their
    next 8 bytes; groups whose next 8 bytes agree are left as they are.
    """
    own = at[matter[at]]
    _, sorted_, back = np.unique(windows[own], return_index=True, return_inverse=True)
    pick = np.argsort(words[own[sorted_]], kind="stable")
    lead = own[sorted_][pick]
    number = np.empty(len(pick), np.int64)
    key = words[lead]
    fresh = np.ones(len(lead), bool)
    fresh[1:] = key[1:] != key[:-1]
    group = np.cumsum(fresh) - 1
    open_ = np.flatnonzero(np.bincount(group)[group] > 1) if len(lead) else pick
    group = group[open_]
    kept = np.arange(len(lead))
    for depth in range(8, length, 8):
        if not len(open_):
            break
        place = lead[kept[open_]] + depth
        ahead = np.where(place < len(words), words[np.minimum(place, len(words) - 1)], np.uint64(0))
        together = group[1:] == group[:-1]
        uneven = np.zeros(int(group[-1]) + 1, bool)
        uneven[group[1:][together & (ahead[1:] != ahead[:-1])]] = True
        part = np.flatnonzero(uneven[group])
        if len(part):
            order = part[np.lexsort((ahead[part], group[part]))]
            kept[open_[part]], ahead[part] = kept[open_[order]], ahead[order]
        fresh = np.ones(len(open_), bool)
        fresh[1:] = ~together | (ahead[1:] != ahead[:-1])
        group = np.cumsum(fresh) - 1
        more = np.bincount(group)[group] > 1
        open_, group = open_[more], group[more]
    number[pick[kept]] = np.arange(len(kept))
    rank = np.empty(len(at))
    rank[matter[at]] = number[back]
    rest = ~matter[at]
    rank[rest] = np.searchsorted(key, words[at[rest]], "right") - 0.5
    return at[np.lexsort((words[at], rank))]


def suffix_array(text: np.ndarray, words: np.ndarray, windows: np.ndarray, last: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """All suffixes in the order of their first `length` bytes, in two stages.

    last and ends: each piece's last window and its end. What stands behind the first small suffix after the last
    window has no bearing on any window.

    A suffix is small if it is smaller than the one that starts a byte later. Small suffixes are sorted directly. The
    buckets of first bytes are then scanned upwards: in each, the large suffixes stand before the small ones, in the
    order in which their successors were met, those that go on with the same byte last.
    """
    n = len(text)
    differs = np.flatnonzero(text[1:] != text[:-1])
    then = np.append(differs, n - 1)[np.searchsorted(differs, np.arange(n))]  # the last byte of each run
    small = np.zeros(n, bool)
    inner = then < n - 1
    small[inner] = text[then[inner]] < text[then[inner] + 1]
    at = np.flatnonzero(small)
    after = np.append(at, n)[np.searchsorted(at, last)]
    spare = after + 1 < ends
    change = np.zeros(n + 1, np.int64)
    change[after[spare] + 1] -= 1
    change[ends[spare]] += 1
    matter = np.cumsum(change)[:-1] == 0
    direct = sort_direct(at, words, windows, matter, length)
    head = text[direct]
    edge = np.searchsorted(head, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[int(text[-1])].append(np.array([n - 1]))
    out = []
    for c in range(256):
        large = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        parts, more = [large], large
        while len(more):
            more = more[(more > 0)] - 1
            more = more[(text[more] == c)] if len(more) else more
            parts.append(more)
        bucket = np.concatenate([*parts, direct[edge[c] : edge[c + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        first = text[before]
        before, first = before[first > c], first[first > c]
        if len(before):
            order = np.argsort(first, kind="stable")
            before, first = before[order], first[order]
            cuts = np.flatnonzero(np.diff(first)) + 1
            for part in np.split(before, cuts):
                waiting[int(text[part[0]])].append(part)
    return np.concatenate(out)


def common_prefixes(a: np.ndarray, b: np.ndarray, words: np.ndarray, length: int) -> np.ndarray:
    """Whether the suffixes at a and b share `length` bytes, read 8 at a time."""
    live = np.arange(len(a))
    for depth in [*range(0, length - 7, 8), length - 8]:
        live = live[words[a[live] + depth] == words[b[live] + depth]]
    same = np.zeros(len(a), bool)
    same[live] = True
    return same


def repeated_windows(pieces: list[bytes], windows: np.ndarray, times: np.ndarray, length: int):
    """The windows of some distinct pieces in the order of their content: piece, window, and the number of their kind.

    times tells how many places a piece has. Windows of a kind stand together; also how many places have it.
    """
    sizes = np.array([len(p) for p in pieces], np.int64)
    text = np.frombuffer(b"".join(pieces), np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    words = words_at(text)
    hashes = np.concatenate([rolling(text, length), np.arange(length - 1, dtype=np.uint64)])
    array = suffix_array(text, words, hashes, starts + windows - 1, starts + sizes, length)
    piece = np.repeat(np.arange(len(pieces)), sizes)[array]
    inside = array - starts[piece]
    valid = inside < windows[piece]
    array, piece, inside = array[valid], piece[valid], inside[valid]
    new = np.ones(len(array), bool)
    new[1:] = ~common_prefixes(array[:-1], array[1:], words, length)
    kind = np.cumsum(new) - 1
    return piece, inside, kind, np.bincount(kind, weights=times[piece]).astype(np.int64)


FOUND = pa.schema([("tid", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("known", pa.bool_())])


def solve(batches, length: int):
    """For blocks of whole keys: ranges of windows that repeat; for hot keys also the windows that are left over."""
    held: list[pa.RecordBatch] = []
    size = 0
    last = None
    for batch in batches:
        key, slot = batch.column("key").to_numpy(), batch.column("slot").to_numpy()
        lengths = np.cumsum(batch.column("windows").to_numpy() + length - 1)
        edges = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (slot[1:] != slot[:-1])])) if len(key) else []
        for lo, hi in zip(edges, [*edges[1:], len(key)], strict=True):
            if size >= BLOCK_BYTES and last != (key[lo], slot[lo]):
                yield from block(held, length)
                held, size = [], 0
            last = (key[lo], slot[lo])
            held.append(batch.slice(lo, hi - lo))
            size += int(lengths[hi - 1] - (lengths[lo - 1] if lo else 0))
    if held:
        yield from block(held, length)


def block(held: list[pa.RecordBatch], length: int):
    table = pa.Table.from_batches(held)
    tid, start, windows, hot = (table.column(c).to_numpy() for c in ("tid", "start", "windows", "hot"))
    coded = table.column("piece").combine_chunks().dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    code, pieces = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    one = np.zeros(len(pieces), np.int64)
    one[code] = np.arange(len(code))
    times = np.bincount(code, minlength=len(pieces))
    piece, inside, kind, count = repeated_windows(pieces, windows[one], times, length)
    again = count[kind] > 1
    order = np.lexsort((inside[again], piece[again]))
    p, w = piece[again][order], inside[again][order]
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]) | (w[1:] > w[:-1] + 1)
    first = np.flatnonzero(new)
    stop = w[np.append(first[1:], len(p)) - 1] + length if len(first) else w
    p, w = p[first], w[first]
    edges = np.searchsorted(p, np.arange(len(pieces) + 1))
    runs = edges[code + 1] - edges[code]
    place = np.repeat(np.arange(len(code)), runs)
    which = np.repeat(edges[code], runs) + np.arange(len(place)) - np.repeat(np.cumsum(runs) - runs, runs)
    yield found(tid[place], start[place] + w[which], start[place] + stop[which])
    if hot.any():
        lead = np.concatenate([[True], kind[1:] != kind[:-1]]) & hot[one[piece]]
        at = np.flatnonzero(lead)
        for lo in range(0, len(at), 100_000):
            part = at[lo : lo + 100_000]
            both = np.frombuffer(b"".join(hashlib.blake2b(pieces[a][b : b + length], digest_size=16).digest() for a, b in zip(piece[part].tolist(), inside[part].tolist(), strict=True)), np.int64).reshape(-1, 2)
            owner = one[piece[part]]
            begin = start[owner] + inside[part]
            yield found(tid[owner], begin, begin + length, both[:, 0], both[:, 1], count[kind[part]] > 1)


def found(tid, start, end, d1=None, d2=None, known=None) -> pa.RecordBatch:
    n = len(tid)
    cols = [tid, start, end, d1, d2, known]
    return pa.RecordBatch.from_arrays([pa.nulls(n, f.type) if c is None else pa.array(c, f.type) for c, f in zip(cols, FOUND, strict=True)], schema=FOUND)


def strip(batches):
    """The text without the marked ranges, and their number and bytes once they are merged."""
    for batch in batches:
        data, offsets = string_bytes(batch.column("body"))
        spans, kept, removed, runs, shas = batch.column("spans").to_pylist(), [], [], [], []
        for i, own in enumerate(spans):
            body, at, out, n = data[offsets[i] : offsets[i + 1]].tobytes(), 0, [], 0
            end = -1
            for s in sorted(own or [], key=lambda x: x["start"]):
                if s["start"] > end:
                    out.append(body[at : s["start"]])
                    n += 1
                end = max(end, s["end"])
                at = end
            out.append(body[at:])
            rest = b"".join(out)
            kept.append(rest)
            shas.append(hashlib.sha256(rest).hexdigest())
            removed.append(len(body) - len(rest))
            runs.append(n)
        yield pa.RecordBatch.from_arrays([batch.column("tid"), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary()), pa.array(shas)], names=["tid", "n_removed", "n_spans", "kept", "kept_sha256"])


def texts_of(docs: DataFrame, asked: DataFrame | None) -> DataFrame:
    """tid, body of the distinct texts whose ids stand in `asked`, and perhaps some more; of all texts without it."""
    table = None if asked is None else docs.sparkSession.sparkContext.broadcast(id_table(asked, "tid"))

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            _, tid = digests(*string_bytes(batch.column("body")))
            keep = unseen(tid, seen)
            if table is not None:
                keep &= in_table(table.value, tid)
            at = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([pa.array(tid).take(at), batch.column("body").take(at)], names=["tid", "body"])

    return docs.select("body").mapInArrow(lean(run), "tid long, body string").dropDuplicates(["tid"])


def repeated_anchors(read: DataFrame) -> DataFrame:
    """tid, key, start, size, n of the anchors whose hash stands at n places, n > 1.

    Hot hashes are found on a sixteenth of the documents: fewer than HOT_SHARE of them have more than that part of
    its places. They are counted by partial sums and their counts go to the tasks; all others are counted by a shuffle.
    """
    def places(rows: DataFrame) -> DataFrame:
        return rows.select("tid", F.explode(F.arrays_zip("keys", "starts", "sizes")).alias("x")).select(F.col("x.keys").alias("key"), "tid", F.col("x.starts").alias("start"), F.col("x.sizes").alias("size"))

    some = read.filter(F.pmod(F.xxhash64("rid"), F.lit(16)) == 3).select(F.explode("keys").alias("key"))
    least = max(16, some.count() // HOT_SHARE)
    hot = [r["key"] for r in some.groupBy("key").count().filter(F.col("count") > least).select("key").collect()]
    rows = places(read)
    if not hot:
        return rows.withColumn("n", F.count("*").over(Window.partitionBy("key"))).filter("n > 1")
    counts = dict(rows.filter(F.col("key").isin(hot)).groupBy("key").count().collect())
    shared = read.sparkSession.sparkContext.broadcast(counts)
    cold = rows.filter(~F.col("key").isin(hot)).withColumn("n", F.count("*").over(Window.partitionBy("key")))
    warm = read.select("tid", "keys", "starts", "sizes").mapInArrow(lean(lambda b: hot_places(b, shared.value)), "key long, tid long, start long, size int, n long")
    return cold.unionByName(warm).filter("n > 1")


def hot_places(batches, counts: dict[int, int]):
    """The places of some anchors, with the number that each has in all."""
    names = np.sort(np.array(list(counts), np.int64))
    numbers = np.array([counts[k] for k in names.tolist()], np.int64)
    for batch in batches:
        keys = batch.column("keys").flatten().to_numpy()
        at = np.minimum(np.searchsorted(names, keys), len(names) - 1)
        hit = np.flatnonzero(names[at] == keys)
        row = np.repeat(np.arange(batch.num_rows), batch.column("keys").value_lengths().fill_null(0).to_numpy())[hit]
        starts, sizes = (batch.column(c).flatten().to_numpy()[hit] for c in ("starts", "sizes"))
        yield pa.RecordBatch.from_arrays([pa.array(keys[hit]), pa.array(batch.column("tid").to_numpy()[row]), pa.array(starts), pa.array(sizes, pa.int32()), pa.array(numbers[at[hit]])], names=["key", "tid", "start", "size", "n"])


def repeated_strings(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = False) -> DataFrame:
    """One row a document: id_col, rid, n_bytes, n_removed, n_spans, kept_sha256, and, if asked for, kept (bytes).

    Removed is each byte covered by a string of `length` bytes of UTF-8 that also starts anywhere else, in the same or
    another document; strings are judged on the input. Null counts as empty; rows that repeat an id or a text are
    documents of their own, so of copies of at least `length` bytes nothing stays. Longer texts than SEGMENT are read
    in segments that overlap. Other columns aren't read. An empty table gives no rows.

    Equal texts, known by 64 bits of their SHA-256, take part once. Which windows may repeat follows from the hashes
    and places of anchors alone; texts are read again only to cut the pieces that hold those windows, and once more to
    hash what is left of them. Nothing relies on the order or place of rows.
    """
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.monotonically_increasing_id().alias("rid"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    read = materialize(rows.mapInArrow(lean(lambda b: read_anchors(b, length)), "id string, rid long, bytes long, sha string, tid long, keys array<long>, starts array<long>, sizes array<int>"))
    texts = materialize(read.groupBy("tid").agg(F.count("*").alias("copies"), F.any_value("bytes").alias("n_bytes"), F.any_value("sha").alias("sha")))
    marks = repeated_anchors(read).groupBy("tid").agg(F.collect_set(F.struct("start", "size", "key", "n")).alias("marks"))
    plan = materialize(marks.mapInArrow(lean(lambda b: plan_pieces(b, length)), "tid long, begin array<long>, windows array<long>, keys array<long>, numbers array<long>"))
    pieces = texts_of(rows, plan).join(plan, "tid").mapInArrow(lean(lambda b: cut_pieces(b, length)), "key long, slot int, hot boolean, tid long, start long, windows long, piece binary")
    pieces = pieces.repartition("key", "slot").sortWithinPartitions("key", "slot")
    hits = materialize(pieces.mapInArrow(lean(lambda b: solve(b, length)), "tid long, start long, end long, d1 long, d2 long, known boolean"))
    span = F.struct("tid", "start", "end")
    left = hits.filter("d1 is not null").groupBy("d1", "d2").agg(F.count("*").alias("n"), F.collect_list(F.when(~F.col("known"), span)).alias("spans"))
    left = left.filter("n > 1").select(F.explode("spans").alias("s")).select("s.*")  # a row a block and kind of window
    spans = hits.filter("d1 is null").select("tid", "start", "end").unionByName(left)
    spans = spans.groupBy("tid").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    spans = materialize(spans.join(texts.filter(~whole).select("tid"), "tid"))
    bodies = texts_of(rows, None if with_bytes else spans).join(spans, "tid", "left" if with_bytes else "inner")
    cut = bodies.mapInArrow(lean(strip), "tid long, n_removed long, n_spans long, kept binary, kept_sha256 string")
    columns = {
        "n_removed": F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))),
        "n_spans": F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long"),
        "kept_sha256": F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "sha")),
    }
    if with_bytes:
        columns["kept"] = F.when(whole, F.lit(b"")).otherwise(F.col("kept"))
    by_text = texts.join(cut if with_bytes else cut.drop("kept"), "tid", "left")
    by_text = materialize(by_text.withColumns(columns).select("tid", "copies", "n_bytes", *columns))
    out = join_groups(read.select("id", "rid", "tid"), by_text, "tid", "copies", read.count(), F.xxhash64("rid"))
    return out.select(F.col("id").cast(kind).alias(id_col), "rid", "n_bytes", *columns)
