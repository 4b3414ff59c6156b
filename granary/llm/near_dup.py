"""N-gram Jaccard join: prefixes of token combinations, forests of candidates, exact verification, components.

Tokens are hashes of word shingles. A token's class follows from a counting table of fixed size that covers all
documents: rare tokens are indexed one by one, frequent ones by pairs, very frequent ones by triples. A set's prefix
stands in the order of class, then hash, and is extended until it holds one more disjoint chance to meet than the set
may miss tokens, so that any two sets over the threshold share an indexed combination.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import Words, id_table, in_table, join_groups, lean, materialize, mix, shingles, slices, stamped, string_bytes

#: Words to a shingle; least similarity in percent.
SHINGLE, PERCENT = 5, 80
#: Counters of the table, in bits; parts it is summed in, and sums of each; documents beyond chance that make a token
#: (very) frequent.
TABLE_BITS, TABLE_PARTS, TABLE_TREE, FREQUENT, VERY_FREQUENT = 20, 16, 8, 32, 1024
#: Least bits of a set's parity map; sets to a block of a signature that very many have.
MAP_BITS, HOT_ROWS = 512, 1 << 14
#: Rows of the index, and rows with maps, that a task takes at once, in whole buckets; a bucket of more rows than the
#: third is compared row by row.
INDEX_ROWS, CHUNK_ROWS, SMALL_BUCKET = 500_000, 60_000, 32
#: Sets to a block of those that are compared for links, and columns of tokens that are.
LINK_ROWS, LINK_TOKENS = 1024, 4096
#: Sets of up to 9 tokens are indexed as small, those from 8 on as large: similar ones always share a kind.
SMALL_MOST, LARGE_LEAST = 9, 8


def token_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the distinct shingles of each text, in order. Texts of fewer words have one, of all their words."""
    w = Words(data, offsets)
    h = w.hashes()
    rows, out = [], []
    if len(h) >= k:
        same = w.row[: len(h) - k + 1] == w.row[k - 1 :]
        rows.append(w.row[: len(h) - k + 1][same])
        out.append(shingles(h, k)[same])
    for n in range(1, k):
        short = np.flatnonzero(w.counts == n)
        if len(short):
            rows.append(short)
            out.append(shingles(h, n)[w.first[short]])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    row, token = np.concatenate(rows), np.concatenate(out)
    order = np.lexsort((token, row))
    row, token = row[order], token[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (token[1:] != token[:-1])
    return row[new], token[new]


def set_ids(row: np.ndarray, token: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit id of each row's set."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(token ^ np.uint64(0x5851F42D4C957F2D)))])
    edges = np.searchsorted(row, np.arange(n + 1))
    return mix(sums[edges[1:]] - sums[edges[:-1]] + np.diff(edges).astype(np.uint64)).view(np.int64)


def parity_maps(row: np.ndarray, token: np.ndarray, n: int) -> list[bytes]:
    """For each row, bits that tell whether an odd number of its tokens fell on them; about one bit for a token."""
    sizes = np.bincount(row, minlength=n)
    bits = np.maximum(MAP_BITS, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
    base = np.concatenate([[0], np.cumsum(bits)])
    spot = base[row] + (token & (bits[row] - 1).astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(spot, minlength=int(base[-1])) & 1).astype(np.uint8)).tobytes()
    return [packed[s:e] for s, e in zip((base[:-1] // 8).tolist(), (base[1:] // 8).tolist(), strict=True)]


SETS = pa.schema([("id", pa.string()), ("rid", pa.int64()), ("n", pa.int32()), ("sid", pa.int64()), ("map", pa.binary()), ("part", pa.int32()), ("counts", pa.binary())])


def read_sets(batches, k: int):
    """A row for each document, and at the end the counting table of what this task read, in parts."""
    table = np.zeros(1 << TABLE_BITS, np.int32)
    for batch in batches:
        data, offsets = string_bytes(batch.column("body"))
        for lo, hi in slices(offsets):
            n = hi - lo
            row, token = token_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], k)
            table += np.bincount((token >> np.uint64(64 - TABLE_BITS)).astype(np.int64), minlength=len(table)).astype(np.int32)
            sizes = np.bincount(row, minlength=n)
            maps = parity_maps(row, token, n)
            yield pa.RecordBatch.from_arrays([
                batch.column("id").slice(lo, n), batch.column("rid").slice(lo, n), pa.array(sizes, pa.int32()),
                pa.array(set_ids(row, token, n), pa.int64(), mask=sizes == 0), pa.array(maps, pa.binary()),
                pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()),
            ], schema=SETS)
    parts = [zlib.compress(x.tobytes(), 1) for x in np.split(table, TABLE_PARTS)] if table.any() else []
    none = pa.nulls(len(parts), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.nulls(len(parts), pa.string()), none, none.cast(pa.int32()), none, pa.nulls(len(parts), pa.binary()), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], schema=SETS)


def sum_table(batches):
    """Sums the parts of counting tables that reach one task."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts"), strict=True):
            own = np.frombuffer(zlib.decompress(counts.as_py()), np.int64 if batch.schema.get_field_index("wide") >= 0 else np.int32).astype(np.int64)
            sums[part] = sums[part] + own if part in sums else own
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in sums.values()], pa.binary())], names=["part", "counts"])


def token_classes(sets: DataFrame) -> np.ndarray:
    """For each counter of the table its class (1, 2 or 3) and, times 4, the rounded-up logarithm of its documents beyond chance.

    A megabyte, whatever the input. Tables are summed in two steps, so that no task reads those of all tasks.
    """
    parts = sets.filter("part is not null").select("part", "counts", F.pmod(F.spark_partition_id(), F.lit(TABLE_TREE)).alias("branch"))
    parts = parts.repartition(TABLE_PARTS * TABLE_TREE, "part", "branch").select("part", "counts").mapInArrow(lean(sum_table), "part int, counts binary")
    parts = parts.withColumn("wide", F.lit(True)).repartition(TABLE_PARTS, "part").mapInArrow(lean(sum_table), "part int, counts binary")
    table = np.zeros((TABLE_PARTS, (1 << TABLE_BITS) // TABLE_PARTS), np.int64)
    for part, counts in parts.collect():
        table[part] += np.frombuffer(zlib.decompress(counts), np.int64)
    table = table.ravel()
    usual = table.mean() + 6 * np.sqrt(table.mean())
    level = np.ceil(np.log2(np.maximum(table, 1))).astype(np.uint8)
    return ((1 + (table > usual + FREQUENT).astype(np.uint8) + (table > usual + VERY_FREQUENT)) + 4 * level).astype(np.uint8)


def signatures(row: np.ndarray, token: np.ndarray, n: int, classes: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and value of the indexed combinations of each set (rows in order, tokens in order within them), and the
    rounded-up logarithm of how many documents may have a triple; 0 for single tokens and pairs, which few have.

    `left` is how many tokens a similar set may miss, so a prefix needs left + 1 chances: a token of class k counts
    as one once k - 1 others of its group stand before it, since k shared tokens of a group make a shared
    combination. Groups are ranges of hashes that hold about 4 tokens of a pair class and 8 of a triple class at the
    sizes near a power of two; a set whose similar sets may lie near two powers is indexed for both.
    """
    sizes = np.bincount(row, minlength=n)
    first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    need = sizes * (100 - percent) // 100 + 1
    place = np.arange(len(row)) - first[row]
    both = classes[(token >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]
    kind, level = both & 3, both >> 2
    small = (sizes[row] <= SMALL_MOST) & (place < need[row])
    rows, out, hot = [row[small]], [mix(token[small] ^ np.uint64(0xA24BAED4963EE407))], [level[small]]
    ahead = place < need[row]
    hard = np.zeros(n, bool)
    hard[row[ahead & (kind > 1)]] = True
    easy = ahead & ~hard[row] & (sizes[row] >= LARGE_LEAST)
    rows.append(row[easy])
    out.append(mix(token[easy]))
    hot.append(np.zeros(len(rows[-1]), np.uint8))
    pick = hard[row] & (sizes[row] >= LARGE_LEAST)
    if pick.any():
        row, token, kind, level = row[pick], token[pick], kind[pick].astype(np.int64), level[pick]
        order = np.argsort(row * 4 + kind, kind="stable")
        row, token, kind, level = row[order], token[order], kind[order], level[order]
        low = np.floor(np.log2((-(-sizes * percent // 100)).clip(1))).astype(np.int64)
        high = np.floor(np.log2((sizes * 100 // percent).clip(1))).astype(np.int64)
        for turn, power in enumerate((low, high)):
            go = np.ones(len(row), bool) if turn == 0 else (high > low)[row]
            if not go.any():
                continue
            found = combinations(row[go], token[go], kind[go], level[go], power, need, n)
            if turn:  # single tokens are the same for both
                found = [found[1], found[2]]
            rows += [x[0] for x in found]
            out += [x[1] for x in found]
            hot += [x[2] for x in found]
    return np.concatenate(rows), np.concatenate(out), np.concatenate(hot)


def combinations(row, token, kind, level, power, need, n) -> list:
    """Rows, signatures and levels of the single tokens, pairs and triples of the extended prefixes at one power of size."""
    start = np.ones(len(row), bool)
    bits = (power[row] - kind).clip(0)  # 4 tokens of class 2 and 8 of class 3 to a range
    span = np.where(bits > 0, token >> (64 - bits).clip(1, 63).astype(np.uint64), np.uint64(0))
    start[1:] = (row[1:] != row[:-1]) | (kind[1:] != kind[:-1]) | ((kind[1:] > 1) & (span[1:] != span[:-1]))
    group = np.cumsum(start) - 1
    rank = np.arange(len(row)) - np.flatnonzero(start)[group]
    chance = (kind == 1) | (rank >= kind - 1)
    before = np.concatenate([[0], np.cumsum(chance)])[:-1]
    begin = np.searchsorted(row, np.arange(n))
    inside = before - before[np.minimum(begin, max(len(row) - 1, 0))][row] < need[row]
    row, token, kind, level, group = row[inside], token[inside], kind[inside], level[inside], group[inside]
    salt = mix(power.astype(np.uint64) + np.uint64(977))[row]
    one = kind == 1
    found = [(row[one], mix(token[one]), np.zeros(int(one.sum()), np.uint8))]
    pairs, triples = ([], [], []), ([], [], [])
    size = np.bincount(group[~one] - group[~one].min()).max() if (~one).any() else 0
    for d in range(1, size):
        at = np.flatnonzero((group[d:] == group[:-d]) & (kind[d:] == 2))
        pairs[0].append(row[at])
        pairs[1].append(mix(token[at] * np.uint64(3) + mix(token[at + d]) + salt[at]))
        pairs[2].append(np.minimum(level[at], level[at + d]))
        for e in range(d + 1, size):
            at = np.flatnonzero((group[e:] == group[:-e]) & (kind[e:] == 3))
            triples[0].append(row[at])
            triples[1].append(mix(token[at] * np.uint64(5) + mix(token[at + d] * np.uint64(3) + mix(token[at + e])) + salt[at]))
            triples[2].append(np.minimum(np.minimum(level[at], level[at + d]), level[at + e]))
    for x in (pairs, triples):
        found.append(tuple(np.concatenate(c) for c in x) if x[0] else (row[:0], token[:0], level[:0]))
    return found


def dealt(at: np.ndarray, sig: np.ndarray, level: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and signatures once more for each pair of blocks of a signature that more than HOT_ROWS sets may have.

    Any two sets still share one of its signatures, and no bucket holds more than about two blocks.
    """
    bits = np.maximum(level.astype(np.int64) - int(np.log2(HOT_ROWS)), 0)
    hot = np.flatnonzero(bits)
    if not len(hot):
        return at, sig
    rows, out = [np.delete(at, hot)], [np.delete(sig, hot)]
    for b in np.unique(bits[hot]).tolist():
        own = hot[bits[hot] == b]
        block = (mix(ids[at[own]].view(np.uint64) + np.uint64(41)) & np.uint64((1 << b) - 1)).astype(np.int64)[:, None]
        other = np.arange(1 << b)[None, :]
        pair = (np.minimum(block, other) << b | np.maximum(block, other)).astype(np.uint64)
        rows.append(np.repeat(at[own], 1 << b))
        out.append(mix(sig[own][:, None] + mix(pair + np.uint64(1 << 50))).ravel())
    return np.concatenate(rows), np.concatenate(out)


class Maps:
    """The parity maps of some sets."""

    def __init__(self, column: pa.Array, n: np.ndarray):
        parts = column.to_pylist()
        self.n, self.size = n.astype(np.int64), np.array([len(p) for p in parts], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        self.data = np.frombuffer(b"".join(parts), np.uint8)

    def bits(self, at: np.ndarray, size: int) -> np.ndarray:
        """The maps of sets of one map size, folded to `size` bytes: two halves fall on each other."""
        out = self.data[self.start[at][:, None] + np.arange(int(self.size[at[0]]))]
        while out.shape[1] > size:
            half = out.shape[1] // 2
            out = out[:, :half] ^ out[:, half:]
        return np.ascontiguousarray(out).view(np.uint64)


def may_be_similar(a: Maps, i: np.ndarray, b: Maps, j: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of sets i of a and j of b may reach the threshold.

    False where sizes or maps differ too much for it. This loses no similar pair, as two maps, folded or not, differ in
    no more bits than two sets in tokens.
    """
    n, m = a.n[i], b.n[j]
    fit = np.minimum(n, m) * 100 >= np.maximum(n, m) * percent
    live = np.flatnonzero(fit)
    shape = a.size[i[live]] * (1 << 32) + b.size[j[live]]
    for s in np.unique(shape).tolist():
        own = live[shape == s]
        size = min(s >> 32, s & 0xFFFFFFFF)
        for lo in range(0, len(own), step := max(1, (8 << 20) // max(s >> 32, s & 0xFFFFFFFF))):
            part = own[lo : lo + step]
            odd = np.bitwise_count(a.bits(i[part], size) ^ b.bits(j[part], size)).sum(1, dtype=np.int64)
            fit[part] = odd * (100 + percent) <= (n[part] + m[part]) * (100 - percent)
    return fit


def whole_groups(batches, key: list[str], most: int):
    """Tables of about `most` rows, of whole groups of rows that agree in `key` and stand together."""
    held, rows, last = [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        own = np.stack([batch.column(c).to_numpy() for c in key], 1)
        edges = np.flatnonzero(np.concatenate([[last != tuple(own[0])], (own[1:] != own[:-1]).any(1)]))
        if rows >= most and len(edges):
            if edges[0]:
                held.append(batch.slice(0, edges[0]))
            yield pa.Table.from_batches(held).combine_chunks()
            held, rows, batch = [], 0, batch.slice(edges[0])
        last = tuple(own[-1])
        held.append(batch)
        rows += batch.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def shared_buckets(batches, percent: int):
    """Buckets of two sets or more that may be similar by their sizes, each kind of membership once a chunk.

    The sets of a signature, in the order of their sizes, are parted where a size is too small for the next one.
    """
    for t in whole_groups(batches, ["sig"], INDEX_ROWS):
        sig, sid, n = (t.column(c).to_numpy() for c in ("sig", "sid", "n"))
        order = np.lexsort((sid, n, sig))
        sig, sid, n = sig[order], sid[order], n[order].astype(np.int64)
        first = np.ones(len(sig), bool)
        first[1:] = (sig[1:] != sig[:-1]) | (sid[1:] != sid[:-1])
        sig, sid, n = sig[first], sid[first], n[first]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (n[:-1] * 100 < n[1:] * percent)
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(sig)))
        bucket = mix(np.add.reduceat(mix(sid.view(np.uint64)), start) + size.astype(np.uint64)) if len(start) else np.zeros(0, np.uint64)
        few = np.flatnonzero((size > 1) & (size <= SMALL_BUCKET))
        few = few[np.unique(bucket[few], return_index=True)[1]]
        row = np.repeat(start[few], size[few]) + np.arange(size[few].sum()) - np.repeat(np.cumsum(size[few]) - size[few], size[few])
        many = merged([sid[start[g] : start[g] + size[g]] for g in np.flatnonzero(size > SMALL_BUCKET)])
        names = np.array([mix(np.array([mix(x.view(np.uint64)).sum()], np.uint64))[0] for x in many], np.uint64)
        key = np.concatenate([np.repeat(bucket[few], size[few]), np.repeat(names, [len(x) for x in many])])
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.concatenate([sid[row], *many]))], names=["bucket", "sid"])


def merged(buckets: list[np.ndarray]) -> list[np.ndarray]:
    """Large buckets, those made one of which the smaller has at least half its sets in the other; no pair of sets is parted.

    The signatures of one group of near copies have much the same sets, so the group is sent on about once a chunk.
    """
    out: list[np.ndarray] = []
    for own in sorted((np.unique(x) for x in buckets), key=len, reverse=True):
        for k, have in enumerate(out):
            at = np.minimum(np.searchsorted(have, own), len(have) - 1)
            inside = have[at] == own
            if 2 * inside.sum() >= len(own) and len(have) + len(own) <= 4 * HOT_ROWS:
                if not inside.all():
                    out[k] = np.union1d(have, own)
                break
        else:
            out.append(own)
    return out


def connected(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest of the n nodes that each one is connected with by the edges (i, j)."""
    least = np.arange(n)
    while len(i):
        low = np.minimum(least[i], least[j])
        np.minimum.at(least, least[i], low)
        np.minimum.at(least, least[j], low)
        while (least[least] != least).any():
            least = least[least]
        live = least[i] != least[j]
        i, j = i[live], j[live]
    return least


def families(batches, percent: int):
    """A forest over the sets of a task's buckets that links what sizes and maps don't rule out: fewer rows than sets.

    Buckets of up to SMALL_BUCKET sets are compared pair by pair, all of them together. In larger ones each set is
    compared only with those that none before it has reached.
    """
    for t in whole_groups(batches, ["bucket"], CHUNK_ROWS):
        sid, n = t.column("sid").to_numpy(), t.column("n").to_numpy()
        maps = Maps(t.column("map").combine_chunks(), n)
        new = np.ones(len(t), bool)
        new[1:] = np.diff(t.column("bucket").to_numpy()) != 0
        group = np.cumsum(new) - 1
        size = np.bincount(group)
        small = size[group] <= SMALL_BUCKET
        edges = []
        for d in range(1, min(SMALL_BUCKET, int(size.max()))):
            at = np.flatnonzero((group[d:] == group[:-d]) & small[d:])
            at = at[may_be_similar(maps, at, maps, at + d, percent)]
            edges.append((at, at + d))
        for first in np.flatnonzero(new)[size > SMALL_BUCKET].tolist():
            left = np.arange(first, first + size[group[first]])
            queue: list[int] = []
            while len(left):
                if not queue:
                    queue, left = [int(left[0])], left[1:]
                own = np.full(len(left), queue.pop())
                fit = may_be_similar(maps, own, maps, left, percent)
                edges.append((own[fit], left[fit]))
                queue += left[fit].tolist()
                left = left[~fit]
        nodes, code = np.unique(sid, return_inverse=True)
        i, j = (np.concatenate([e[k] for e in edges]) if edges else np.zeros(0, np.int64) for k in (0, 1))
        least = connected(len(nodes), code[i], code[j])
        at = np.flatnonzero(least != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[at]), pa.array(nodes[least[at]])], names=["a", "b"])


def asked_sets(docs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """sid, tokens of the sets whose ids stand in `asked`, and perhaps some more.

    Only documents whose set is asked for send it on, as far as a table of ids of bounded size can tell.
    """
    shared = docs.sparkSession.sparkContext.broadcast(id_table(asked, "sid"))

    def tokens(batches):
        for batch in batches:
            data, offsets = string_bytes(batch.column("body"))
            for lo, hi in slices(offsets):
                row, token = token_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], k)
                n = hi - lo
                ids, edges = set_ids(row, token, n), np.searchsorted(row, np.arange(n + 1))
                at = np.flatnonzero(in_table(shared.value, ids) & (np.diff(edges) > 0))
                at = at[np.unique(ids[at], return_index=True)[1]]
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array([token[edges[i] : edges[i + 1]].tobytes() for i in at], pa.binary())], names=["sid", "tokens"])

    return docs.mapInArrow(lean(tokens), "sid long, tokens binary").groupBy("sid").agg(F.any_value("tokens").alias("tokens"))


def similar(own: list[np.ndarray], other: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets of `own` are similar to which of `other`, as a matrix."""
    n, m = (np.array([len(t) for t in x], np.int64) for x in (own, other))
    common = np.zeros((len(n), len(m)), np.int64)
    if len(n) * len(m) <= 16:
        for i, s in enumerate(own):
            for j, t in enumerate(other):
                common[i, j] = len(np.intersect1d(s, t, assume_unique=True))
    else:
        row = np.repeat(np.arange(len(n) + len(m)), np.concatenate([n, m]))
        _, column, times = np.unique(np.concatenate([*own, *other]), return_inverse=True, return_counts=True)
        shared = times > 1
        place = (np.cumsum(shared) - 1)[column]
        row, place = row[shared[column]], place[shared[column]]
        order = np.argsort(place, kind="stable")
        row, place = row[order], place[order]
        for lo in range(0, int(shared.sum()), LINK_TOKENS):
            first, end = np.searchsorted(place, (lo, lo + LINK_TOKENS))
            part = np.zeros((len(n) + len(m), int(place[end - 1]) - lo + 1), np.float32)
            part[row[first:end], place[first:end] - lo] = 1
            common += (part[: len(n)] @ part[len(n) :].T).astype(np.int64)
    return common * 100 >= (n[:, None] + m - common) * percent


def verify_units(batches, percent: int):
    """For each set of a task's units: how many documents of other sets of its unit link with it, and the smallest set that links lead to there."""
    for t in whole_groups(batches, ["comp", "part"], 1):
        sid, size, own, same = (t.column(c).to_numpy() for c in ("sid", "size", "own", "same"))
        units = np.ones(len(t), bool)
        units[1:] = (np.diff(t.column("comp").to_numpy()) != 0) | (np.diff(t.column("part").to_numpy()) != 0)
        edges = [*np.flatnonzero(units).tolist(), len(t)]
        tokens = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("tokens")]
        links, root = np.zeros(len(t), np.int64), sid.copy()
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            rows = np.arange(lo, hi)
            x, y = (rows, rows) if same[lo] else (rows[own[rows]], rows[~own[rows]])
            fit = similar([tokens[i] for i in x], [tokens[i] for i in y], percent)
            if same[lo]:
                np.fill_diagonal(fit, False)
            links[x] += fit @ size[y]
            if not same[lo]:
                links[y] += size[x] @ fit
            i, j = np.nonzero(fit)
            root[rows] = sid[lo + connected(hi - lo, x[i] - lo, y[j] - lo)]
        yield pa.RecordBatch.from_arrays([pa.array(sid), pa.array(links), pa.array(root), t.column("slots").combine_chunks()], names=["sid", "links", "root", "slots"])


def verified(docs: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """sid, links, comp: how many documents of other sets each set links with, and its component.

    sets has sid, size (its documents), comp (what may be linked) and n_sets (sets of that). Sets that may be linked
    are compared by their tokens in units of two blocks, so that a row a set and unit leaves a task, never pairs.
    """
    slots = F.ceil(F.col("n_sets") / LINK_ROWS)
    units = sets.withColumn("slots", slots).withColumn("block", F.pmod(F.xxhash64("sid"), F.col("slots")))
    units = units.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)))
    least, most = F.least("block", "other"), F.greatest("block", "other")
    units = units.select("comp", (least * F.col("slots") + most).alias("part"), (F.col("block") == least).alias("own"), (least == most).alias("same"), "sid", "size", "slots")
    units = units.join(asked_sets(docs, sets.select("sid"), k), "sid")
    units = units.repartition("comp", "part").sortWithinPartitions("comp", "part")
    found = materialize(units.mapInArrow(lean(lambda b: verify_units(b, percent)), "sid long, links long, root long, slots long"))
    out = found.groupBy("sid").agg(F.sum("links").alias("links"), F.min("root").alias("comp"), F.max("slots").alias("slots"))
    split = found.filter("slots > 1")
    if split.isEmpty():
        return out.drop("slots")
    parts = components(split.select(F.col("sid").alias("a"), F.col("root").alias("b")))
    out = out.join(parts.withColumnsRenamed({"node": "sid", "comp": "whole"}), "sid", "left")
    return out.select("sid", "links", F.when(F.col("slots") > 1, F.coalesce("whole", "sid")).otherwise(F.col("comp")).alias("comp"))


def components(links: DataFrame) -> DataFrame:
    """node, comp (the smallest node of its component) for the nodes of links (a, b), by alternating stars.

    Each round hangs the larger neighbours of every node on its smallest one, then the smaller ones; the number of
    rows never grows, and the number of rounds follows the logarithm of the longest chain.
    """
    edges = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.least(F.min("lo"), F.first("hi")).alias("m"))
        large = both.filter("lo > hi").join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
        edges = materialize(small.select("e.hi", "e.lo").filter("hi <> lo").distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        if now == state:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("comp"))
        state = now


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id_col, rid, n_shingles, component_id, n_links.

    Words are separated by white space and lower-cased within A-Z. Documents link when their sets of distinct
    shingles have a Jaccard similarity of `percent` or more. component_id is the smallest id that links lead to;
    n_links is the number of other rows, copies among them, that the document links with. Null, empty and blank texts
    have no shingles and link with nothing, not even with each other. Rows that repeat an id are documents of their
    own; a null id is never a component_id unless all ids of it are null. Texts of any length take part whole; a
    text's tokens are held at once. Other columns aren't read. An empty table gives no rows.

    Equal sets count once, under a 64-bit hash of the set. Within the buckets of signatures, sizes and parity maps tell
    which sets may be similar; a forest of those links what has to be compared, and what it links is then compared
    by whole sets, in blocks. Texts are read three times; nothing relies on the order or place of rows.
    """
    return grouped(docs, shingle, percent, id_col, text_col).drop("comp")


def grouped(docs: DataFrame, shingle: int, percent: int, id_col: str, text_col: str, rid_col: str | None = None) -> DataFrame:
    """What near_duplicates gives, and comp, which tells components apart where ids repeat; null without shingles.

    rid is rid_col's value, or a new number of each row.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    rid = F.col(rid_col) if rid_col else F.monotonically_increasing_id()
    rows = docs.select(F.col(id_col).cast("string").alias("id"), rid.alias("rid"), F.col(text_col).alias("body"))
    body = docs.select(F.col(text_col).alias("body"))
    read = materialize(rows.mapInArrow(lean(lambda batches: read_sets(batches, shingle)), "id string, rid long, n int, sid long, map binary, part int, counts binary"))
    classes = spark.sparkContext.broadcast(token_classes(read))
    sets = read.filter("rid is not null").select(F.col("id").cast(kind).alias("id"), "rid", "n", "sid")

    def index(batches):
        for batch in batches:
            data, offsets = string_bytes(batch.column("body"))
            for lo, hi in slices(offsets):
                n = hi - lo
                row, token = token_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], shingle)
                ids, sizes = set_ids(row, token, n), np.bincount(row, minlength=n)
                once = np.zeros(n, bool)  # copies within the slice are indexed once
                once[np.unique(ids, return_index=True)[1]] = True
                row, token = row[once[row]], token[once[row]]
                at, sig, level = signatures(row, token, n, classes.value, percent)
                at, sig = dealt(at, sig, level, ids)
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(ids[at]), pa.array(sizes[at], pa.int32())], names=["sig", "sid", "n"])

    found = body.mapInArrow(lean(index), "sig long, sid long, n int").repartition("sig").sortWithinPartitions("sig")
    shared = found.mapInArrow(lean(lambda b: shared_buckets(b, percent)), "bucket long, sid long")
    maps = read.filter("sid is not null").groupBy("sid").agg(F.any_value("n").alias("n"), F.any_value("map").alias("map"))
    shared = shared.groupBy("sid").agg(F.collect_set("bucket").alias("buckets")).join(maps, "sid")
    shared = shared.select(F.explode("buckets").alias("bucket"), "sid", "n", "map").repartition("bucket").sortWithinPartitions("bucket")
    parts = components(shared.mapInArrow(lean(lambda b: families(b, percent)), "a long, b long"))

    by_set = sets.filter("sid is not null").groupBy("sid").agg(F.min("id").alias("least"), F.count("*").alias("size"))
    near = parts.unionByName(parts.select(F.col("comp").alias("node"), "comp").distinct()).distinct()
    near = near.join(near.groupBy("comp").agg(F.count("*").alias("n_sets")), "comp").withColumnRenamed("node", "sid")
    near = materialize(near.join(by_set.select("sid", "size"), "sid"))
    links = verified(body, near, shingle, percent)
    by_set = materialize(by_set.join(links, "sid", "left").select("sid", "least", "size", F.coalesce("comp", "sid").alias("comp"), (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    by_comp = by_set.groupBy("comp").agg(F.min("least").alias("component_id"), F.count("*").alias("sets"))
    by_set = materialize(join_groups(by_set, materialize(by_comp), "comp", "sets", by_set.count(), F.xxhash64("sid")).select("sid", "size", "comp", "component_id", "n_links"))
    out = join_groups(sets.filter("sid is not null"), by_set, "sid", "size", sets.count(), F.xxhash64("rid"))
    alone = sets.filter("sid is null").withColumns({"component_id": F.col("id"), "n_links": F.lit(0).cast("long"), "comp": F.lit(None).cast("long")})
    out = out.select("id", "rid", "n", "component_id", "n_links", "comp").unionByName(alone.select("id", "rid", "n", "component_id", "n_links", "comp"))
    return out.select(F.col("id").alias(id_col), "rid", F.col("n").cast("long").alias("n_shingles"), "component_id", "n_links", "comp")


def keep_one_of_each(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without near duplicates: of each component the row with the smallest id (of equal ids, one).

    A null id comes last. Rows that only share an id are not duplicates; rows without words all stay. The columns of
    docs come back as they were, whatever their names; an empty table stays empty.
    """
    rows = stamped(docs)
    own = [f"c{docs.columns.index(c)}" for c in (id_col, text_col)]
    found = materialize(grouped(rows, shingle, percent, *own, rid_col="rid").select("comp", F.col(own[0]).isNull().alias("nul"), F.col(own[0]).alias("id"), "rid"))
    first = found.filter("comp is not null").groupBy("comp").agg(F.min(F.struct("nul", "id", "rid")).alias("first"))
    keep = first.select(F.col("first.rid").alias("rid")).unionByName(found.filter("comp is null").select("rid"))
    return rows.join(keep, "rid", "left_semi").drop("rid").toDF(*docs.columns)
