"""Secret scans: fixed rules, and a linear-chain conditional random field over tokens, decoded by Viterbi.

The field tags tokens as outside (0), begin (1) or inside (2) of a secret. It is trained here, on a bounded sample of
documents: what the rules find in them stays, comes once more with other key words, separators and values, and values of
many shapes are put between words. So the field learns how secrets look and stand, not what the rules ask for.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import Words, bounded_sample, lean, slices, string_bytes

#: The rules, their order, and the least length of what they find.
ASSIGN = re.compile(rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
KINDS = ("assign", "access", "hex", "crf")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
#: Documents to train on at most, steps of training, tokens to a training window, shortest secret that the field adds.
TRAIN_DOCS, TRAIN_STEPS, WINDOW, SPAN_LEAST = 2000, 200, 64, 12
HASHED, DOC_BINS, SOURCES = 4096, 8, 64
#: Of the training documents, the share into which values are put; their letters, and what stands before half of them.
PLANTED = 0.5
ALPHABETS = ("0123456789ABCDEF", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "abcdefghijklmnopqrstuvwxyz0123456789-_", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
BEFORE = ("", "key ", "auth: ", "credential=", "id ", "use ", "pin = ", "hash ", "bearer ", "value: ", "login ", "= ", ": ", "is ")

TOKEN = np.zeros(256, bool)
TOKEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *b"+/_-", *range(0x80, 0x100)]] = True
HEX = np.zeros(256, bool)
HEX[[*range(0x30, 0x3A), *range(0x61, 0x67)]] = True
#: What code has much of.
CODE = np.zeros(256, bool)
CODE[[*b"{}()[];=<>_/"]] = True
#: What stands before a token: other, start of a document, space, newline, quote, = or :, and whether = or : is near.
GAP = np.zeros(256, np.int64)
GAP[32], GAP[10], GAP[[34, 39]], GAP[[58, 61]] = 1, 2, 3, 4
#: Sizes of the feature tables, in the order of `features`.
TABLES = (384, 384, 384, HASHED, HASHED, 16, DOC_BINS, DOC_BINS, DOC_BINS, SOURCES)


def base_spans(data: bytes, hexes: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the rules in one text, in bytes; hexes are its long runs of hexadecimal digits."""
    out = [(s, 2, e) for s, e in hexes]
    if b"AKIA" in data:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(data) if m.end() - m.start() >= ACCESS_LEAST]
    if b"=" in data or b":" in data:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(data) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    return sorted(out)


def hex_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of the runs of HEX_LEAST or more hexadecimal digits."""
    runs = Words(data, offsets, HEX, lower=False)
    long = np.flatnonzero(runs.ends - runs.starts >= HEX_LEAST)
    return runs.row[long], runs.starts[long], runs.ends[long]


class Tokens:
    """The tokens of some texts and their features: one column a table of TABLES."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, sources: np.ndarray):
        self.words = w = Words(data, offsets, TOKEN, lower=False)
        n = len(w.starts)
        size = w.ends - w.starts

        def count(which: np.ndarray) -> np.ndarray:
            sums = np.zeros(len(data) + 1, np.int32)
            np.cumsum(which, out=sums[1:])
            return sums[w.ends] - sums[w.starts]

        digits, upper, lower = count((data >= 48) & (data <= 57)), count((data >= 65) & (data <= 90)), count((data >= 97) & (data <= 122))
        length = np.searchsorted([4, 8, 12, 16, 20, 32, 48], size, "right")
        digit = (digits > 0).astype(np.int64) + (digits * 4 >= size) + (digits * 5 >= size * 3)
        shape = (((length * 4 + digit) * 3 + (upper > 0) + (upper * 5 > size)) * 2 + (lower > 0)) * 2 + (digits + upper + lower < size)
        low = Words.__new__(Words)
        low.__dict__.update(w.__dict__)
        low.data = np.where((data >= 65) & (data <= 90), data + 32, data)
        word = (low.hashes() >> np.uint64(52)).astype(np.int64)
        before, after = np.zeros(n, np.int64), np.zeros(n, np.int64)
        gap = np.zeros(n, np.int64)
        if n:
            same = w.row[1:] == w.row[:-1]
            before[1:][same] = shape[:-1][same]
            after[:-1][same] = shape[1:][same]
            gap = GAP[data[np.maximum(w.starts - 1, 0)]]
            marks = np.concatenate([[0], np.cumsum((data == 58) | (data == 61))])
            low_edge = np.concatenate([[0], w.ends[:-1]])
            low_edge = np.maximum(low_edge, offsets[w.row])
            gap = gap + 8 * (marks[w.starts] > marks[low_edge])
        left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
        if n:
            left[1:][same] = word[:-1][same]
            right[:-1][same] = word[1:][same]
        odd = np.bincount(w.row, weights=(digits * 4 >= size) & (size >= 8), minlength=len(offsets) - 1)
        bytes_ = np.diff(offsets)
        code = np.concatenate([[0], np.cumsum(CODE[data])])
        code = (code[offsets[1:]] - code[offsets[:-1]]) / np.maximum(bytes_, 1)
        files = (np.minimum(odd, DOC_BINS - 1), np.clip(np.log2(np.maximum(bytes_, 1)) // 2, 0, DOC_BINS - 1), np.clip(np.ceil(code * 40), 0, DOC_BINS - 1), sources)
        self.columns = (shape, before, after, left, right, gap, *(x.astype(np.int64)[w.row] for x in files))

    def scores(self, tables: list[np.ndarray]) -> np.ndarray:
        return sum(t[c] for t, c in zip(tables, self.columns, strict=True))


def values_of(body: bytes) -> list[tuple[int, int, int]]:
    """What the rules find in a text: start of the whole, start and end of the value."""
    found = [(m.start(), m.start(), m.end()) for m in re.finditer(rb"[0-9a-f]{%d,}" % HEX_LEAST, body)]
    found += [(m.start(), m.start(), m.end()) for m in ACCESS.finditer(body) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), m.start(2), m.end(2)) for m in ASSIGN.finditer(body) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    out: list[tuple[int, int, int]] = []
    for x in sorted(found):
        if not out or x[0] >= out[-1][2]:
            out.append(x)
    return out


def made_up(rng: np.random.Generator) -> bytes:
    """A value of a random shape, with what stands before it."""
    letters = ALPHABETS[rng.integers(len(ALPHABETS))]
    return "".join(letters[i] for i in rng.integers(0, len(letters), int(rng.integers(SPAN_LEAST + 2, 44)))).encode()


def lessons(texts: list[str], rng: np.random.Generator) -> tuple[list[bytes], list[list[tuple[int, int]]], list[int]]:
    """Texts to train on, where their secrets are, and which document each comes from.

    Every text as it is, with the rules' values; those with values once more, all values and what leads to them
    exchanged; of the others a share with one to three values put between words.
    """
    out, spans, own = [], [], []
    for i, text in enumerate(texts):
        body = (text or "").encode()
        found = values_of(body)
        out.append(body)
        spans.append([(s, e) for _, s, e in found])
        own.append(i)
        gaps = [m.start() for m in re.finditer(rb"[\x20\n]", body)]
        if found:
            cuts = [(a, e) for a, _, e in found]
        elif gaps and rng.random() < PLANTED:
            cuts = sorted((gaps[k] + 1, gaps[k] + 1) for k in set(rng.integers(0, len(gaps), int(rng.integers(1, 4))).tolist()))
        else:
            continue
        parts, at, placed, size = [], 0, [], 0
        for a, e in cuts:
            lead, value = BEFORE[rng.integers(len(BEFORE)) * int(rng.random() < 0.5)].encode(), made_up(rng)
            tail = b"" if e > a else b" "
            parts += [body[at:a], lead, value, tail]
            size += a - at + len(lead)
            placed.append((size, size + len(value)))
            size += len(value) + len(tail)
            at = e
        out.append(b"".join([*parts, body[at:]]))
        spans.append(placed)
        own.append(i)
    return out, spans, own


def windows_of(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Places of WINDOW neighbouring tokens of one text, and which of them there are; the last window of a text is filled up."""
    n = -(-words.counts // WINDOW)
    row = np.repeat(np.arange(len(n)), n)
    turn = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    spot = (words.first[row] + turn * WINDOW)[:, None] + np.arange(WINDOW)
    live = spot < words.first[row + 1][:, None]
    return np.minimum(spot, max(len(words.starts) - 1, 0)), live


def train(texts: list[str], sources: list[int], seed: int = 3) -> tuple[list[np.ndarray], np.ndarray]:
    """Feature tables and transitions that maximise the likelihood of the lessons' tags, by forward and backward sums.

    What fills up a window is outside for certain, as is what follows a text.
    """
    rng = np.random.default_rng(seed)
    tables = [np.zeros((n, 3)) for n in TABLES]
    moves = np.zeros((3, 3))
    bodies, spans, own = lessons(texts, rng)
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in bodies])]).astype(np.int64)
    data = np.frombuffer(b"".join(bodies), np.uint8)
    tokens = Tokens(data, offsets, np.array([sources[i] for i in own], np.int64)) if len(data) else None
    if tokens is None or not len(tokens.words.starts):
        tables[0][:, 0] = 10.0
        return tables, moves
    w, tags = tokens.words, np.zeros(len(tokens.words.starts), np.int64)
    for i, found in enumerate(spans):
        for s, e in found:
            a, z = np.searchsorted(w.ends, offsets[i] + s, "right"), np.searchsorted(w.starts, offsets[i] + e)
            tags[a:z] = 2
            tags[a : min(a + 1, z)] = 1
    spot, live = windows_of(w)
    columns, tags = [c[spot] for c in tokens.columns], np.where(live, tags[spot], 0)
    with_, without = np.flatnonzero(tags.any(1)), np.flatnonzero(~tags.any(1))
    grown = [np.full_like(t, 1e-6) for t in (*tables, moves)]
    filler = np.array([0.0, -30.0, -30.0])
    for _ in range(TRAIN_STEPS):
        pick = np.concatenate([rng.choice(x, min(len(x), 128)) for x in (with_, without) if len(x)])
        cols, own_tags, there, b = [c[pick] for c in columns], tags[pick], live[pick], len(pick)
        e = np.where(there[:, :, None], sum(t[c] for t, c in zip(tables, cols, strict=True)), filler)
        f, r = np.empty_like(e), np.zeros_like(e)
        f[:, 0] = e[:, 0]
        for t in range(1, WINDOW):
            f[:, t] = e[:, t] + logsum(f[:, t - 1, :, None] + moves, 1)
        for t in range(WINDOW - 2, -1, -1):
            r[:, t] = logsum(moves + (e[:, t + 1] + r[:, t + 1])[:, None, :], 2)
        z = logsum(f[:, -1], 1)
        chance = np.exp(f + r - z[:, None, None])
        miss = (np.eye(3)[own_tags] - chance) * there[:, :, None]
        both = np.exp(f[:, :-1, :, None] + moves + (e + r)[:, 1:, None, :] - z[:, None, None, None]).sum((0, 1))
        seen = np.zeros((3, 3))
        np.add.at(seen, (own_tags[:, :-1].ravel(), own_tags[:, 1:].ravel()), 1.0)
        grads = []
        for t, c in zip(tables, cols, strict=True):
            g = np.zeros_like(t)
            np.add.at(g, c.ravel(), miss.reshape(-1, 3))
            grads.append(g / b)
        grads.append((seen - both) / b)
        for x, g, h in zip((*tables, moves), grads, grown, strict=True):
            g = g - 1e-4 * x
            h += g * g
            x += 0.5 * g / np.sqrt(h)
    return tables, moves


def logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis)
    return top + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis))


def viterbi(e: np.ndarray, row: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best tags of each row's tokens.

    Where outside leads by more than any two moves can make up, the best path goes through outside, so only the runs
    of tokens between such places are decoded, all of them step by step together. This changes no result.
    """
    tags = np.zeros(len(e), np.int64)
    lead = 2 * (moves.max() - moves.min()) + 1e-9
    runs = np.flatnonzero(e[:, 0] - e[:, 1:].max(1) <= lead)
    if not len(runs):
        return tags
    first = np.ones(len(runs), bool)
    first[1:] = (np.diff(runs) > 1) | (row[runs[1:]] != row[runs[:-1]])
    start = runs[first]
    size = np.diff(np.append(np.flatnonzero(first), len(runs)))
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    most = int(size[0])
    head = (start > 0) & (row[np.maximum(start - 1, 0)] == row[start])
    end = start + size
    tail = (end < len(row)) & (row[np.minimum(end, len(row) - 1)] == row[start])
    best = e[start] + np.where(head[:, None], moves[0], 0.0)
    back = []
    for t in range(1, most):
        live = int(np.searchsorted(-size, -t))  # the runs longer than t come first
        step = best[:live, :, None] + moves
        back.append(step.argmax(1))
        best[:live] = step.max(1) + e[start[:live] + t]
    last = (best + np.where(tail[:, None], moves[:, 0], 0.0)).argmax(1)
    tags[end - 1] = last
    for t in range(most - 1, 0, -1):
        live = int(np.searchsorted(-size, -t))
        at = start[:live] + t
        tags[at - 1] = back[t - 1][np.arange(live), tags[at]]
    return tags


def scan(texts: pa.Array, sources: np.ndarray, model) -> list[list[tuple[str, int, int]]]:
    """The spans of each text, as (kind, start, end) in code points, by start and then by kind."""
    tables, moves = model
    data, offsets = string_bytes(texts)
    out = []
    for lo, hi in slices(offsets):
        part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        rows, starts, ends = hex_runs(part, at)
        tokens = Tokens(part, at, sources[lo:hi])
        w = tokens.words
        tags = viterbi(tokens.scores(tables), w.row, moves)
        hits = np.flatnonzero(tags)
        new = np.ones(len(hits), bool)
        if len(hits):
            new[1:] = (np.diff(hits) > 1) | (w.row[hits[1:]] != w.row[hits[:-1]]) | (tags[hits[1:]] == 1)
        heads = hits[new]
        tails = hits[np.append(np.flatnonzero(new)[1:], len(hits)) - 1] if len(hits) else hits
        hex_at, crf_at = np.searchsorted(rows, np.arange(hi - lo + 1)), np.searchsorted(w.row[heads], np.arange(hi - lo + 1))
        for i in range(hi - lo):
            body = part[at[i] : at[i + 1]].tobytes()
            spans = base_spans(body, [(int(s - at[i]), int(e - at[i])) for s, e in zip(starts[hex_at[i] : hex_at[i + 1]], ends[hex_at[i] : hex_at[i + 1]], strict=True)])
            extra = [(int(w.starts[h] - at[i]), int(w.ends[t] - at[i])) for h, t in zip(heads[crf_at[i] : crf_at[i + 1]], tails[crf_at[i] : crf_at[i + 1]], strict=True)]
            spans += [(s, 3, e) for s, e in extra if e - s >= SPAN_LEAST and not any(a < e and s < z for a, _, z in spans)]
            if spans:
                chars = np.concatenate([[0], np.cumsum((part[at[i] : at[i + 1]] & 0xC0) != 0x80)])
                spans = [(KINDS[k], int(chars[s]), int(chars[e])) for s, k, e in sorted(spans)]
            out.append(spans)
    return out


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", train_docs: int = TRAIN_DOCS) -> DataFrame:
    """One row a document: id_col and spans, an array of (kind, start, end) in code points.

    Kinds are assign, access and hex (the rules) and crf, what the field adds beside them; a crf span has SPAN_LEAST
    bytes or more and touches no span of a rule. Spans stand by start, then in the order of the kinds. Null and empty
    texts have none. The field is fitted on at most `train_docs` documents, those with the smallest hashes; all whole
    texts are scanned. Rows that repeat are found alike; ids may be null. source_col is a feature of the file where docs
    has it; other columns aren't read. An empty table gives no rows.
    """
    source = F.pmod(F.xxhash64(F.col(source_col)), F.lit(SOURCES)).cast("int") if source_col in docs.columns else F.lit(0)
    rows = docs.select(F.col(id_col).alias("id"), source.alias("source"), F.col(text_col).alias("body"))
    sample = bounded_sample(rows.filter(F.col("body").isNotNull()), train_docs, F.col("id"), F.col("body"))
    model = docs.sparkSession.sparkContext.broadcast(train([r["body"] for r in sample], [r["source"] for r in sample]))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            spans = scan(batch.column("body"), batch.column("source").to_numpy(), model.value)
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in own] for own in spans]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, kind)], names=["id", "spans"])

    schema = f"id {rows.schema['id'].dataType.simpleString()}, spans array<struct<kind:string,start:long,end:long>>"
    return rows.mapInArrow(lean(run), schema).withColumnRenamed("id", id_col)
