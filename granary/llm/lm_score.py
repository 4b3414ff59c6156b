"""Language-model scoring: exact word counts, and a causal self-attention model over subword ids, trained in numpy.

The attention model predicts the class of the next id from a window of ids; frequent ids are classes of their own.
What the whole training corpus says about words, ids and neighbouring classes is counted exactly, over all documents.
"""

from __future__ import annotations

import base64
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import Words, bounded_sample, lean, materialize, packed, slices, string_bytes, summed

#: Public byte-level BPE ranks; one more id ends a text.
VOCABULARY_FILE, IDS = "/opt/tokenizers/byte_bpe_50k.tiktoken", 50257
END = IDS - 1
#: Classes, those that are one id each, width of the model, ids a window sees, ids by which windows advance.
CLASSES, SINGLE, WIDTH, SEEN, ADVANCE = 128, 96, 16, 32, 28
#: Documents that the driver begins training on, its steps, windows to a step; tasks go on with all windows.
FIRST_DOCS, FIRST_STEPS, BATCH, RATE = 800, 600, 128, 0.05
#: Shares of the attention model that are tried.
MIXES = np.arange(1, 20) / 20
#: Words whose counts travel to all tasks at most, cached words of a task.
HEAD_WORDS, CACHE_WORDS = 1 << 17, 1 << 20
#: Windows whose arrays are held together, so that they stay in a core's cache; windows that wait for training at most.
TOGETHER, TRAINED = 64, 1 << 13
#: Exponents up to this size are raised as they are, larger ones less the largest of their row.
TALLEST = 60


class Subwords:
    """The ids of words, each encoded once; words are known by their hashes."""

    def __init__(self, ranks: bytes):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encode = tiktoken.Encoding("words", pat_str=r" [^ \n]*|\n", mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.edge = table[b"\n"]
        self.clear()

    def clear(self) -> None:
        self.known, self.first, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0

    def learn(self, hashes: np.ndarray, texts: list[bytes]) -> None:
        """All words are encoded in one call, a line each: no word holds a line's end, so that its id parts them."""
        if len(self.known) > CACHE_WORDS:
            self.clear()
        ids = np.array(self.encode("".join(" " + t + "\n" for t in b"\n".join(texts).decode("utf-8", "replace").split("\n"))), np.int32)
        edges = np.flatnonzero(ids == self.edge)
        size = np.diff(edges, prepend=-1) - 1
        ids = ids[ids != self.edge]
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        first = self.used + np.cumsum(size) - size
        self.used += len(ids)
        at = np.searchsorted(self.known, hashes)
        self.known, self.first, self.size = (np.insert(a, at, b) for a, b in ((self.known, hashes), (self.first, first), (self.size, size)))

    def places(self, words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the cache has each distinct word, and which of them every word is."""
        unique, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        for turn in range(2):  # when the cache is emptied, all words of this slice are learnt anew
            spot = np.minimum(np.searchsorted(self.known, unique), max(len(self.known) - 1, 0))
            new = self.known[spot] != unique if len(self.known) else np.ones(len(unique), bool)
            if not new.any():
                break
            if len(self.known) > CACHE_WORDS:
                self.clear()
                new[:] = True
            self.learn(unique[new], words.texts(at[new]))
        return np.searchsorted(self.known, unique), inverse

    def counts(self, words: Words, hashes: np.ndarray) -> np.ndarray:
        """How often each id stands in the texts, their ends included; each distinct word is looked at once."""
        spot, inverse = self.places(words, hashes)
        size = self.size[spot]
        deep = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out = np.bincount(self.flat[np.repeat(self.first[spot], size) + deep], np.repeat(np.bincount(inverse, minlength=len(spot)), size), IDS)
        out[END] += len(words.counts)
        return out

    def sequences(self, words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, an end before and after each text, and where each text's part begins."""
        spot, inverse = self.places(words, hashes)
        first, size = self.first[spot][inverse], self.size[spot][inverse]
        n = len(words.counts)
        total = np.bincount(words.row, weights=size, minlength=n).astype(np.int64) + 2
        begin = np.concatenate([[0], np.cumsum(total)])
        out = np.full(int(begin[-1]), END, np.int32)
        place = begin[words.row] + 1
        if len(size):
            place = place + np.cumsum(size) - size - (np.cumsum(total - 2) - (total - 2))[words.row]
            deep = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            out[np.repeat(place, size) + deep] = self.flat[np.repeat(first, size) + deep]
        return out, begin


def with_one(flat: np.ndarray) -> np.ndarray:
    out = np.ones((len(flat), WIDTH + 1), flat.dtype)
    out[:, :-1] = flat
    return out


@dataclass
class Attention:
    """One head over classes: next-class logits from a window of embedded classes and places."""

    weights: dict[str, np.ndarray]

    @staticmethod
    def fresh(seed: int = 1) -> Attention:
        rng = np.random.default_rng(seed)
        shape = {"e": (CLASSES, WIDTH), "p": (SEEN, WIDTH), "qkv": (WIDTH, 3 * WIDTH), "u": (WIDTH, CLASSES), "b": (CLASSES,)}
        return Attention({k: rng.normal(0, 0.2 if k != "b" else 0, s).astype(np.float32) for k, s in shape.items()})

    MASK = np.tril(np.ones((SEEN, SEEN), np.float32))

    def hidden(self, x: np.ndarray):
        w = self.weights
        h = w["e"][x]
        h += w["p"]
        q, k, v = np.ascontiguousarray((h.reshape(-1, WIDTH) @ w["qkv"]).reshape(*x.shape, 3, WIDTH).transpose(2, 0, 1, 3))
        q *= np.float32(WIDTH**-0.5)
        a = q @ k.transpose(0, 2, 1)
        if not max(a.max(), -a.min()) < TALLEST:
            a -= np.where(self.MASK > 0, a, -np.inf).max(-1, keepdims=True)
            np.minimum(a, 0, out=a)
        np.exp(a, out=a)
        a *= self.MASK
        a /= a.sum(-1, keepdims=True)
        o = a @ v
        o += h
        return h, q, k, v, a, o

    def chances(self, x: np.ndarray, from_: int, target: np.ndarray) -> np.ndarray:
        """The probability of each target class at the window places from `from_` on."""
        out, total = self.masses(self.hidden(x)[-1][:, from_:].reshape(-1, WIDTH))
        return out.ravel()[np.arange(len(out)) * CLASSES + target.ravel()] / total

    def masses(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What is in proportion to the probability of each class, and its sum; flat holds hidden rows."""
        out = flat @ self.weights["u"]
        out += self.weights["b"]
        if not max(out.max(), -out.min()) < TALLEST:
            out -= out.max(1, keepdims=True)
        np.exp(out, out=out)
        return out, out @ np.ones(CLASSES, out.dtype)

    def slopes(self, x: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, dict]:
        """The probability of each target, and the slopes of the weighted loss, by causal attention backwards."""
        w = self.weights
        h, q, k, v, a, o = self.hidden(x)
        flat = o.reshape(-1, WIDTH)
        p, total = self.masses(flat)
        spot, each = np.arange(len(p)) * CLASSES + target.ravel(), p.reshape(-1)
        said = (each[spot] / total).reshape(target.shape)
        p *= (weight / total)[:, None]
        each[spot] -= weight
        out = with_one(flat).T @ p
        g = {"u": out[:-1], "b": out[-1]}
        do = (p @ w["u"].T).reshape(o.shape)
        da = do @ v.transpose(0, 2, 1)
        da -= (do * (o - h)).sum(-1, keepdims=True)
        da *= a
        dqkv = np.concatenate([da @ k * np.float32(WIDTH**-0.5), da.transpose(0, 2, 1) @ q, a.transpose(0, 2, 1) @ do], -1).reshape(-1, 3 * WIDTH)
        g["qkv"] = h.reshape(-1, WIDTH).T @ dqkv
        dh = do + (dqkv @ w["qkv"].T).reshape(h.shape)
        g["p"] = dh.sum(0)
        g["e"] = np.bincount((x.reshape(-1, 1) * WIDTH + np.arange(WIDTH)).ravel(), dh.ravel(), CLASSES * WIDTH).reshape(CLASSES, WIDTH).astype(np.float32)
        return said, g

    def step(self, x: np.ndarray, target: np.ndarray, live: np.ndarray, grown: dict, rate: float) -> np.ndarray:
        """One step of gradient ascent on the likelihood of the live targets; gives their probabilities before it."""
        w, weight = self.weights, (live / max(live.sum(), 1)).astype(np.float32)
        parts = [slice(lo, lo + TOGETHER) for lo in range(0, len(x), TOGETHER)]
        got = [self.slopes(x[own], target[own], weight[own].ravel()) for own in parts]
        for name in w:
            d = sum(g[name] for _, g in got)
            grown[name] += d * d
            w[name] -= rate * d / np.sqrt(grown[name])
        return np.concatenate([said for said, _ in got])

    def train(self, windows, rate: float = RATE) -> None:
        grown = {k: np.full_like(x, 1e-7) for k, x in self.weights.items()}
        for x, target, live in windows:
            self.step(x, target, live, grown, rate)

    def pack(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.weights.values()]).astype(np.float64)

    def unpack(self, flat: np.ndarray) -> Attention:
        at, out = 0, {}
        for k, x in self.weights.items():
            out[k] = flat[at : at + x.size].reshape(x.shape).astype(np.float32)
            at += x.size
        return Attention(out)


def window_places(begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first place and length left of the overlapping windows of each text; text i predicts begin[i] + 1 and on."""
    size = np.diff(begin) - 1
    n = 1 + np.maximum(0, -(-(size - SEEN) // ADVANCE))
    row = np.repeat(np.arange(len(size)), n)
    turn = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return row, begin[row] + turn * ADVANCE, size[row] - turn * ADVANCE


def window_rows(classes: np.ndarray, at: np.ndarray, left: np.ndarray):
    """Input and target classes of some windows, and which places hold text."""
    spot = at[:, None] + np.arange(SEEN)
    live = np.arange(SEEN) < left[:, None]
    last = len(classes) - 1
    return classes[np.minimum(spot, last)], classes[np.minimum(spot + 1, last)], live


@dataclass
class Model:
    attention: Attention
    classes: np.ndarray
    within: np.ndarray  # log10 of an id's share of its class
    after: np.ndarray  # probability of a class after another
    mix: float
    head: np.ndarray
    head_counts: np.ndarray
    total: int
    distinct: int

    def score(self, ids: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """log10 of the probability of each text; each id is scored once, in the first window that sees it."""
        n = len(begin) - 1
        out = np.zeros(n)
        for row, p, q, live in self.chances(ids, begin):
            out += np.bincount(row, weights=(np.log10(self.mix * p + (1 - self.mix) * q) * live).sum(1), minlength=n)
        inner = np.ones(len(ids), bool)
        inner[begin[:-1]] = False
        text = np.repeat(np.arange(n), np.diff(begin))
        return out + np.bincount(text[inner], weights=self.within[ids[inner]], minlength=n)

    def chances(self, ids: np.ndarray, begin: np.ndarray):
        """Rows of some windows, the probability of their targets by attention and by neighbours, and which count."""
        classes = self.classes[ids]
        row, at, left = window_places(begin)
        head = at == begin[row]
        for from_, pick in ((0, np.flatnonzero(head)), (SEEN - ADVANCE, np.flatnonzero(~head))):
            for lo in range(0, len(pick), TOGETHER):
                own = pick[lo : lo + TOGETHER]
                x, target, live = window_rows(classes, at[own], left[own])
                target, live, before = target[:, from_:], live[:, from_:], x[:, from_:]
                yield row[own], self.attention.chances(x, from_, target).reshape(target.shape), self.after[before, target], live


def class_table(counts: np.ndarray) -> np.ndarray:
    """Class of each id: the most frequent ids have their own, the others share the rest by equal parts of their mass."""
    order = np.argsort(-counts, kind="stable")
    out = np.zeros(len(counts), np.int32)
    out[order[:SINGLE]] = np.arange(SINGLE)
    tail = order[SINGLE:]
    mass = np.cumsum(counts[tail] + 1e-3)
    out[tail] = SINGLE + np.minimum((mass / mass[-1] * (CLASSES - SINGLE)).astype(np.int64), CLASSES - SINGLE - 1)
    return out


def held_out(id_: Column) -> Column:
    """Documents that are never learnt from; a null id is not one of them."""
    return F.coalesce(F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def worded(batches):
    """Words and their hashes, slice by slice."""
    for batch in batches:
        data, offsets = string_bytes(batch.column("body"))
        for lo, hi in slices(offsets):
            words = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            yield words, words.hashes()


def encoded(batches, ranks: bytes):
    """Hashes of words, ids and where each text's ids begin, slice by slice."""
    subwords = Subwords(ranks)
    for words, hashes in worded(batches):
        yield hashes, *subwords.sequences(words, hashes)


def count_ids(batches, ranks: bytes):
    """How often each id stands in a task's documents."""
    subwords, seen = Subwords(ranks), np.zeros(IDS)
    for words, hashes in worded(batches):
        seen += subwords.counts(words, hashes)
    yield packed(seen)


def neighbours(pairs: np.ndarray, unigram: np.ndarray) -> np.ndarray:
    """The probability of a class after another one by their counts."""
    return (pairs + 20 * unigram) / (pairs.sum(1, keepdims=True) + 20)


def mixed_logs(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For each share in MIXES the sum of logarithms of the mixed probabilities, which are multiplied by sixteens before."""
    both = np.ones((len(MIXES), -(-len(p) // 16) * 16))
    np.multiply(MIXES[:, None], p - q, out=both[:, : len(p)])
    both[:, : len(p)] += q
    return np.log(np.multiply.reduce(both.reshape(len(MIXES), 16, -1), axis=1)).sum(1)


def gather(batches, ranks: bytes, classes: np.ndarray, start: Attention, unigram: np.ndarray):
    """What a task's training documents give: word counts, and one row with counts of neighbours, weights trained on all
    windows, and the likelihood of each share in MIXES, every window judged before the task learns from it."""
    model = Attention({k: x.copy() for k, x in start.weights.items()})
    grown = {k: np.full_like(x, 1e-4) for k, x in model.weights.items()}
    pairs, trained, gains = np.zeros(CLASSES * CLASSES), 0, np.zeros(len(MIXES))
    held: list[tuple] = []
    pending: list = []

    def train(least: int) -> None:
        """Steps over the pending windows, until fewer than `least` are left."""
        nonlocal pending, trained
        if sum(len(x) for x, _, _ in pending) < least:
            return
        after = neighbours(pairs.reshape(CLASSES, CLASSES), unigram)
        x, target, live = (np.concatenate(c) for c in zip(*pending, strict=True))
        lo = 0
        while len(x) - lo >= least:
            own = slice(lo, lo + BATCH)
            said = model.step(x[own], target[own], live[own], grown, RATE / 4)[live[own]]
            gains[:] += mixed_logs(said, after[x[own], target[own]][live[own]])
            trained += int(live[own].sum())
            lo += BATCH
        pending = [(x[lo:], target[lo:], live[lo:])]

    def counts_row(parts):
        unique, at = np.unique(np.concatenate([a for a, _ in parts]), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate([b for _, b in parts]))
        return unique, n.astype(np.int64)

    def words_out(parts):
        unique, n = counts_row(parts)
        return pa.RecordBatch.from_arrays([pa.array(unique.view(np.int64)), pa.array(n), pa.nulls(len(n), pa.binary())], names=["word", "count", "sums"])

    for hashes, ids, begin in encoded(batches, ranks):
        held.append(np.unique(hashes, return_counts=True))
        if sum(len(a) for a, _ in held) > CACHE_WORDS:
            held = [counts_row(held)]
            if len(held[0][0]) > CACHE_WORDS:
                yield words_out(held)
                held = []
        inner = np.ones(len(ids), bool)
        inner[begin[:-1]] = False
        own = classes[ids]
        at = np.flatnonzero(inner)
        _, place, left = window_places(begin)
        for lo in range(0, len(place), TRAINED):
            pending.append(window_rows(own, place[lo : lo + TRAINED], left[lo : lo + TRAINED]))
            train(BATCH)
        pairs += np.bincount(own[at - 1] * CLASSES + own[at], minlength=CLASSES * CLASSES)
    train(1)
    if held:
        yield words_out(held)
    sums = np.concatenate([pairs, gains, [trained], model.pack() * trained])
    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), *packed(sums).columns], names=["word", "count", "sums"])


def fit(docs: DataFrame, ranks: bytes, id_col: str, text_col: str) -> tuple[Model, DataFrame]:
    """The model, and the counts of all training words but those in its head."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).filter(~held_out(F.col("id")))
    table = spark.sparkContext.broadcast(ranks)
    seen = summed(rows.select("body").mapInArrow(lean(lambda b: count_ids(b, table.value)), "sums binary"), IDS)
    classes = class_table(seen)
    texts = [r["body"] for r in bounded_sample(rows, FIRST_DOCS, F.col("id"), F.col("body"))]
    words = Words(*string_bytes(pa.array(texts, pa.string())))
    ids, begin = Subwords(ranks).sequences(words, words.hashes())
    start, rng = Attention.fresh(), np.random.default_rng(2)
    _, place, left = window_places(begin)
    if len(place):
        picks = (rng.integers(0, len(place), BATCH) for _ in range(FIRST_STEPS))
        start.train(window_rows(classes[ids], place[p], left[p]) for p in picks)

    mass = np.bincount(classes, weights=seen + 1, minlength=CLASSES)
    unigram = (mass / mass.sum())[None, :]
    shared = spark.sparkContext.broadcast((ranks, classes, start, unigram))
    got = materialize(rows.select("body").mapInArrow(lean(lambda b: gather(b, *shared.value)), "word long, count long, sums binary"))
    sums = summed(got.filter("sums is not null"), CLASSES**2 + len(MIXES) + 1 + len(start.pack()))
    pairs, gains, trained, flat = np.split(sums, np.cumsum([CLASSES**2, len(MIXES), 1]))
    attention = start.unpack(flat / trained[0]) if trained[0] else start
    within = np.log10((seen + 1) / mass[classes])
    after = neighbours(pairs.reshape(CLASSES, CLASSES), unigram)

    counts = materialize(got.filter("word is not null").groupBy("word").agg(F.sum("count").alias("count")))
    facts = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("count"), F.lit(0)).alias("n")).first()
    documents = rows.count()
    level = F.floor(F.log2("count") * 8).cast("int")
    least, room = 10_000, HEAD_WORDS
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        if r["count"] > room:
            break
        least, room = r["level"], room - r["count"]
    head = counts.filter(level >= least).toPandas().sort_values("word")
    hashes, order = head["word"].to_numpy(np.int64).view(np.uint64), None
    order = np.argsort(hashes)
    model = Model(attention, classes, within, after, float(MIXES[gains.argmax()]), hashes[order], head["count"].to_numpy(np.int64)[order], int(facts["n"]) + documents, int(facts["v"]) + (documents > 0))
    return model, counts.filter(level < least)


def score_rows(batches, ranks: bytes, model: Model):
    """A row for each document with its model score, its head words' part of the base score, and its other words."""
    subwords = Subwords(ranks)
    scale = np.log10(model.total + model.distinct + 1)
    logs = np.log10(model.head_counts + 1) - scale
    for batch in batches:
        data, offsets = string_bytes(batch.column("body"))
        for lo, hi in slices(offsets):
            n = hi - lo
            words = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            hashes = words.hashes()
            spot = np.minimum(np.searchsorted(model.head, hashes), max(len(model.head) - 1, 0))
            hit = model.head[spot] == hashes if len(model.head) else np.zeros(len(hashes), bool)
            base = np.bincount(words.row[hit], weights=logs[spot[hit]], minlength=n)
            known = np.bincount(words.row[hit], minlength=n)
            row, rest = words.row[~hit], hashes[~hit]
            order = np.lexsort((rest, row))
            row, rest = row[order], rest[order]
            first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (rest[1:] != rest[:-1])])) if len(row) else np.zeros(0, np.int64)
            times = np.diff(np.append(first, len(row)))
            edges = pa.array(np.searchsorted(row[first], np.arange(n + 1)), pa.int32())
            score = model.score(*subwords.sequences(words, hashes))
            yield pa.RecordBatch.from_arrays([
                *(batch.column(c).slice(lo, n) for c in ("id", "rid", "held_out")), pa.array(words.counts + 1), pa.array(known), pa.array(base, pa.float64()), pa.array(score, pa.float64()),
                pa.ListArray.from_arrays(edges, pa.array(rest[first].view(np.int64))), pa.ListArray.from_arrays(edges, pa.array(times, pa.int32())),
            ], names=["id", "rid", "held_out", "n_tokens", "known", "base", "score", "words", "times"])


def score_documents(docs: DataFrame, vocabulary: str = VOCABULARY_FILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id_col, rid, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens of the base score are words and one end for each text; score is the attention model's log10 probability of
    the text's subword ids and its end. Null and empty texts are one end. Rows that repeat an id or a text all count.
    Held-out documents are scored and not learnt from. With nothing to learn from, no token is known.

    The driver reads the vocabulary's file and begins the model's weights on FIRST_DOCS documents. Classes, counts, the
    training that follows, on every window, and the share of the model beside the counts of neighbours come from all
    training documents where they lie; the weights of tasks are averaged by what they trained on, so that scores depend
    a little on how the documents are dealt to tasks. Counts of the HEAD_WORDS most frequent words travel to all tasks,
    all others are joined by word. A text's ids are held at once; other columns aren't read.
    """
    with open(vocabulary, "rb") as f:
        ranks = f.read()
    kind = docs.schema[id_col].dataType
    model, rare = fit(docs, ranks, id_col, text_col)
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.monotonically_increasing_id().alias("rid"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("body"))
    shared = docs.sparkSession.sparkContext.broadcast((ranks, model))
    scored = materialize(rows.mapInArrow(lean(lambda b: score_rows(b, *shared.value)), "id string, rid long, held_out boolean, n_tokens long, known long, base double, score double, words array<long>, times array<int>"))
    scale = float(np.log10(model.total + model.distinct + 1))
    tail = scored.select("rid", F.explode(F.arrays_zip("words", "times")).alias("x")).select("rid", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    tail = tail.join(rare, "word", "left")
    tail = tail.groupBy("rid").agg(F.sum(F.col("times") * (F.log10(F.coalesce("count", F.lit(0)) + 1) - scale)).alias("more"), F.sum(F.when(F.col("count") > 0, F.col("times")).otherwise(0)).alias("seen"))
    ends = rows.agg(F.count_if(~F.col("held_out"))).first()[0]
    out = scored.drop("words", "times").join(tail, "rid", "left")
    return out.select(
        F.col("id").cast(kind).alias(id_col), "rid", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("seen", F.lit(0)) + F.lit(int(ends > 0))).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) + F.lit(float(np.log10(ends + 1)) - scale)).alias("base_score"), "score",
    )
