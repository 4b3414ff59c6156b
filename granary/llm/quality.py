"""Quality classifier by co-training: a text view and a metadata view teach each other, and calibrated views combine.

Each view keeps tables of how many good and bad documents hold a word, or a value of metadata. Tables are sums, so all
documents can add to them where they lie: first the labelled ones, then, round by round, every unlabelled document that
one view is sure of adds to the tables of the other. What a document's words or values say by these tables, a few
numbers, enters a small logistic regression for each view.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.common import Words, bounded_sample, lean, materialize, packed, slices, string_bytes, summed

#: Labelled documents to learn from at most; this is the only bound, all other documents take part.
LABELLED_DOCS = 20_000
#: Counters of words, in bits; values of the metadata columns.
WORD_BITS, META_BINS = 18, 512
#: Rounds of co-training; certainty from which a document counts as labelled, how far its odds must then lie from those
#: of all documents (as a logarithm), and how much all such documents count beside the labelled ones of their class.
ROUNDS, SURE, BEYOND, WEIGHT = 2, 0.97, 1.5, 0.5
#: Documents whose combined chance of being bad reaches LIMIT are rejected.
LIMIT = 0.5
SHAPES = 8
#: Counters of words that have a weight of their own in the text view's regression, at most.
TELLING = 768

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[*range(33, 127)]] = True
_SYMBOL[[*range(48, 58), *range(65, 91), *range(97, 123), 44, 46]] = False


class TextRows:
    """What the text view reads of some texts: distinct word hashes by row, and shares that don't depend on words."""

    def __init__(self, texts: pa.Array):
        rows, hashes, shapes, at = [], [], [], 0
        data, offsets = string_bytes(texts)
        for lo, hi in slices(offsets):
            w = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            h, n = w.hashes(), hi - lo
            pairs = distinct(w.row, h)
            rows.append(pairs[0] + at)
            hashes.append(pairs[1])
            size = np.maximum(w.counts, 1)
            symbols = np.concatenate([[0], np.cumsum(_SYMBOL[w.data])])
            length = np.maximum(np.diff(w.offsets), 1)
            again = np.zeros(len(h), bool)
            again[1:] = (h[1:] == h[:-1]) & (w.row[1:] == w.row[:-1])
            odd = symbols[w.ends] - symbols[w.starts]
            part = lambda x, w=w, n=n: np.bincount(w.row, weights=x, minlength=n)
            shapes.append(np.stack([
                np.diff(symbols[w.offsets]) / length * 5, part(again) / size, 1 - np.bincount(pairs[0], minlength=n) / size,
                part(odd >= 2) / size, part((odd > 0) & (odd == w.ends - w.starts)) / size * 3, np.log1p(w.counts) / 8,
                np.minimum(part(w.ends - w.starts) / size, 20) / 10, (w.counts == 0).astype(float),
            ], 1))
            at += n
        none = np.zeros(0, np.int64)
        self.n = at
        self.row = np.concatenate(rows) if rows else none
        self.hash = np.concatenate(hashes) if hashes else none.astype(np.uint64)
        self.shapes = np.concatenate(shapes) if shapes else np.zeros((0, SHAPES))


def distinct(row: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (row, hash) pairs."""
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    return row[new], hashes[new]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, decay: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression with an L2 penalty, by gradients scaled for each column."""
    x = x.astype(np.float32, copy=False)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    seen, seen_b = np.full(x.shape[1], 1e-8, np.float32), 1e-8
    total = max(weight.sum(), 1.0)
    for _ in range(steps):
        miss = ((sigmoid(x @ w + b) - y) * weight / total).astype(np.float32)
        g, gb = x.T @ miss + decay * w, miss.sum()
        seen, seen_b = seen + g * g, seen_b + gb * gb
        w, b = w - 0.5 * g / np.sqrt(seen), b - 0.5 * gb / np.sqrt(seen_b)
    return w, float(b)


def odds(table: np.ndarray) -> np.ndarray:
    """Log odds of bad over good for each counter of a table of (good, bad) documents; the last place holds all documents."""
    good, bad = table[0, :-1], table[1, :-1]
    out = np.log((bad + 0.5) / (table[1, -1] + 1)) - np.log((good + 0.5) / (table[0, -1] + 1))
    out[good + bad < 2.5] = 0
    return out


def telling_words(table: np.ndarray) -> np.ndarray:
    """The counters whose share differs most, in standard errors, between good and bad documents; TELLING of them at most."""
    seen, share = table[:, :-1].sum(0), table[1, -1] / max(table[:, -1].sum(), 1)
    z = np.abs(table[1, :-1] - seen * share) / np.sqrt(seen * share * (1 - share) + 1e-9)
    z[seen < 2.5] = 0
    pick = np.argsort(-z, kind="stable")[:TELLING]
    return np.sort(pick[z[pick] >= 2.5])


@dataclass
class CoTrained:
    """Tables of both views, weights of their regressions, and of their combination. Without weights everything is good."""

    tables: tuple[np.ndarray, np.ndarray]
    weights: tuple | None = None
    combine: tuple[float, float, float] = (1.0, 0.0, 0.0)
    prior: float = 0.0
    word_weights: np.ndarray | None = None

    def __post_init__(self):
        self.odds = tuple(map(odds, self.tables))
        self.telling = telling_words(self.tables[0])

    def evidence(self, rows: TextRows, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers that the regressions of both views read."""
        o = self.odds[0][word_bins(rows)]
        n = np.bincount(rows.row, minlength=rows.n)
        total = np.bincount(rows.row, weights=o, minlength=rows.n)
        most, least = np.zeros(rows.n), np.zeros(rows.n)
        np.maximum.at(most, rows.row, o)
        np.minimum.at(least, rows.row, o)
        telling = np.bincount(rows.row, weights=o > 2, minlength=rows.n)
        size = np.maximum(n, 1)
        text = np.stack([total / np.sqrt(size) / 4, total / size, most / 3, least / 3, np.log1p(telling), telling / size * 10], 1)
        return np.concatenate([text, rows.shapes], 1), self.odds[1][bins]

    def scores(self, rows: TextRows, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chance of being bad by the text view, the metadata view, and both."""
        if self.weights is None:
            return (np.zeros(rows.n),) * 3
        t, m = (x @ w + b for x, (w, b) in zip(self.evidence(rows, bins), self.weights, strict=True))
        t = t + np.bincount(rows.row, weights=self.word_weights[word_bins(rows)], minlength=rows.n)
        a, b, c = self.combine
        return sigmoid(t), sigmoid(m), sigmoid(a * t + b * m + c)


def word_bins(rows: TextRows) -> np.ndarray:
    return (rows.hash >> np.uint64(64 - WORD_BITS)).astype(np.int64)


def add_documents(tables: tuple[np.ndarray, np.ndarray], rows: TextRows, bins: np.ndarray, bad: np.ndarray, text: np.ndarray, meta: np.ndarray) -> None:
    """Adds documents to the tables: `text` and `meta` tell which of them add to which."""
    width = tables[0].shape[1]
    own = text[rows.row]
    tables[0][:] += np.bincount(bad[rows.row[own]] * width + word_bins(rows)[own], minlength=2 * width).reshape(2, -1)
    tables[0][:, -1] += np.bincount(bad[text], minlength=2)
    width = tables[1].shape[1]
    tables[1][:] += np.bincount((bad[meta][:, None] * width + bins[meta]).ravel(), minlength=2 * width).reshape(2, -1)
    tables[1][:, -1] += np.bincount(bad[meta], minlength=2)


def fresh() -> tuple[np.ndarray, np.ndarray]:
    return np.zeros((2, (1 << WORD_BITS) + 1)), np.zeros((2, META_BINS + 1))


def parts_of(batches, width: int):
    """Each batch in slices: rows of the batch, what the text view reads of them, their metadata bins."""
    for batch in batches:
        body, bins = batch.column("body"), batch.column("bins").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width).astype(np.int64)
        for lo, hi in slices(string_bytes(body)[1]):
            yield batch.slice(lo, hi - lo), TextRows(body.slice(lo, hi - lo)), bins[lo:hi]


def count_labelled(batches, width: int):
    """The tables of the labelled documents of the first fold."""
    tables = fresh()
    for part, rows, bins in parts_of(batches, width):
        learn = part.column("fold").to_numpy() == 0
        add_documents(tables, rows, bins, part.column("bad").to_numpy().astype(np.int64), learn, learn)
    yield packed(np.concatenate([x.ravel() for x in tables]))


def read_evidence(batches, width: int, model: CoTrained):
    """What the regressions read of the labelled documents of the other folds."""
    for part, rows, bins in parts_of(batches, width):
        text, meta = model.evidence(rows, bins)
        other = np.flatnonzero(part.column("fold").to_numpy() > 0)
        spot = np.minimum(np.searchsorted(model.telling, own := word_bins(rows)), max(len(model.telling) - 1, 0))
        hit = np.flatnonzero(model.telling[spot] == own) if len(model.telling) else np.zeros(0, np.int64)
        words = [spot[hit[a:z]] for a, z in zip(*np.searchsorted(rows.row[hit], (other, other + 1)), strict=True)]
        yield pa.RecordBatch.from_arrays([part.column("place").take(pa.array(other)), part.column("fold").take(pa.array(other)), part.column("bad").take(pa.array(other)), pa.array(list(text[other]), pa.list_(pa.float64())), pa.array(list(meta[other]), pa.list_(pa.float64())), pa.array(words, pa.list_(pa.int64()))], names=["place", "fold", "bad", "text", "meta", "words"])


def count_sure(batches, width: int, model: CoTrained, known: np.ndarray):
    """The tables of all unlabelled documents: those that the metadata view is sure of add to the words', and the other way round."""
    tables = fresh()
    for part, rows, bins in parts_of(batches, width):
        place = part.column("place").to_numpy()
        at = np.minimum(np.searchsorted(known, place), max(len(known) - 1, 0))
        free = known[at] != place if len(known) else np.ones(len(place), bool)
        for k, view in enumerate(model.scores(rows, bins)[:2]):
            far = np.abs(np.log(np.clip(view, 1e-9, 1)) - np.log(np.clip(1 - view, 1e-9, 1)) - model.prior) >= BEYOND
            sure = free & far & (np.maximum(view, 1 - view) >= SURE)
            none = np.zeros_like(sure)
            add_documents(tables, rows, bins, (view > 0.5).astype(np.int64), sure if k else none, none if k else sure)
    yield packed(np.concatenate([x.ravel() for x in tables]))


def unpacked(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    text, meta = fresh()
    return flat[: text.size].reshape(text.shape), flat[text.size :].reshape(meta.shape)


def together(own: tuple, said: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The labelled documents' tables and the others', these by WEIGHT, or less where they outnumber the labelled of their class."""
    out = []
    for have, new in zip(own, said, strict=True):
        weight = WEIGHT * np.minimum(1, have[:, -1] / np.maximum(new[:, -1], 1))
        out.append(have + weight[:, None] * new)
    return tuple(out)


def fitted(tables: tuple, lesson: DataFrame, width: int) -> CoTrained:
    """The model of some tables: one fold of labelled documents fits each view's regression, the last one combines them."""
    spark = lesson.sparkSession
    model = CoTrained(tables)
    shared = spark.sparkContext.broadcast(model)
    found = lesson.mapInArrow(lean(lambda b: read_evidence(b, width, shared.value)), "place long, fold long, bad int, text array<double>, meta array<double>, words array<long>").toPandas().sort_values("place")
    fold, bad = found["fold"].to_numpy(), found["bad"].to_numpy().astype(float)
    text, meta = (np.array(found[c].tolist(), np.float32).reshape(len(found), -1) for c in ("text", "meta"))
    dense, text = text.shape[1], np.concatenate([text, np.zeros((len(found), len(model.telling)), np.float32)], 1)
    for i, words in enumerate(found["words"]):
        text[i, dense + np.asarray(words, np.int64)] = 1
    views = []
    for x, decay in ((text, 1e-4), (meta, 1e-3)):
        views.append(fit(x[fold == 1], bad[fold == 1], np.ones(int((fold == 1).sum())), decay))
    last = fold == 2
    both = np.stack([np.clip(x[last] @ w + b, -30, 30) for x, (w, b) in zip((text, meta), views, strict=True)], 1)
    w, b = fit(both, bad[last], np.ones(int(last.sum())), 1e-4)
    word_weights = np.zeros(1 << WORD_BITS, np.float32)
    word_weights[model.telling] = views[0][0][dense:]
    views[0] = views[0][0][:dense], views[0][1]
    return CoTrained(tables, tuple(views), (float(w[0]), float(w[1]), b), float(np.log((bad.sum() + 1) / (len(bad) - bad.sum() + 1))), word_weights)


def meta_bins(docs: DataFrame, columns: list[str]):
    """A bin for each metadata column: strings by hash, numbers by size in steps of half a power of two."""
    bins = []
    for k, name in enumerate(columns):
        value = F.col(name)
        if isinstance(docs.schema[name].dataType, T.NumericType):
            value = F.floor(2 * F.log2(F.greatest(value.cast("double"), F.lit(1.0))))
        bins.append(F.pmod(F.xxhash64(F.lit(k), value.cast("string")), F.lit(META_BINS)).cast("int"))
    return F.array(*bins).cast("array<int>")


def train_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple[str, ...] = ("source", "lang", "n_chars"), labelled: int = LABELLED_DOCS, rounds: int = ROUNDS) -> CoTrained:
    """The model from labels (id, quality, toxic): bad is quality 0 or toxic 1; where a label repeats, the worst counts.

    At most `labelled` documents with labels teach it, those with the smallest hashes of their ids; a third of them
    fills the tables, a third fits each view's regression, a third combines the views. All other documents, with
    or without labels, are scored in each round, and those that a view is sure of add to the other view's tables.
    Only sums, and a few numbers for each labelled document, reach the driver. With fewer than thirty labels, or one
    kind only in a third, nothing is rejected. Null ids have no labels; rows that repeat a labelled id all count.
    """
    spark = docs.sparkSession
    meta_cols = [c for c in meta_cols if c in docs.columns]
    width = len(meta_cols)
    place = F.xxhash64(F.lit(5), F.col(id_col))
    rows = docs.select(F.when(F.col(id_col).isNotNull(), place).otherwise(0).alias("place"), F.col(text_col).alias("body"), meta_bins(docs, meta_cols).alias("bins"))
    bad = F.max(((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("int"))
    marks = labels.filter(F.col(id_col).isNotNull() & (F.col("quality").isNotNull() | F.col("toxic").isNotNull())).groupBy(place.alias("place")).agg(bad.alias("bad"))
    known = sorted((r["place"], r["bad"]) for r in bounded_sample(marks, labelled, F.col("place")))
    nothing = CoTrained(fresh())
    if len(known) < 30:
        return nothing
    asked = F.broadcast(spark.createDataFrame(known, "place long, bad int"))  # at most `labelled` pairs of numbers
    lesson = materialize(rows.join(asked, "place").withColumn("fold", F.pmod(F.xxhash64(F.lit(9), "place"), F.lit(3))))
    kinds = {(r["fold"], r["bad"]) for r in lesson.groupBy("fold", "bad").count().collect()}
    if len(kinds) < 6:
        return nothing
    size = sum(x.size for x in fresh())
    own = unpacked(summed(lesson.mapInArrow(lean(lambda b: count_labelled(b, width)), "sums binary"), size))
    model = fitted(own, lesson, width)
    names = np.array([k for k, _ in known], np.int64)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((model, names))
        said = summed(rows.mapInArrow(lean(lambda b, s=shared: count_sure(b, width, *s.value)), "sums binary"), size)
        model = fitted(together(own, unpacked(said)), lesson, width)
    return model


def with_scores(rows: DataFrame, model: CoTrained, text: str, meta: list[str], limit: float) -> DataFrame:
    """rows with text_bad, meta_bad, bad and keep; rows has none of these names, nor `bins`."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    width = len(meta)

    def run(batches):
        for batch in batches:
            own = batch.select([*range(batch.num_columns - 1)])
            renamed = pa.RecordBatch.from_arrays([batch.column(text), batch.column("bins")], names=["body", "bins"])
            parts = [shared.value.scores(rows_, bins) for _, rows_, bins in parts_of([renamed], width)]
            t, m, both = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in range(3))
            yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array(x, pa.float64()) for x in (t, m, both)), pa.array(both < limit)], names=[*own.schema.names, "text_bad", "meta_bad", "bad", "keep"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.withColumn("bins", meta_bins(rows, meta)).mapInArrow(lean(run), f"{schema}, text_bad double, meta_bad double, bad double, keep boolean")


def numbered(docs: DataFrame) -> DataFrame:
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))


def score_quality(docs: DataFrame, model: CoTrained, text_col: str = "text", meta_cols: tuple[str, ...] = ("source", "lang", "n_chars"), limit: float = LIMIT) -> DataFrame:
    """The columns of docs with text_bad, meta_bad, bad (chances) and keep; such columns of docs are replaced.

    Every row is scored on its whole text. Null and empty texts have no words and are judged by that and by their
    metadata; null metadata is a value of its own. Rows that repeat score alike. An empty table stays empty.
    """
    docs = docs.drop("text_bad", "meta_bad", "bad", "keep")
    meta = [f"c{docs.columns.index(c)}" for c in meta_cols if c in docs.columns]
    found = with_scores(numbered(docs), model, f"c{docs.columns.index(text_col)}", meta, limit)
    return found.toDF(*docs.columns, "text_bad", "meta_bad", "bad", "keep")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple[str, ...] = ("source", "lang", "n_chars")) -> DataFrame:
    """The rows of docs that the classifier keeps, with their columns as they were, whatever their names."""
    meta = [f"c{docs.columns.index(c)}" for c in meta_cols if c in docs.columns]
    found = with_scores(numbered(docs), train_quality(docs, labels, id_col, text_col, meta_cols), f"c{docs.columns.index(text_col)}", meta, LIMIT)
    return found.filter("keep").drop("text_bad", "meta_bad", "bad", "keep").toDF(*docs.columns)
