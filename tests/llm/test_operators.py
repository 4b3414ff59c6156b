"""The operators against plain versions, on the small tables and on hand-made edge cases."""

import collections
import hashlib
import math
import re
import zlib

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA, against_sql
from pyspark.sql import functions as F

from granary.llm import lm_score, near_dup, queries, suffix_dedup
from granary.llm.common import Words, string_bytes
from granary.llm.decontaminate import find_contamination, remove_contaminated
from granary.llm.exact_dedup import assign_copies
from granary.llm.line_dedup import repeated_lines
from granary.llm.lm_score import score_documents
from granary.llm.mixing import cyclic_weights, mix_plan, mix_sources
from granary.llm.quality import keep_good, score_quality, train_quality
from granary.llm.secrets import find_secrets
from granary.llm.sharding import assign_shards

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, keep boolean, id string"
PHRASE = "one two three four five six seven eight nine ten eleven twelve "
ODD = [
    (1, None, "en", None, None, 7, None, "x"), (2, "", "en", "a", 0, None, True, None), (3, " \t\n", None, "a", 3, None, None, None),
    (4, PHRASE * 400, "en", "a", 9, None, None, None), (5, PHRASE * 400, "en", "b", 9, None, None, None), (5, "short text", "en", "b", 9, None, None, None),
    (6, "Short  text", "de", "b", 1, None, None, None), (7, "ümlaut " * 90, "de", None, 1, None, None, None), (None, "password: abcdefgh12345678", "en", "a", 1, None, None, None),
]


def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    against_sql(spark, queries.queries()[name], queries.oracle_sql()[name])


def plain_near(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
    least = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            if least[a] != least[b]:
                least[a] = least[b] = min(least[a], least[b])
                changed = True
    return {i: (len(sets[i]), least[i]) for i in sets}


@pytest.mark.parametrize("frequent", [32, 0])
def test_near_duplicates(spark, monkeypatch, frequent):
    monkeypatch.setattr(near_dup, "FREQUENT", frequent)
    monkeypatch.setattr(near_dup, "VERY_FREQUENT", frequent + 3)
    rows = documents(spark).select("doc_id", "text")
    base = PHRASE.split()
    more = [(10_000 + k, " ".join(x if j % 97 != k else f"w{k}" for j, x in enumerate(base * 20 + [f"t{m}" for m in range(300)]))) for k in range(60)]
    rows = rows.unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(rows).collect()}
    assert got == plain_near([tuple(r) for r in rows.collect()])


@pytest.mark.parametrize("rows_at_once", [512, 7])
def test_near_duplicate_links(spark, monkeypatch, rows_at_once):
    """n_links against all pairs: near copies of one another, a chain whose ends are apart, and exact copies."""
    monkeypatch.setattr(near_dup, "LINK_ROWS", rows_at_once)
    base = [f"b{m}" for m in range(400)]
    rows = [(k, " ".join(x if j != 9 * k else f"w{k}" for j, x in enumerate(base))) for k in range(20)]
    rows += [(100 + k, " ".join(f"c{m}" for m in range(15 * k, 15 * k + 300))) for k in range(12)]
    rows += [(200 + k, rows[3][1]) for k in range(3)] + [(300, "alone in this table"), (301, "alone in this table"), (302, None)]
    words = {i: (t or "").split() for i, t in rows}
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(len(w) - 4, min(len(w), 1)))} for i, w in words.items()}
    want = {i: sum(j != i and 100 * len(a & b) >= 80 * len(a | b) for j, b in sets.items()) if a else 0 for i, a in sets.items()}
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["n_links"] for r in got} == want


def test_keep_one_of_each_repeated_ids(spark):
    """Rows that share an id and nothing else stay; of copies the smallest id stays, a null id last."""
    other = " ".join(f"w{k}" for k in range(40))
    third = " ".join(f"x{k}" for k in range(40))
    rows = [(1, PHRASE * 4, 0), (1, other, 1), (1, other, 2), (2, PHRASE * 4, 3), (3, None, 4), (3, None, 5), (None, third, 6), (None, third, 7), (None, other, 8)]
    got = near_dup.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string, n long").coalesce(1))
    assert sorted(r["n"] for r in got.collect()) == [0, 1, 4, 5, 6]


def test_pipeline_near_duplicates(spark):
    """The stage keeps the least id of each plain component, and all that have no shingles."""
    rows = documents(spark)
    plain = plain_near([(r["doc_id"], r["text"]) for r in rows.collect()])
    got = corpus_pipeline.near_duplicates(spark, rows, DATA)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(i for i, (n, least) in plain.items() if least == i or not n)


def plain_hits(texts, items):
    """Numbers of the texts that hold ten consecutive words of an item, or all words of a shorter one."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    spans = lambda w, n: {tuple(w[j : j + n]) for j in range(len(w) - n + 1)}
    items = [w for w in map(words, items) if w]
    sizes = {min(len(w), 10) for w in items}
    wanted = {n: set().union(*(spans(w, n) for w in items if min(len(w), 10) == n)) for n in sizes}
    return {k for k, t in enumerate(texts) if any(spans(words(t), n) & wanted[n] for n in sizes)}


def test_pipeline(spark):
    """Each stage on what its predecessor kept: near duplicates and decontamination against plain versions, the other stages
    to what must be true of them; run() gives as many rows of each document."""
    docs, kept = documents(spark), {}
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, DATA)
        kept[name] = docs = spark.createDataFrame(got.collect(), got.schema)
    good, alone, clean, mixed, shards = (kept[name].collect() for name, _ in corpus_pipeline.STAGES)
    assert all(kept[name].columns == names for name, _ in corpus_pipeline.STAGES[:-1])
    assert len(good) > 0.5 * documents(spark).count()
    plain = plain_near([(r["doc_id"], r["text"]) for r in good])
    assert sorted(r["doc_id"] for r in alone) == sorted(i for i, (n, least) in plain.items() if least == i or not n)
    hit = plain_hits([r["text"] for r in alone], [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()])
    assert hit and sorted(map(tuple, clean), key=repr) == sorted((tuple(r) for k, r in enumerate(alone) if k not in hit), key=repr)
    times = collections.Counter(map(tuple, mixed))
    assert set(times) <= set(map(tuple, clean)) and max(times.values()) <= 2
    assert collections.Counter(r["doc_id"] for r in shards) == collections.Counter(r["doc_id"] for r in mixed)
    size = collections.Counter()
    for r in shards:
        size[r["shard"]] += r["n_bytes"]
    assert all(size[r["shard"]] == r["shard_bytes"] for r in shards)
    assert collections.Counter(r["doc_id"] for r in corpus_pipeline.run(spark, DATA).collect()) == collections.Counter(r["doc_id"] for r in shards)


def plain_strip(rows, length):
    bodies = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter(b[p : p + length] for _, b in bodies for p in range(len(b) - length + 1))
    out = []
    for i, b in bodies:
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("places", [4096, 2])
def test_repeated_strings(spark, monkeypatch, places):
    monkeypatch.setattr(suffix_dedup, "BLOCK_PLACES", places)
    rows = documents(spark).select("doc_id", "text").filter("length(text) < 4000")
    rows = rows.unionByName(odd(spark).select("doc_id", "text").filter("doc_id <> 5 or doc_id is null"))
    got = sorted((tuple(r) for r in suffix_dedup.repeated_strings(rows).drop("rid").collect()), key=repr)
    assert got == plain_strip([tuple(r) for r in rows.collect()], 400)


def test_language_model(spark):
    got = {r["doc_id"]: r for r in score_documents(documents(spark)).collect()}
    rows = [(i, re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + [None]) for i, t in documents(spark).select("doc_id", "text").collect()]
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    counts = collections.Counter(w for i, ws in rows if not out[i] for w in ws)
    scale = math.log10(sum(counts.values()) + len(counts) + 1)
    for i, ws in rows:
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[i], len(ws), sum(w in counts for w in ws), sum(counts.values()))
        assert math.isclose(r["base_score"], sum(math.log10(counts[w] + 1) - scale for w in ws), rel_tol=1e-9)
    held = [r for r in got.values() if r["held_out"]]
    ids = sum(r["n_tokens"] for r in held) * 3
    assert sum(r["score"] for r in held) > ids * -math.log10(50257) / 2  # far better than chance


def test_language_model_learns_from_all(spark, monkeypatch):
    """Classes follow the ids of all training documents, and every window of a small task trains."""
    monkeypatch.setattr(lm_score, "FIRST_DOCS", 1)
    monkeypatch.setattr(lm_score, "FIRST_STEPS", 1)
    with open(lm_score.VOCABULARY_FILE, "rb") as f:
        ranks = f.read()
    rows = documents(spark).select("doc_id", "text")
    model = lm_score.fit(rows, ranks, "doc_id", "text")[0]
    texts = pa.array([t for i, t in rows.collect() if zlib.crc32(str(i).encode()) % 7 != 2], pa.string())
    words = Words(*string_bytes(texts))
    ids, begin = lm_score.Subwords(ranks).sequences(words, words.hashes())
    inner = np.delete(np.arange(len(ids)), begin[:-1])
    assert (model.classes == lm_score.class_table(np.bincount(ids[inner], minlength=lm_score.IDS).astype(float))).all()

    few = pa.RecordBatch.from_arrays([pa.array(["one two three", "four", None, PHRASE * 3])], names=["body"])
    words = Words(*string_bytes(few.column("body")))
    begin = lm_score.Subwords(ranks).sequences(words, words.hashes())[1]
    left = lm_score.window_places(begin)[2]
    start = lm_score.Attention.fresh()
    last = list(lm_score.gather([few], ranks, model.classes, start, np.full((1, lm_score.CLASSES), 1 / lm_score.CLASSES)))[-1]
    sums = np.frombuffer(zlib.decompress(last.column("sums")[0].as_py()))
    assert sums[-len(start.pack()) - 1] == np.minimum(left, lm_score.SEEN).sum()
    assert not np.allclose(sums[-len(start.pack()) :] / sums[-len(start.pack()) - 1], start.pack())


def test_attention_slopes():
    """Slopes of the loss equal its differences; ids of a task are counted as often as they stand."""
    rng = np.random.default_rng(0)
    model = lm_score.Attention({k: x.astype(np.float64) for k, x in lm_score.Attention.fresh(3).weights.items()})
    x, target = rng.integers(0, lm_score.CLASSES, (2, 3, lm_score.SEEN))
    weight = rng.random(x.size)
    slopes = model.slopes(x, target, weight)[1]

    def loss() -> float:
        return -(weight * np.log(model.slopes(x, target, weight)[0].ravel())).sum()

    for name, w in model.weights.items():
        for _ in range(5):
            at = tuple(int(rng.integers(0, n)) for n in w.shape)
            at = (int(x[0, 0]), at[1]) if name == "e" else at
            old = w[at]
            w[at] = old + 1e-5
            up = loss()
            w[at] = old - 1e-5
            down = loss()
            w[at] = old
            assert math.isclose((up - down) / 2e-5, slopes[name][at], rel_tol=1e-3, abs_tol=1e-5)

    with open(lm_score.VOCABULARY_FILE, "rb") as f:
        ranks = f.read()
    texts = pa.array(["a rose is a rose", None, "", PHRASE * 3], pa.string())
    words = Words(*string_bytes(texts))
    ids, begin = lm_score.Subwords(ranks).sequences(words, words.hashes())
    plain = np.bincount(np.delete(ids, begin[:-1]), minlength=lm_score.IDS)
    assert (lm_score.Subwords(ranks).counts(words, words.hashes()) == plain).all()


def test_quality(spark):
    folder = DATA.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    scored = score_quality(docs, train_quality(docs, labels)).join(labels, "doc_id").collect()
    assert sum(r["keep"] == (r["quality"] == 1 and r["toxic"] == 0) for r in scored) > 0.9 * len(scored)
    assert score_quality(docs, train_quality(docs, labels.limit(0))).filter("not keep").isEmpty()


def test_secrets(spark):
    got = {r["doc_id"]: r["spans"] for r in find_secrets(odd(spark)).collect()}
    assert [(s["kind"], s["start"], s["end"]) for s in got[None]] == [("assign", 0, 26)]
    assert got[1] == [] and got[2] == []


def test_secret_rules(spark):
    """The query's base spans on all documents, by the rules as they are written."""
    assign = re.compile(r"""(?ia:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    got = {r["doc_id"]: r for r in queries.op3_secret_scan(spark, DATA).collect()}
    for i, t in documents(spark).select("doc_id", "text").collect():
        t = t or ""
        found = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 12]
        found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16]
        spans = [f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(found)]
        r = got[i]
        assert r["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == j for _, k, _ in found) for j in range(3))
        assert set(spans) <= set(r["spans"].split(","))


def test_mixing(spark):
    plan = mix_plan(documents(spark), cyclic_weights(5, 2, 1)).collect()
    assert len(plan) == documents(spark).count()
    assert all(len(r["draws"]) <= 2 for r in plan)
    again = mix_plan(documents(spark).repartition(3), cyclic_weights(5, 2, 1)).collect()
    assert sorted((r["id"], len(r["draws"])) for r in plan) == sorted((r["id"], len(r["draws"])) for r in again)
    taken, target = collections.Counter(), {}
    for r in plan:
        taken[r["source"]] += r["size"] * len(r["draws"])
        target[r["source"]] = r["target"]
    assert abs(sum(taken.values()) - sum(target.values())) < 0.1 * sum(target.values())


def test_sharding(spark):
    got = assign_shards(documents(spark), 50_000).collect()
    size = collections.Counter()
    for r in got:
        size[r["shard"]] += len((r["text"] or "").encode())
    assert len(got) == documents(spark).count() and len(size) > 3
    assert all(size[r["shard"]] == r["shard_bytes"] and (r["shard_bytes"] <= 50_000 or r["shard_rows"] == 1) for r in got)


def test_contamination_keeps_clean(spark):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    hit = {r["doc_id"] for r in find_contamination(documents(spark), bench).filter("n_hit > 0").collect()}
    kept = {r["doc_id"] for r in remove_contaminated(documents(spark), bench).collect()}
    assert hit and kept == {r["doc_id"] for r in documents(spark).collect()} - hit


def test_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows, ids and names that clash: every operator gives a row for each."""
    rows, n = odd(spark), len(ODD)
    bench = spark.createDataFrame([(1, PHRASE), (2, None), (3, "")], "item_id long, text string")
    labels = spark.createDataFrame([(None, 0, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    for df in (
        assign_copies(rows), repeated_lines(rows), find_secrets(rows), mix_plan(rows, cyclic_weights(1)), assign_shards(rows), find_contamination(rows, bench),
        near_dup.near_duplicates(rows), suffix_dedup.repeated_strings(rows), score_documents(rows), score_quality(rows, train_quality(rows, labels)),
    ):
        assert df.count() == n


def test_empty_tables(spark):
    rows = odd(spark).limit(0)
    bench, labels = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for df in (
        assign_copies(rows), repeated_lines(rows), find_secrets(rows), mix_sources(rows, cyclic_weights(1)), assign_shards(rows), find_contamination(rows, bench), near_dup.near_duplicates(rows),
        near_dup.keep_one_of_each(rows), suffix_dedup.repeated_strings(rows), score_documents(rows), keep_good(rows, labels), remove_contaminated(rows, bench),
    ):
        assert df.count() == 0


def test_sharding_of_repeated_rows(spark):
    """Rows that repeat id and text are parted by their numbers, beyond the first 62 bits; every shard keeps its limit."""
    rows = [(1, "x" * 400)] * 30 + [(k, "y" * k) for k in range(60)] + [(None, None), (7, "z" * 5000)]
    got = assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), 1000).collect()
    size, count = collections.Counter(), collections.Counter()
    for r in got:
        size[r["shard"]] += len((r["text"] or "").encode())
        count[r["shard"]] += 1
    assert len(got) == len(rows) and sorted(size) == list(range(len(size)))
    assert all((size[r["shard"]], count[r["shard"]]) == (r["shard_bytes"], r["shard_rows"]) for r in got)
    assert all(r["shard_bytes"] <= 1000 or r["shard_rows"] == 1 for r in got)
    order = sorted({(r["shard"], r["shard_prefix"]) for r in got})
    assert [p for _, p in order] == sorted(p for _, p in order) and all(r["shard_bits"] == len(r["shard_prefix"]) for r in got)


def test_mixing_sources_near_targets(spark, monkeypatch):
    """Each source's taken words against its target, with a tree of many shards; mix_sources gives the plan's rows."""
    from granary.llm import mixing

    monkeypatch.setattr(mixing, "SHARD_WORDS", 5000)
    plan = mix_plan(documents(spark), cyclic_weights(5, 2, 1)).collect()
    most, taken, target = collections.Counter(), collections.Counter(), {}
    for r in plan:
        taken[r["source"]] += r["size"] * len(r["draws"])
        most[r["source"]] = max(most[r["source"]], r["size"])
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= most[s] + 2 * 256 for s in target)
    assert len({d["shard"] for r in plan for d in r["draws"]}) > 10
    size = collections.Counter()
    for r in plan:
        for d in r["draws"]:
            size[d["shard"]] += r["size"]
    assert sum(size.values()) / len(size) / 3 < sorted(size.values())[len(size) // 2] < 3 * sum(size.values()) / len(size)
    mixed = collections.Counter(r["doc_id"] for r in mix_sources(documents(spark), cyclic_weights(5, 2, 1)).collect())
    assert mixed == collections.Counter({r["id"]: len(r["draws"]) for r in plan if r["draws"]})


def test_splitting_tree():
    """A node's blocks are dealt to its leaves without loss, by sources, and in about equal numbers."""
    from granary.llm import mixing

    quotas = np.array([1000, 0, 37, 5000])
    leaves = mixing.split(quotas, 0, 13, 1, 7)
    assert [lo for lo, _, _ in leaves] == list(range(13))
    assert (sum(part for _, _, part in leaves) == quotas).all()
    assert all(abs(part.sum() - quotas.sum() / 13) <= 4 for _, _, part in leaves)
    assert (mixing.split(quotas, 0, 13, 1, 7)[5][2] == leaves[5][2]).all()


def test_exact_copies_of_clashing_digests(spark):
    """Texts of one digest are told apart by their content; a repeated row stays once."""
    rows = [(5, "a b"), (3, "a  b"), (4, "c"), (9, "c"), (9, "c"), (None, "d"), (None, "d"), (2, None), (1, " "), (2, None), (1, " ")]
    want = assign_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = assign_copies(spark.createDataFrame(rows, "doc_id long, text string"), digest=lambda t: F.lit("same")).collect()
    for found in (want, got):
        assert sorted((r["doc_id"] or 0, r["keep_id"] or 0, r["group_size"], r["kept"]) for r in found) == sorted([
            (5, 3, 2, False), (3, 3, 2, True), (4, 4, 3, True), (9, 4, 3, False), (9, 4, 3, False), (0, 0, 2, True), (0, 0, 2, False),
            (2, 2, 2, True), (2, 2, 2, False), (1, 1, 2, True), (1, 1, 2, False)])


@pytest.mark.parametrize("run", [2, 3, 5])
def test_line_runs(spark, run):
    """Repeated runs of lines against a plain search, with ties, hot lines and overlaps."""
    from granary.llm import line_dedup

    rng = np.random.default_rng(run)
    rows = [(k, "\n".join(rng.choice(["a", "b", "c", "d", ""], 14))) for k in range(40)] + [(7, "a\na\na\na\na\na\na"), (50, None), (51, "")]
    rows = [(i, t) for i, t in rows if i != 7 or t.startswith("a\na\na\na\na\na\na")]
    first, want = {}, {}
    for i, t in sorted(rows):
        lines = t.split("\n") if t else []
        gone = set()
        for p in range(len(lines) - run + 1):
            if first.setdefault(tuple(lines[p : p + run]), (i, p)) != (i, p):
                gone |= set(range(p, p + run))
        want[i] = (len(lines), len(gone), "\n".join(x for p, x in enumerate(lines) if p not in gone))
    got = repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), run).collect()
    assert {r["doc_id"]: (r["n_lines"], r["n_removed"], r["kept_text"]) for r in got} == want
    texts = [t for _, t in rows]
    frame = next(line_dedup.fingerprints([{"id": [None] * len(texts), "rid": range(len(texts)), "body": texts}], run))
    windows = sum(max(0, len((t or "").split("\n")) - run + 1) for t in texts)
    assert frame["starts"].map(len).sum() == windows and len(frame) < windows


@pytest.mark.parametrize("hot", [1 << 14, 8])
def test_near_copies_in_thousands(spark, monkeypatch, hot):
    """2,000 near copies of one text, each with its own change, in small blocks of hot signatures too."""
    monkeypatch.setattr(near_dup, "HOT_ROWS", hot)
    monkeypatch.setattr(near_dup, "VERY_FREQUENT", 40)
    n = 2000 if hot > 8 else 300
    base = [f"b{m}" for m in range(90)]
    rows = [(k, " ".join(x if j != k % 83 else f"w{k}" for j, x in enumerate(base))) for k in range(n)] + [(n, "another text of its own")]
    got = {r["doc_id"]: (r["component_id"], r["n_links"]) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [{tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for _, t in rows]
    for k in range(0, n, 97):
        links = sum(100 * len(sets[k] & s) >= 80 * len(sets[k] | s) for s in sets) - 1
        assert got[k] == (0, links)
    assert got[n] == (n, 0) and {c for k, (c, _) in got.items() if k < n} == {0}


def test_clashing_names(spark):
    """Columns that are named like an operator's own come back as they were."""
    names = ["doc_id", "text", "source", "lang", "n_chars", "_key", "_rid", "rid", "draws", "keep", "bad", "bins", "c0", "h1", "at", "entry", "comp"]
    rows = spark.createDataFrame([(k, PHRASE * (k + 1), "s", "en", 3, *range(100 * k, 100 * k + 12)) for k in range(4)], ", ".join(f"{n} {'string' if n in ('text', 'source', 'lang') else 'long'}" for n in names))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "not in there at all")], "item_id long, text string")
    whole = sorted(tuple(r) for r in rows.collect())
    for got in (keep_good(rows, labels), near_dup.keep_one_of_each(rows, percent=99), remove_contaminated(rows, bench), mix_sources(rows, cyclic_weights(1), share=1.0), assign_shards(rows).select(names)):
        assert got.columns == names and set(map(tuple, got.collect())) <= set(whole) and not got.isEmpty()


def test_field_finds_what_no_rule_does(spark):
    """Values without key words, put between the words of documents that the field wasn't trained on; clean text stays clean."""
    from granary.llm import secrets

    docs = spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/documents.parquet").orderBy("doc_id").collect()
    learn, other = docs[:600], docs[600:]
    model = secrets.train([r["text"] for r in learn], [0] * len(learn))
    none = np.zeros(len(other), np.int64)
    clean = secrets.scan(pa.array([r["text"] for r in other]), none, model)
    assert sum(kind == "crf" for spans in clean for kind, _, _ in spans) <= 2
    rng, texts, places = np.random.default_rng(5), [], []
    letters = "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz23456789"
    for r in other:
        gaps = [k for k, c in enumerate(r["text"]) if c in " \n"] or [0]
        k = gaps[int(rng.integers(len(gaps)))]
        value = "".join(letters[j] for j in rng.integers(0, len(letters), int(rng.integers(16, 36))))
        texts.append(f"{r['text'][:k]} {value} {r['text'][k:]}")
        places.append(("crf", k + 1, k + 1 + len(value)))
    found = secrets.scan(pa.array(texts), none, model)
    assert sum(place in spans for place, spans in zip(places, found, strict=True)) > 0.8 * len(texts)


def test_viterbi():
    """The best path against all paths."""
    import itertools

    from granary.llm import secrets

    rng = np.random.default_rng(1)
    for _ in range(30):
        e, moves = rng.normal(0, 2, (6, 3)), rng.normal(0, 1, (3, 3))
        best = max(itertools.product(range(3), repeat=6), key=lambda p: sum(e[t, k] for t, k in enumerate(p)) + sum(moves[a, b] for a, b in itertools.pairwise(p)))
        assert tuple(secrets.viterbi(e, np.zeros(6, np.int64), moves)) == best
