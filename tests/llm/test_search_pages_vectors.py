"""Search, page text and whitening against plain versions, and on hand-made edge cases."""

import collections
import html
import math
import re

import numpy as np
import pytest
from conftest import DATA, against_sql

from granary.llm import html_extract, queries, search
from granary.llm.html_blocks import blocks_of
from granary.llm.html_extract import default_tree, extract_text, features, labelled_pages, main_texts
from granary.llm.search import ranked_search
from granary.llm.whitening import jacobi, whiten

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# Search


@pytest.mark.parametrize(("block", "segment", "asked"), [(3, 20_000, 4 << 20), (128, 100_000, 3000)])
def test_search_in_small_pieces(spark, monkeypatch, block, segment, asked):
    """Many blocks, segments, stretches and rounds of queries give what one of each gives."""
    for name, value in (("BLOCK", block), ("STRETCH", 16), ("SEGMENT_BYTES", segment), ("QUERY_BYTES", asked)):
        monkeypatch.setattr(search, name, value)
    against_sql(spark, queries.op12_block_max_search, queries.OP12_SQL)


def plain_search(docs, items, k):
    def terms(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))

    bags = [(i, collections.Counter(terms(t))) for i, t in docs]
    df = collections.Counter(t for _, bag in bags for t in bag)
    n_docs, total = sum(bool(bag) for _, bag in bags), sum(sum(bag.values()) for _, bag in bags)
    out = []
    for item, text in items:
        found = []
        for i, bag in bags:
            m = 75 + (25 * sum(bag.values()) * n_docs) // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 12 * m)) for t in terms(text) if t in bag)
            found += [(-score, i is None, i or 0, i)] if score > 0 else []
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [2, 128])
def test_search_odd_rows(spark, monkeypatch, block):
    """Nulls, ties, repeated rows and ids, one very long text, a term in all documents, clashing names."""
    monkeypatch.setattr(search, "BLOCK", block)
    long = " ".join(f"t{i % 50_000}" for i in range(300_000))
    docs = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (3, "b b c"), (None, "A b c"), (None, "z"), (9, long), (5, "a b"), (4, "b-a"), (7, "ümlaut Ümlaut B"), *((i, "b tie") for i in range(100, 160))]
    items = [(1, "a a b"), (2, None), (None, "c ümlaut"), (4, "t7 t49999 tie"), (1, "a a b"), (5, "nothing here")]
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, rank int, score int")
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, query int")
    got = sorted(map(tuple, ranked_search(frame, asked, k=20).collect()), key=repr)
    assert got == plain_search(docs, items, 20)
    assert ranked_search(frame.limit(0), asked).count() == ranked_search(frame, asked.limit(0)).count() == 0


def test_search_reads_few_blocks(spark):
    """Blocks that can't reach the threshold stay compressed."""
    rows = [(i, "common " * (1 + i % 3) + "filler " * 40) for i in range(20_000)] + [(30_000 + i, "common rare " * 20) for i in range(25)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    index, some, terms = search.build_index(frame)
    h, _ = search.hashed(search.pa.array(["common rare"]))
    h = h.view(np.int64)
    segment = search.Segment([r.asDict() for r in index.filter(index.term.isNull() | index.term.isin(h.tolist())).collect()])
    docs, scores = segment.search(h, np.array([10, 9000]), 20, 1)
    assert sorted(segment.ids[docs]) == list(range(30_000, 30_020)) and len(set(scores)) == 1
    assert segment.read.mean() < 0.1


# Pages


def test_pages_of_the_table(spark):
    """All of the table: the article of each page, by its tags."""
    want = {}
    for row in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        article = row["html"].split("<article>")[1].split("</article>")[0]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?p>|</?h1>", article))
        want[row["page_id"]] = (row["url"], "\n\n".join(x for x in parts if x))
    got = {r["page_id"]: (r["url"], r["text"]) for r in queries.op11_html_extraction(spark, DATA).filter("n_chars = length(text)").collect()}
    assert got == want


PAGE = """<!doctype html><HTML><head><title>Not <b>this</title><style>p{}</style><script>document.write("<p>no</p>")</script></head>
<body class="has-sidebar"><header id=top><a href=/>Site</a></header><nav><ul><li><a href="/1">One</a><li><a href="/2">Two</a></ul></nav>
<div class="cookie-banner">We use cookies. Accept them all.</div><main><article class=post><header><h1>A &amp; B&nbsp;&#8211; C &am x</h1></header>
<p>First   paragraph,<br>with <a href="/x">a link</a> and <b>bold</b>text.<p>Second
&lt;p&gt; one.<div class="ad-slot">Buy this now.</div><aside>Related things</aside><form><input><label>Mail</label></form><noscript>Turn it on</noscript>
<ul><li>Point one.</li><li>Two</li></ul><!-- <p>hidden</p> --><p style="display:none">x<blockquote>Said he.</blockquote><footer>Tags</footer></article>
<section id="comments"><article class="comment"><p>A reader says a lot of words that look just like a paragraph of the article itself.</p></article></section></main>
<div class=sidebar><p>A sidebar with a long teaser text that runs for many words.</p></div><footer>&copy; Us</footer><p"""


def test_page_by_hand():
    text = main_texts([PAGE, "", "just words", "<p>" * 3, "<article>cut <b>off &amp"], default_tree())
    assert text[0] == "A & B – C &am x\n\nFirst paragraph, with a link and boldtext.\n\nSecond <p> one.\n\nPoint one.\n\nTwo\n\nx\n\nSaid he."
    assert text[1] == text[3] == "" and text[4] == "cut off &"


def test_tree_on_pages_it_has_not_seen():
    found = [(blocks_of(page), main) for page, main in labelled_pages(seed=77)]
    keep = default_tree().predict(features([b for b, _ in found])) > 0.5
    truth = np.array([b.text in main for blocks, main in found for b in blocks])
    assert truth.sum() == sum(len(main) for _, main in found) and (keep != truth).mean() < 0.01


def test_pages_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(html_extract, "PAGE_BYTES", 1000)
    deep = "<div>" * 20_000 + "<article><p>" + "word " * 200_000 + "</p></article>" + "</div>" * 20_000
    rows = [(1, None, "u", 5), (2, "", None, 5), (None, PAGE, "u", 5), (2, "<nav>Menu</nav>", "u", 5), (2, "<nav>Menu</nav>", "u", 5), (6, deep, "v", 5)]
    frame = spark.createDataFrame(rows, "page_id long, html string, url string, text int")
    got = {(r["page_id"], r["url"], len(r["text"]), r["n_chars"]) for r in extract_text(frame).collect()}
    n = len(main_texts([PAGE], default_tree())[0])
    assert got == {(1, "u", 0, 0), (2, None, 0, 0), (None, "u", n, n), (2, "u", 0, 0), (6, "v", 999_999, 999_999)}
    assert extract_text(frame).count() == 6 and extract_text(frame.limit(0)).columns == ["page_id", "url", "text", "n_chars"]
    assert extract_text(frame.limit(0)).count() == 0


# Vectors


def test_whitening(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.floor(64 * np.array([r["embedding"] for r in rows], float)) + 1_000_000
    centred = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / len(x))
    values, vectors = values[::-1], vectors[:, ::-1]
    want = (centred @ vectors / np.sqrt(values))[:, :32]
    got = queries.op13_embedding_whitening(spark, DATA).orderBy("vec_id", "component").collect()
    own = np.array([r["whitened"] for r in got]).reshape(len(x), 32)
    assert np.abs(own * np.sign((own * want).sum(axis=0)) - want).max() < 1e-8
    assert np.abs(np.array([r["explained"] for r in got[:32]]) / (values[:32] / values.sum()) - 1).max() < 1e-9
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9
    n, sums = len(x), x.sum(axis=0).astype(int).tolist()
    want = [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    assert [r["deviation"] for r in got[::32]] == want and {r["n"] for r in got} == {n}


@pytest.mark.parametrize("size", [1, 2, 7, 40])
def test_jacobi(size):
    """Small eigenvalues come out to their own size, where eigh's are lost."""
    rng = np.random.default_rng(size)
    a = rng.normal(size=(size, size)) * 10.0 ** -np.arange(size).clip(max=12)
    values, vectors = jacobi(a.T @ a)
    assert np.allclose(vectors.T @ vectors, np.eye(size), atol=1e-12) and (np.diff(values) <= 0).all()
    assert np.allclose(np.sqrt(np.abs(values[: min(size, 7)])), np.linalg.svd(a, compute_uv=False)[: min(size, 7)], rtol=1e-8)


def test_whitening_odd_rows(spark):
    """Nulls, non-finite, ragged and huge entries go; a constant dimension and repeated rows stay."""
    good = [(1, [1.0, 2.0, 5.0]), (1, [1.0, 2.0, 5.0]), (None, [3.0, -1.0, 5.0]), (4, [0.5, 0.25, 5.0])]
    bad = [(5, None), (6, []), (7, [1.0, None, 2.0]), (8, [float("nan"), 1.0, 1.0]), (9, [float("-inf"), 1.0, 1.0]), (10, [1.0, 2.0]), (11, [1e300, 1.0, 1.0])]
    frame = spark.createDataFrame([(i, v, 3) for i, v in good + bad], "vec_id long, embedding array<double>, whitened int")
    got = whiten(frame).collect()
    assert sorted((r["id"] or 0, r["n"]) for r in got) == [(0, 4), (1, 4), (1, 4), (4, 4)]
    assert all(r["whitened"][2] == 0 and r["explained"][2] == 0 and r["identity_error"] < 1e-9 for r in got)
    assert np.allclose(np.cov(np.array([r["whitened"][:2] for r in got]).T, bias=True), np.eye(2))
    assert whiten(frame.limit(0)).count() == whiten(frame.filter("vec_id > 4 and vec_id < 10")).count() == 0
    (one,) = whiten(frame.filter("vec_id = 4")).collect()
    assert one["whitened"] == [0, 0, 0] and one["deviation"] == 0 and one["identity_error"] == 0


# Lines


@pytest.mark.parametrize("run", [3, 10, 50])
def test_line_fingerprints_are_few(run):
    """Fewer digests are written than there are windows: of each selected line one, and neighbours only of repeated ones."""
    from granary.llm import line_dedup

    rng = np.random.default_rng(run)
    block = [f"again {i}" for i in range(60)]
    texts = ["\n".join([*(f"own {x}" for x in rng.integers(0, 10**9, 150)), *block, *(f"own {x}" for x in rng.integers(0, 10**9, 150))]) for _ in range(20)]
    frame = {"id": [None] * len(texts), "rid": range(len(texts)), "body": texts}
    prints = next(line_dedup.selected([frame], run))
    windows = sum(len(t.split("\n")) - run + 1 for t in texts)
    assert len(prints) < windows * (0.75 if run == 3 else 0.35)
    counts = prints["print"].value_counts()
    keys = np.unique(line_dedup.keys_of([p for p, n in counts.items() if n > 1]))
    table = np.zeros(1 << 13, np.uint8)
    np.bitwise_or.at(table, (keys & 0xFFFF) >> 3, (1 << (keys & 7)).astype(np.uint8))
    found = next(line_dedup.fingerprints([frame], run, table))
    assert set(found["print"]) >= {p for p, n in counts.items() if n > 1} and 0 < len(found) < len(prints) / 2


# Decontamination


def test_contamination_in_blocks(spark, monkeypatch):
    """Items in one block or one a block: the same rows, ties in the longest match included."""
    from granary.llm import decontaminate

    words = " ".join(f"w{i}" for i in range(40))
    items = spark.createDataFrame([(3, words), (1, words), (2, " ".join(f"v{i}" for i in range(40))), (7, "w1 w2"), (None, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x {words} y " + " ".join(f"v{i}" for i in range(40))), (2, "nothing"), (3, None), (1, words)], "doc_id long, text string")
    one = sorted(map(str, decontaminate.find_contamination(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 1)
    assert sorted(map(str, decontaminate.find_contamination(docs, items).collect())) == one and "longest_item='1', longest_start=1" in "".join(one)


# Sharding


def test_sharding_of_hot_repeats(spark):
    """10,000 rows of one id and text beside others, and a smaller such group: limits, prefixes and hashes hold for all."""
    from pyspark.sql import functions as F

    from granary.llm.sharding import assign_shards

    text = "same text " * 10
    rows = [(1, text)] * 10_000 + [(2, "other " * 30)] * 300 + [(k, f"text {k} " * 9) for k in range(10, 900)] + [(None, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = assign_shards(docs, limit=2000).persist()
    assert out.count() == len(rows) and out.select("doc_id", "text").exceptAll(docs).isEmpty()
    sums = out.groupBy("shard", "shard_bits", "shard_prefix", "shard_bytes", "shard_rows").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("bytes"), F.count("*").alias("n")).collect()
    assert all(r["bytes"] == r["shard_bytes"] <= 2000 and r["n"] == r["shard_rows"] and len(r["shard_prefix"]) == r["shard_bits"] for r in sums)
    assert sorted(r["shard"] for r in sums) == list(range(len(sums))) and [r["shard_prefix"] for r in sorted(sums, key=lambda r: r["shard"])] == sorted(r["shard_prefix"] for r in sums)
    prefixes = {r["shard_prefix"]: r["shard_bytes"] for r in sums}
    for p, size in prefixes.items():  # only oversized buckets split: a bucket and its sibling together were over the limit
        sibling = p[:-1] + "10"[int(p[-1])]
        assert sum(v for q, v in prefixes.items() if q.startswith(p[:-1])) > 2000 or not any(q.startswith(sibling) for q in prefixes)
    hashed = out.filter("shard_bits <= 62").withColumn("h", F.lpad(F.conv(F.xxhash64(F.lit(11), "doc_id", "text").bitwiseAND(F.lit((1 << 62) - 1)).cast("string"), 10, 2), 62, "0"))
    assert hashed.filter(~F.col("h").startswith(F.col("shard_prefix"))).isEmpty() and hashed.count() > 800
    deep = out.filter("shard_bits > 62").groupBy("doc_id").agg(F.count_distinct(F.left("shard_prefix", F.lit(62))).alias("n"), F.count_distinct("shard").alias("shards"))
    assert {(r["doc_id"], r["n"]) for r in deep.collect()} == {(1, 1), (2, 1)} and deep.filter("shards > 20").count() == 2
    out.unpersist()
