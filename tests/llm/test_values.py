"""Values that operators give for odd rows, texts longer than a segment, and labels that no model has seen."""

import pytest
from conftest import DATA
from test_operators import ODD, PHRASE, documents, odd, plain_strip

from granary.llm import suffix_dedup
from granary.llm.decontaminate import find_contamination
from granary.llm.lm_score import score_documents
from granary.llm.quality import score_quality, train_quality
from granary.llm.secrets import find_secrets
from granary.llm.sharding import assign_shards


@pytest.mark.parametrize("segment", [900, 2500])
def test_strings_of_texts_longer_than_a_segment(spark, monkeypatch, segment):
    """Texts in many overlapping segments, a repeat over the edge of one, against brute force."""
    monkeypatch.setattr(suffix_dedup, "SEGMENT", segment)
    rows = documents(spark).select("doc_id", "text").filter("doc_id < 60 and length(text) < 5000")
    body = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(6000))
    rows = rows.unionByName(spark.createDataFrame([(9001, body), (9002, "x" * 777 + body[2000:3100] + "y" * 10), (9003, "z" * 1500)], "doc_id long, text string"))
    got = sorted((tuple(r) for r in suffix_dedup.repeated_strings(rows).drop("rid").collect()), key=repr)
    assert got == plain_strip([tuple(r) for r in rows.collect()], 400)


def test_contamination_of_odd_rows(spark):
    bench = spark.createDataFrame([(1, PHRASE), (2, None), (3, "short text"), (None, "ümlaut")], "item_id long, text string")
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["n_hit"], r["items"]) for r in find_contamination(odd(spark), bench).collect()))
    words = len(PHRASE.split()) * 400
    assert got == sorted([
        (False, 1, 0, 0, []), (False, 2, 0, 0, []), (False, 3, 0, 0, []), (False, 4, words, words, ["1"]), (False, 5, words, words, ["1"]), (False, 5, 2, 2, ["3"]),
        (False, 6, 2, 2, ["3"]), (False, 7, 90, 90, [""]), (True, 0, 2, 0, []),
    ])


def test_shards_of_odd_rows(spark):
    """Every row keeps its own columns, whatever their names; repeated rows are rows of their own."""
    rows = odd(spark).unionByName(odd(spark))
    got = assign_shards(rows, limit=30_000).collect()
    plain = [(i, t, lang, source, n, keep, name) for i, t, lang, source, n, _, keep, name in ODD]
    assert sorted(((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], r["keep"], r["id"]) for r in got), key=repr) == sorted(plain + plain, key=repr)
    size = {}
    for r in got:
        size[r["shard"]] = size.get(r["shard"], 0) + len((r["text"] or "").encode())
    assert all(size[r["shard"]] == r["shard_bytes"] <= 30_000 for r in got) and len(size) >= 4


def test_scores_of_odd_rows(spark):
    """Null and empty texts are their end alone; equal texts get one score, longer ones a lower one."""
    got = {}
    for r in score_documents(odd(spark)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert got[1][0]["n_tokens"] == got[2][0]["n_tokens"] == got[3][0]["n_tokens"] == 1
    assert abs(got[1][0]["score"] - got[2][0]["score"]) < 1e-9 and got[1][0]["score"] < 0
    long = [r for r in got[4] + got[5] if r["n_tokens"] > 100]
    assert len(long) == 2 and abs(long[0]["score"] - long[1]["score"]) < 1e-6 * abs(long[0]["score"]) and long[0]["score"] < got[1][0]["score"]


def test_secrets_of_odd_rows(spark):
    """Repeated and very long texts, names that clash: spans lie in the text and don't depend on the row's other columns."""
    text = "filler words " * 20_000 + "api_key = 'abcDEF123456/+=' end " + "more " * 10_000
    rows = spark.createDataFrame([(1, text, "a"), (1, text, "b"), (2, None, "c"), (3, "token: short", None)], "doc_id long, text string, spans string")
    got = [(r["doc_id"], [(s["kind"], text[s["start"] : s["end"]]) for s in r["spans"] if s["kind"] != "crf"]) for r in find_secrets(rows).collect()]
    assert sorted(got) == [(1, [("assign", "api_key = 'abcDEF123456/+=")])] * 2 + [(2, []), (3, [])]


def test_quality_of_labels_it_has_not_seen(spark):
    """Half of the labels teach, the others judge; pages that repeat get one score."""
    folder = DATA.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = train_quality(docs, labels.filter("doc_id % 2 = 0"))
    scored = score_quality(docs, model).join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    good = [r for r in scored if r["quality"] == 1 and r["toxic"] == 0]
    assert sum(r["keep"] for r in good) > 0.85 * len(good) and len(scored) > 150
    assert sum(r["keep"] == (r["quality"] == 1 and r["toxic"] == 0) for r in scored) > 0.8 * len(scored)
    bad = [r["bad"] for r in scored if r["toxic"] == 1]
    assert sum(bad) / len(bad) > 2 * sum(r["bad"] for r in good) / len(good)
