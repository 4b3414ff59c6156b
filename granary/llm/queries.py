"""One query for each operator, over whole tables and with production parameters, and its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.decontaminate import find_contamination
from granary.llm.exact_dedup import assign_copies
from granary.llm.html_extract import extract_text
from granary.llm.line_dedup import repeated_lines
from granary.llm.lm_score import score_documents
from granary.llm.mixing import cyclic_weights, mix_plan
from granary.llm.near_dup import near_duplicates
from granary.llm.quality import score_quality, train_quality
from granary.llm.search import ranked_search
from granary.llm.secrets import KINDS, find_secrets
from granary.llm.sharding import assign_shards
from granary.llm.suffix_dedup import repeated_strings
from granary.llm.whitening import whiten


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(table(spark, sf_dir, "documents"), cyclic_weights(5, 2, 1), share=1.5)
    return plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), "source", F.transform("draws", lambda d: d["shard"]).alias("shards"))


def op2_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, train_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "text_bad", "meta_bad", "bad", "keep")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS]
    base = joined(F.filter("spans", lambda x: x["kind"] != "crf"))
    return found.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_copies(table(spark, sf_dir, "documents"))


def op5_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = assign_shards(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", "shard", "shard_bits", "shard_prefix", "shard_bytes", "shard_rows", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))


def op6_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents")).drop("rid")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "n_links")


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_strings(table(spark, sf_dir, "documents")).drop("rid")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op12_block_max_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20).toDF("item_id", "rank", "doc_id", "score")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whiten(table(spark, sf_dir, "embeddings"), components=32)
    parts = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "x")
    each = found.select(F.col("id").alias("vec_id"), "n", "deviation", "identity_error", parts)
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "x.whitened", "x.explained", "identity_error")


def queries() -> dict:
    return {f.__name__: f for f in (op1_source_mixing, op2_quality_cotraining, op3_secret_scan, op4_exact_dedup, op5_extendible_sharding, op6_attention_lm, op7_ngram_jaccard_join, op8_benchmark_decontamination, op9_suffix_array_dedup, op10_line_dedup, op11_html_extraction, op12_block_max_search, op13_embedding_whitening)}


SPACES = r"[\x20\x09-\x0D]+"

OP4_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{SPACES}', ' ', 'g') AS body FROM documents),
g AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM d JOIN g USING (body)
"""

OP10_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM documents WHERE text <> ''),
w AS (SELECT doc_id, pos, line, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS next FROM l),
r AS (SELECT doc_id, pos, next IS NOT NULL AND row_number() OVER (PARTITION BY line, next ORDER BY doc_id, pos) > 1 AS again FROM w),
k AS (
  SELECT doc_id, pos, line, coalesce(again OR lag(again) OVER (PARTITION BY doc_id ORDER BY pos), again) AS gone
  FROM r JOIN l USING (doc_id, pos))
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
         string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS kept
  FROM k GROUP BY doc_id) USING (doc_id)
"""

OP8_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM benchmark),
spots AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS t, least(len(w), 10) AS n FROM spots),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, sizes WHERE len(w) >= n),
found AS (SELECT p.doc_id, p.i, p.n, x.item_id FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS t FROM places) p JOIN windows x ON p.t = x.t AND p.n = x.n),
hits AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM found) GROUP BY doc_id),
lists AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hits USING (doc_id) LEFT JOIN lists USING (doc_id)
"""

OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM documents),
c AS (SELECT count(*) AS total_docs, sum(len(w))::BIGINT AS total FROM d WHERE len(w) > 0),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY doc_id, n, term),
f AS (SELECT term, floor(1000 * ln((2 * total_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM p, c GROUP BY term, total_docs),
q AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term
  FROM benchmark),
s AS (
  SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * total_docs) // total))))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN f USING (term), c GROUP BY item_id, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 20
"""


def oracle_sql() -> dict:
    return {"op12_block_max_search": OP12_SQL, "op8_benchmark_decontamination": OP8_SQL, "op4_exact_dedup": OP4_SQL, "op10_line_dedup": OP10_SQL}
