"""Queries of the training-data operators, with their SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, line_rules, lm, mixing, neardup, pii, shards, topk, toxicity, warc
from .common import documents, scratch


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """The public vocabulary file that the queries use."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every text; digests of both."""
    return bpe.digests(documents(spark, sf_dir), tokenizer_path())


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every text's ids to shards and read them back."""
    out = scratch(spark, "shards")
    shards.write(documents(spark, sf_dir), out, tokenizer_path(), end_id=2)
    return shards.scan(spark, out, "crc32")


def op3_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages, spoil some records of a replica, and locate them."""
    ours, theirs = scratch(spark, "warc-a"), scratch(spark, "warc-b")
    index = warc.write(documents(spark, sf_dir, "pages"), ours)
    warc.replicate(spark, ours, theirs, F.col("page_id") % 61 == 7)
    found = warc.audit(warc.tree(warc.digests(spark, ours)), warc.tree(warc.digests(spark, theirs)))
    return found.join(index.select("shard", "record", "page_id"), ["shard", "record"]).select("page_id", "kind")


def op4_lm_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every text with the model learnt from the documents not held out."""
    return lm.score(documents(spark, sf_dir))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of every text, learnt from ``labels``."""
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.train(docs, documents(spark, sf_dir, "labels")))


def op6_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slot of every document in the mixture of all sources."""
    return mixing.plan(documents(spark, sf_dir))


def op7_topk_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best inner products for every hundredth vector."""
    vectors = documents(spark, sf_dir, "embeddings")
    return topk.search(vectors, F.col("vec_id") % 100 == 0, scratch(spark, "topk"))


def op8_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text: base spans and those that patterns add."""
    return pii.report(documents(spark, sf_dir))


def op9_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every text; lines in many documents of a source are removed."""
    return line_rules.judge(documents(spark, sf_dir))


def op10_minhash_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all texts: three-word shingles, similarity 0.85."""
    return neardup.near_duplicates(documents(spark, sf_dir), width=3, percent=85)


_ALL = (
    op1_bpe_trie, op2_token_shards, op3_merkle_audit, op4_lm_automaton, op5_toxicity,
    op6_pfair_mix, op7_topk_blocks, op8_pii_bootstrap, op9_line_frequency, op10_minhash_postings,
)
QUERIES = {f.__name__: f for f in _ALL}

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLES = {
    "op10_minhash_postings": f"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, list_slice(w, i, i + 2) AS s FROM d, unnest(range(1, greatest(len(w) - 1, 2))) AS t(i) WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT w.y, r.c FROM reach r JOIN ways w ON w.x = r.doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY 1) USING (doc_id) LEFT JOIN sizes USING (doc_id)""",
    "op9_line_frequency": line_rules.ORACLE,
    "op3_merkle_audit": "SELECT page_id, 'changed' AS kind FROM pages WHERE page_id % 61 = 7",
    "op7_topk_blocks": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.e, d.e) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 100 = 0 AND d.vec_id <> q.vec_id AND len(q.e) = len(d.e)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 10""",
}
