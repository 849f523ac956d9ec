"""Queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweft.llm import bpe, html_text, katz, language, mixing, simhash, token_counts, toxicity, vectors
from arcweft.llm.common import load, remainder


def tokenizer(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(load(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, remainder("doc_id", 5) != 0)
    return toxicity.score(docs, model).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest(load(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0, 10)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(load(spark, sf_dir, "documents").select("doc_id", "text"), remainder("doc_id", 7) == 2)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, tokenizer("byte_bpe_50k.json"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(load(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digest_documents(docs, tokenizer("word_bpe_49k.json"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(load(spark, sf_dir, "embeddings").select("vec_id", "embedding"), 0.9)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs, remainder("doc_id", 3) != 1)
    return language.predict(docs, model).select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


#: All pairs of vectors by cosine in double precision, and what each vector reaches.
NEAR_VECTORS = """
WITH RECURSIVE v AS (
  SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0
), l AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.9
), r(seed, node) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.seed, l.w FROM r JOIN l ON l.u = r.node)
, c AS (SELECT seed, min(node) AS component_id FROM r GROUP BY seed), k AS (SELECT u, count(*) AS n FROM l GROUP BY u)
SELECT seed AS vec_id, coalesce(n, 0) AS n_links, component_id, seed = component_id AS kept FROM c LEFT JOIN k ON k.u = c.seed
"""


def oracle_sql() -> dict[str, str]:
    """The others learn models, hash with XXH64 or call tokenizers, which SQL cannot; the graph search is approximate."""
    return {"op9_embedding_near_dedup": NEAR_VECTORS}
