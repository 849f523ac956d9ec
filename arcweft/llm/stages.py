"""Pipeline stages: each takes the documents that its predecessor kept and applies one operator's decisions.

A stage returns all columns that it was given, whatever their names; the last returns token ids instead of the text.

Defined cases: an empty table gives no rows.  A null text is in no language and goes at the first stage.  Null and
shared ids lose nothing: rows are told apart by id and text, and equal rows share a decision (near copies: one stays).
A null source is a source of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweft.llm import bpe, language, mixing as mix, simhash, toxicity
from arcweft.llm.common import free, load, remainder, spread
from arcweft.llm.queries import tokenizer

#: Documents below this cosine are of no known language.
LEAST_COSINE = 0.05


def _held(docs: DataFrame) -> DataFrame:
    """(document, text): the other columns in one, where no operator's names can clash with them."""
    return docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("document"), "text")


def _restored(held: DataFrame, columns: list[str]) -> DataFrame:
    return held.select(*["text" if c == "text" else F.col("document").getField(c).alias(c) for c in columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or near no language's prototype, go; where none could be learnt, those without letters."""
    model = language.fit(docs, remainder("doc_id", 3) != 1)
    if not model:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = language.predict(_held(docs), model, keep_text=True)
    return _restored(found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_COSINE)), docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go."""
    model = toxicity.fit(docs, load(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    found = toxicity.score(_held(docs), model, keep_text=True)
    return _restored(found.where("predicted = 0"), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of least id stays, whatever ids other groups have."""
    return simhash.deduplicate(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document comes as often as the mix takes its words.

    The whole number of times, and once more with the probability of the rest, by a repeatable draw from the
    id and text, by which rows are told apart; equal rows share what the mix takes of them.
    """
    row, times, nth = (free(docs, x) for x in ("hash_of_row", "times_of_row", "nth_of_row"))
    docs_by_row = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    taken = mix.mix_documents(docs_by_row, id_column=row).groupBy(F.col("doc_id").alias(row)).agg((F.sum("taken") / F.greatest(F.sum("size"), F.lit(1))).alias(times))
    taken = taken.select(row, F.floor(F.col(times) + spread(row, seed=11)).cast("int").alias(times)).where(F.col(times) > 0)
    return docs_by_row.join(taken, row).select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(times))).alias(nth)).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as token ids, with their number and the digest of what they decode to."""
    return bpe.token_documents(docs, tokenizer("word_bpe_49k.json"))
