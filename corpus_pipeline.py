"""A corpus pipeline of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from arcweft.llm import stages
from arcweft.llm.common import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Bytes of an Arrow batch in this application's session, which Spark would let grow to 64 MB: executors of 3 GB hold
#: several at once, in Java and in Python workers.  A session that sets the value itself keeps it.
BATCH, BATCH_KEY, UNSET = "4m", "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def _bounded(stage: Stage) -> Stage:
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if spark.conf.get(BATCH_KEY) == UNSET:
            spark.conf.set(BATCH_KEY, BATCH)
        return stage(spark, docs, sf_dir)

    return run


STAGES: list[tuple[str, Stage]] = [
    ("language_id", _bounded(stages.language_id)),
    ("toxicity", _bounded(stages.toxic)),
    ("simhash_near_dedup", _bounded(stages.near_dedup)),
    ("source_mixing", _bounded(stages.mixing)),
    ("bpe", _bounded(stages.encoding)),
]

#: The stages include a trained classifier and a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after another over documents.  What a stage keeps is written once, in the shared checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
