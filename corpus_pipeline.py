"""A training-corpus pipeline: toxicity, quality rules, near-dedup, repeated strings, packing.

``STAGES`` are (name, function) pairs; a function takes ``(spark, docs,
sf_dir)``, where ``docs`` is what the stage before kept, and all but the last
return the columns of ``documents``.  ``run`` writes each stage's result as
Parquet to the shared checkpoint folder and reads it again, so a lost executor
costs one stage at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlens.llm.base import small_batches
from seqlens.llm.neardup import drop_near_duplicates
from seqlens.llm.packing import pack
from seqlens.llm.quality import keep_quality
from seqlens.llm.runindex import drop_repeats
from seqlens.llm.toxicity import drop_toxic
from seqlens.session import ensure_checkpoint_dir


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.7 or more go."""
    small_batches(spark)
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule or whose host is rejected go."""
    small_batches(spark)
    return keep_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five-word shingles, similarity 0.8)."""
    small_batches(spark)
    return drop_near_duplicates(docs)


#: fifty words of a language that is written with short ones
REPEAT_BYTES = 200


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of ``REPEAT_BYTES`` bytes are cut out but in their first place; ``n_chars`` follows the text."""
    small_batches(spark)
    out = drop_repeats(docs, length=REPEAT_BYTES, keep_first=True)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens, with their token ids."""
    small_batches(spark)
    return pack(docs)


STAGES = [("toxicity", toxicity), ("quality_rules", quality_rules), ("near_dedup", near_dedup),
          ("repeated_strings", repeated_strings), ("packing", packing)]

#: a trained classifier and a tokenizer can't be written in SQL; tests/llm/test_pipeline.py checks run() instead
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
