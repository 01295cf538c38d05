"""Named queries of the operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlens.llm import bm25, hybridrank, phrases, quality
from seqlens.llm.base import documents

QueryFn = Callable[[SparkSession, str], DataFrame]


def op1_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqlens.llm.sharding import kd_shards
    return kd_shards(documents(spark, sf_dir), ["lang", "source", "n_chars", "doc_id"], shards=16)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqlens.llm.quality import quality_rules
    return quality_rules(documents(spark, sf_dir))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqlens.llm.packing import pack
    return pack(documents(spark, sf_dir), with_ids=False)


def op4_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqlens.llm.pieces import nbest_segmentations
    return nbest_segmentations(documents(spark, sf_dir), n=4, with_ids=False)


def op5_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqlens.llm.paragraphs import remove_repeated_paragraphs
    return remove_repeated_paragraphs(documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id", F.col("_n_bytes").alias("n_bytes"), F.col("_n_removed").alias("n_removed"),
        F.col("_n_spans").alias("n_spans"), F.sha2("_kept", 256).alias("kept_sha256"),
        F.col("_n_repeated").alias("n_repeated"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqlens.llm.runindex import kept_text, remove_repeats
    out = remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select(
        "doc_id", F.coalesce(kept_text(out, "text"), F.lit("")).alias("text"), F.col("_n_bytes").alias("n_bytes"), F.col("_n_removed").alias("n_removed"),
        F.col("_n_spans").alias("n_spans"), F.sha2("_kept", 256).alias("kept_sha256"))


def op7_orc_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqlens.llm.orcids import ids_through_files
    return ids_through_files(documents(spark, sf_dir))


def op8_bm25_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqlens.llm.bm25 import bm25_top_k
    docs = documents(spark, sf_dir)
    found = bm25_top_k(docs, docs.where(F.col("doc_id") % 100 == 0), k=10)
    return found.withColumn("score", F.round("score", 4))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqlens.llm.toxicity import score_toxicity
    return score_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqlens.llm.neardup import near_duplicates
    return near_duplicates(documents(spark, sf_dir), words=4)


def op11_hybrid_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqlens.llm.hybridrank import rank_documents
    return rank_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqlens.llm.phrases import collocations
    return collocations(documents(spark, sf_dir))


def op13_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqlens.llm.prefixbpe import encode_decode
    return encode_decode(documents(spark, sf_dir))


QUERIES: dict[str, QueryFn] = {f.__name__: f for f in (
    op1_kd_shards, op2_quality_rules, op3_packing, op4_sentencepiece_nbest,
    op5_paragraph_dedup, op6_suffix_array_dedup, op7_orc_token_ids,
    op8_bm25_top_k, op9_toxicity, op10_minhash_neardup, op11_hybrid_rank, op12_phrases, op13_prefix_bpe)}
ORACLES: dict[str, str] = {"op2_quality_rules": quality.SQL, "op8_bm25_top_k": bm25.SQL,
                           "op11_hybrid_rank": hybridrank.SQL, "op12_phrases": phrases.SQL}


def queries() -> dict[str, QueryFn]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
