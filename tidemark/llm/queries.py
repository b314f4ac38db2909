"""The ten thin queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import langid, mixing, packing, quality, rpforest, secrets, simhash, tokenstore, transcripts, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op1_packing(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op2_mixing(_table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.op3_secrets(_table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.op4_language_id(_table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op5_quality(_table(spark, sf_dir, "documents"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op6_simhash(_table(spark, sf_dir, "documents"))


def op7_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenstore.op7_token_store(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rpforest.op8_embedding_dedup(_table(spark, sf_dir, "embeddings"))


def op9_chat_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.op9_chat_transcripts(_table(spark, sf_dir, "conversations"))


def op10_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.op10_warc(_table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_mixing": op2_mixing,
    "op3_secret_scan": op3_secret_scan,
    "op4_language_id": op4_language_id,
    "op5_quality_rules": op5_quality_rules,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_token_id_output": op7_token_id_output,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_chat_transcripts": op9_chat_transcripts,
    "op10_warc_normaliser": op10_warc_normaliser,
}

ORACLES: dict[str, str] = {"op2_mixing": mixing.OP2_SQL, "op3_secret_scan": secrets.OP3_SQL, "op5_quality_rules": quality.OP5_SQL}
