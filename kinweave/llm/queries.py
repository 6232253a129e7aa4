"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import tune
from . import (
    alignment, balance, chaining, divergence, langid, mixing_lm, packing, quality, secrets, simhash, tiling, trie_tokens,
    verified_bpe,
)

#: Where the public tokenizer files are; a parameter of the operators.
TOKENIZERS = "/opt/tokenizers"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_tokens.token_counts(_table(spark, sf_dir, "documents"), f"{TOKENIZERS}/piece_bpe_32k.model")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_report(_table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.mix_report(_table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.repeated_passages(_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_report(_table(spark, sf_dir, "documents"))


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_lm.score_texts(_table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_report(_table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_report(
        _table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"
    )


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified_bpe.round_trip_report(_table(spark, sf_dir, "documents"), f"{TOKENIZERS}/word_bpe_49k.json")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence_report(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {"op1_tokens": op1_tokens, "op2_secrets": op2_secrets, "op3_mixing": op3_mixing, "op4_quality": op4_quality, "op5_passages": op5_passages, "op6_packing": op6_packing, "op7_decontamination": op7_decontamination, "op8_langid": op8_langid, "op9_lm": op9_lm, "op10_simhash": op10_simhash, "op11_alignment": op11_alignment, "op12_bpe": op12_bpe, "op13_divergence": op13_divergence}


def oracle_sql() -> dict[str, str]:
    return {"op13_divergence": divergence.SQL}
