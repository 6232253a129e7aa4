"""From raw documents to packed token rows: five stages, each a table read by the next.

Every stage takes (spark, docs, sf_dir), works on all rows it is given and keeps the columns of documents,
but for the last one, which returns packed rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinweave.llm import balance, langid, packing, simhash, tiling
from kinweave.llm.queries import TOKENIZERS
from kinweave.session import materialize, tune


def accepted_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; learned from the documents' own labels."""
    tune(spark)
    return langid.accepted(docs)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked SimHash fingerprints, the document of the smallest id."""
    tune(spark)
    return simhash.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no item of the benchmark."""
    return tiling.without_benchmark(docs, tune(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    tune(spark)
    return balance.mixed(docs)


def packed_rows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed rows of token ids."""
    tune(spark)
    return packing.pack(docs, f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


STAGES = [
    ("language_id", accepted_language),
    ("near_duplicates", one_of_near_duplicates),
    ("decontamination", without_benchmark),
    ("source_mixing", mixed_sources),
    ("packing", packed_rows),
]

#: Learned weights, tilts and byte-pair merges are not SQL; tests/llm/test_pipeline.py compares by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each but the last is written and read again."""
    docs = tune(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
