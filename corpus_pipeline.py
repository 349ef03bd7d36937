"""Corpus preparation: one stage after the other over ``documents``, each written as Parquet and read again.

All stages but the last return the columns of ``documents``. Rows with one doc_id are judged as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import catalog, linededup, mixing, packing, quality, simhash
from ledgerlens.session import materialize

#: The list is learned, rows are counted and texts are tokenised with Python: SQL can't express the stages.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned list reject go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.judged(docs, labels, prefix="__").where("__kept").select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that at least three documents share go, except in the document with the largest id; every document stays."""
    kept = linededup.drop_shared_lines(docs, whole_row=True)
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return kept.select(*[(new[c] if c in new else F.col("row")[c]).alias(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest doc_id."""
    return simhash.keep_one(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources are repeated up to twice, as the temperature says; every document stays at least once."""
    return mixing.mixed_rows(docs, mixing.Mix(repeat_limit=2.0))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as pieces of sequences of at most 2,048 tokens."""
    return packing.pack(docs, catalog.vocabulary("byte_bpe_50k.json"), 2048, 0)


STAGES = [
    ("quality rules", quality_rules), ("line dedup", line_dedup), ("SimHash near-dedup", near_copies), ("source mixing", source_mixing),
    ("best-fit packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
