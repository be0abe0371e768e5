"""Corpus pipeline: quality, near-duplicates, repeated passages, mixing, packing. Each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import mixing, neardup, packing, quality, suffixes
from ledgerloom.llm.base import cut
from ledgerloom.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the counts and are no outlier of their language and source."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least id of every component at five words and a similarity of 0.8."""
    return neardup.one_of_each(docs, size=5, per_cent=80)


def suffix_array(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, without the words under 50-word windows that start twice, every occurrence: bytes of 400 miss short passages and such as are spaced differently."""
    return suffixes.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once and those of small sources up to 1.25 times."""
    return mixing.mix(docs, repetition=1.25).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens."""
    return packing.pack(docs, vocabulary())


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("suffix_array", suffix_array), ("mix_sources", mix_sources), ("pack", pack)]

#: SQL can express no stage but mixing. tests/llm/test_pipeline.py holds run() and its stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
