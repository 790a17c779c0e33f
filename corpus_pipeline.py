"""Corpus pipeline over ``documents``.

STAGES lists (name, function) in order; each function takes (spark, docs, sf_dir)
and returns a DataFrame, which is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of ``documents``:

quality    drops documents that the co-trained classifier rejects
toxicity   drops documents that the compression-distance classifier rejects
dedup      keeps one document of each near-duplicate group
mix        repeats or leaves out documents so that sources meet their targets,
           in training order (range-sorted by position)
encode     adds ``ids``, the pieces of the text

Both classifiers learn from the labelled rows of the whole ``documents`` table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pricewise.llm import near_dedup, piece_codec, quality, source_mix, toxicity
from pricewise.llm.common import read_table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(spark, docs, sf_dir)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(spark, docs, sf_dir)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(spark, docs, sf_dir)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mix.mixture(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_codec.with_ids(docs, piece_codec.default_model())


STAGES = [("quality", quality_stage), ("toxicity", toxicity_stage), ("dedup", dedup_stage),
          ("mix", mix_stage), ("encode", encode_stage)]

# Trained models cannot be written in SQL; tests/llm/test_pipeline.py compares the
# stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else written(docs), sf_dir)
    return docs


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)
