"""A corpus pipeline of five stages, each one of the operators of stratum.llm.

A stage takes (spark, docs, sf_dir) and returns what it keeps; `run` writes each stage's result to the shared
folder, reads it back as the next one's documents, and removes what the stage and the one before it left there.

Defined results: null and empty texts have the labels' prior as their score, are one text to exact dedup, link with no
near-duplicate, cover no benchmark item and encode to nothing. Of equal texts the largest id stays, of a group of
near-duplicates the smallest, a null id losing to any other; of rows equal in id and text one stays. Without
labels of both kinds, or without benchmark items, nothing goes for that reason. An empty table stays empty. All but the last
stage carry every column of `docs`, whatever its name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratum.llm.common import delete, scratch, scratch_path, table
from stratum.llm.decontamination import drop_contaminated
from stratum.llm.exact_dedup import drop_exact_duplicates
from stratum.llm.near_dedup import drop_near_duplicates
from stratum.llm.pieces import encode_texts
from stratum.llm.quality import keep_quality
from stratum.llm.queries import tokenizer_file


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts. It learns from the labelled ones among `docs`."""
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that with the largest id."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id."""
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"), short_items=True)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and scores of the N best segmentations of every document."""
    return encode_texts(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("encode", encode)]

#: Trained scores and A* segmentations are beyond SQL; the tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        with scratch(spark):
            kept = stage(spark, docs, sf_dir)
            kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
        if before:
            delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
