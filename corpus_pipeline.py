"""A corpus pipeline: five stages, each over all that the one before kept, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilspark import ship
from veilspark.llm import decontaminate, jaccardjoin, linededup, sentencepiece, toxicity
from veilspark.llm.shared import discard, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the convolutional classifier scores at its threshold or above go."""
    ship(spark)
    # the classifier learns from the stage's own input, in which the labelled documents are
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of two lines or more, and single lines of passage length, that occur earlier are deleted; documents of nothing else go."""
    return linededup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 over five-word shingles the least doc_id stays."""
    ship(spark)
    return jaccardjoin.representatives(docs, n=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain four fifths of a benchmark item's five-word shingles go."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the verdicts of decoding and of parity."""
    ship(spark)
    return sentencepiece.tokenized(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode_pieces),
]

#: The classifier and the tokenizer can't be written in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; a stage's table is deleted once the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        after = written(stage(spark, docs, sf_dir))
        discard(docs)
        docs = after
    return docs
