"""The corpus operators' queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veilspark import ship
from veilspark.llm import decontaminate, embeddingdedup, jaccardjoin, langid, linededup, quality, sentencepiece, suffixdedup, toxicity, unitdedup
from veilspark.plans import retrieval


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # a small table is one file of one row group, which a single task would read
    return retrieval.spread(t) if name in ("documents", "embeddings") else t


def _over(f: Callable[..., DataFrame], *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(*(_table(spark, sf_dir, t) for t in tables))

    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": _over(decontaminate.contaminated_pairs, "documents", "benchmark"),
        "op2_quality": _over(quality.quality_report, "documents", "labels"),
        "op3_suffix_dedup": _over(suffixdedup.removal_report, "documents"),
        "op4_toxicity": _over(toxicity.toxicity_report, "documents", "labels"),
        "op5_sentencepiece": _over(sentencepiece.tokenized, "documents"),
        "op6_jaccard_join": _over(jaccardjoin.component_report, "documents"),
        "op7_unit_dedup": _over(unitdedup.unit_report, "documents"),
        "op8_embedding_dedup": _over(embeddingdedup.near_duplicate_report, "embeddings"),
        "op9_language": _over(langid.language_report, "documents"),
        "op10_line_dedup": _over(linededup.line_report, "documents"),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": decontaminate.ORACLE,
        "op7_unit_dedup": unitdedup.ORACLE,
        "op10_line_dedup": linededup.oracle(),
    }
