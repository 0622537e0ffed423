"""Chunk metadata as lines of JSON, in one folder for each batch of chunks taken in."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.sources.scratch import exists, names

FIELDS = "vector_id bigint, document_id string, source_path string, chunk_index int, chunk_text string"


def parsed(lines: DataFrame, line: str = "value", order: str = "line_no") -> DataFrame:
    """A row for each vector_id, from its last line. Blank and malformed lines, and lines without an id, are left out."""
    v = F.try_parse_json(F.trim(F.col(line)))
    get = lambda name, kind: F.try_variant_get(v, f"$.{name}", kind)
    rows = lines.select(
        F.col(order).alias("_order"), get("vector_id", "bigint").alias("vector_id"), get("document_id", "string").alias("document_id"),
        get("source_path", "string").alias("source_path"), get("chunk_index", "int").alias("chunk_index"), get("chunk_text", "string").alias("chunk_text"),
    ).where("vector_id is not null")
    # the last line by an aggregate that combines before the shuffle, not by a window over all lines of an id
    last = rows.groupBy("vector_id").agg(F.max_by(F.struct("document_id", "source_path", "chunk_index", "chunk_text"), "_order").alias("m"))
    return last.select("vector_id", "m.*")


def batch_folder(path: str, batch: int) -> str:
    """Batches sort by name as they do by number."""
    return f"{path}/batch={batch:020d}"


def batches(spark, path: str) -> list[int]:
    """The numbers of the batches that are complete, in order: one folder for each ingest, whatever its size."""
    found = sorted(int(m[1]) for n in names(spark, path) if (m := re.fullmatch(r"batch=(\d+)", n)))
    return [b for b in found if exists(spark, f"{batch_folder(path, b)}/_SUCCESS")]


def read(spark, path: str) -> DataFrame:
    """Metadata of a file or folder of JSON lines. Of two lines of an id the later counts: that of the later batch, or else
    by file name and by place in the file (the split's begin, and the line's number within the split)."""
    folders = [batch_folder(path, b) for b in batches(spark, path)]
    batch = F.coalesce(F.regexp_extract("_metadata.file_path", r"/batch=(\d+)/[^/]*$", 1), F.lit(""))
    order = F.struct(batch, "_metadata.file_name", "_metadata.file_block_start", F.monotonically_increasing_id())
    return parsed(spark.read.text(folders or path).select("value", order.alias("line_no")))


def append(rows: DataFrame, path: str, batch: int) -> None:
    """Writes a batch; one that is written again, as after a failure, replaces its own."""
    rows.select("vector_id", "document_id", "source_path", "chunk_index", "chunk_text").write.mode("overwrite").json(batch_folder(path, batch))
