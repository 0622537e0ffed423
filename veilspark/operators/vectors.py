"""Vectors: normalisation, exact nearest neighbours, metadata of hits, dense ids, an offline embedding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.sources.scratch import through_storage

#: Queries of a batch that are broadcast; more are taken in turns.
QUERIES = 1000


def l2_normalised(v: Column) -> Column:
    """Divided by the Euclidean norm; a zero vector stays."""
    squares = F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    # the norm stands beside each part, so that it is computed once and not for each of them
    return F.zip_with(v, F.array_repeat(F.sqrt(squares), F.size(v)), lambda x, n: F.when(n == 0, x.cast("double")).otherwise(x.cast("double") / n))


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def nearest(vectors: DataFrame, query: list[float], k: int = 5) -> DataFrame:
    """(vector_id, distance) of the k nearest by squared distance, ties by id; k below 1 counts as 1."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return vectors.select("vector_id", squared_l2(F.col("embedding"), q).alias("distance")).orderBy("distance", "vector_id").limit(max(1, int(k)))


def nearest_batch(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, vector_id, distance, rank) of the k nearest of each query.

    The stated queries meet all vectors in blocks of at most QUERIES, each small enough to send to every task; each task
    keeps its own k best before the shuffle.
    """
    k = max(1, int(k))
    numbered = queries.select("query_id", F.col("embedding").alias("query"))
    total = numbered.count()
    out = None
    for turn in range(max(1, -(-total // QUERIES))):
        part = numbered if total <= QUERIES else numbered.where(F.pmod(F.xxhash64("query_id"), F.lit(-(-total // QUERIES))) == turn)
        pairs = vectors.crossJoin(F.broadcast(part)).select("query_id", "vector_id", squared_l2(F.col("embedding"), F.col("query")).alias("distance"))
        w = Window.partitionBy("query_id").orderBy("distance", "vector_id")
        best = pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        out = best if out is None else out.union(best)
    return out


def with_metadata(hits: DataFrame, metadata: DataFrame) -> DataFrame:
    """Hits with chunk_text, source_path, document_id and chunk_index; empty and -1 where there is no metadata."""
    m = metadata.select("vector_id", "chunk_text", "source_path", "document_id", "chunk_index")
    filled = [F.coalesce(c, F.lit("")).alias(c) for c in ("chunk_text", "source_path", "document_id")]
    return hits.join(m, "vector_id", "left").select(*hits.columns, *filled, F.coalesce("chunk_index", F.lit(-1)).alias("chunk_index"))


def with_dense_ids(rows: DataFrame, order: list[str], previous: int = 0, name: str = "vector_id") -> DataFrame:
    """Rows numbered from ``previous`` in the given order without gathering them in one task.

    They are range-partitioned and sorted; a table of the partitions' sizes gives each partition its first number.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    held = through_storage(ranged.select("*", F.spark_partition_id().alias("_part"), (F.monotonically_increasing_id() % (1 << 33)).alias("_at")))
    sizes = held.groupBy("_part").agg(F.count("*").alias("_n"))
    first = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n") + previous).alias("_first"))
    # as many rows as partitions
    return held.join(F.broadcast(first), "_part").select((F.col("_first") + F.col("_at")).alias(name), *rows.columns)


def hashed_embedding(text: Column, dim: int = 64) -> Column:
    """A deterministic stand-in for an embedding model: counts of lower-case words by a hash of theirs, normalised."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    # a one-element array, so that the slots are computed once for all counts
    slots = F.array(F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int") % dim))
    counts = F.transform(slots, lambda s: F.array(*((F.size(s) - F.size(F.array_remove(s, i))).cast("double") for i in range(dim))))
    return l2_normalised(counts[0])
