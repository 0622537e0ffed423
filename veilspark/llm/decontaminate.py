"""Benchmark decontamination by size-partitioned MinHash containment search. DataFrame functions only.

An item of the benchmark is contained in a document when at least ``threshold`` of the item's distinct word shingles
occur among the document's. A MinHash over the whole of a long document says nothing about an item of thirty words, so
the search keeps the MinHash sample on the small side: each item is represented by the k smallest of its shingle hashes
(its bottom-k sketch), and the share of that sample found in a document estimates the containment. Items are
partitioned by their number of shingles; each partition has its own k and its own number of hits that make a
candidate, so that small items are sampled whole and large ones thinly, at the same recall. Candidates are then
verified by exact containment of shingle strings.

The sample is drawn without replacement, so hits in a document that contains the item at c >= 0.8 are hypergeometric;
with k = 24 and 8 hits needed the chance of missing one is below 1e-6 at c = 0.8 and falls fast above it; an item of
at most k shingles has its whole set as sample and is never missed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.shared import written

#: (most shingles in the partition, sketch size k, hits needed); ``None``: no limit. The needed share is a third of the
#: sketch or a half of a small one, well under the 0.8 that is verified.
PARTITIONS = ((8, 8, 4), (24, 24, 8), (64, 24, 8), (256, 32, 10), (None, 48, 16))
#: A sketch table of up to so many rows is broadcast; beyond it the join is left to Spark's own size checks.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(w: Column, n: int) -> Column:
    """Distinct n-word shingles; with fewer words the whole sequence is the only one; none without words."""
    return F.when(
        F.size(w) >= n,
        F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.array_join(F.slice(w, i + 1, n), " "))),
    ).otherwise(F.when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>")))


def shingle_hashes(w: Column, n: int) -> Column:
    """Hashes of the n-word shingles, with repeats, from the hashes of the words; ``w`` must be a column, not a formula."""
    return F.when(
        F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(n))))
    ).otherwise(F.when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>")))


def item_sketches(items: DataFrame, n: int) -> DataFrame:
    """(item_id, n_item, needed, sample): the bottom-k sketch of each item under its size partition's k."""
    split = items.where("item_id is not null").select("item_id", F.transform(words(F.col("text")), lambda x: F.xxhash64(x)).alias("w"))
    sets = split.select("item_id", F.array_sort(F.array_distinct(shingle_hashes(F.col("w"), n))).alias("hashes")).where("size(hashes) > 0")
    size = F.size("hashes")
    k, need = F.lit(PARTITIONS[-1][1]), F.lit(PARTITIONS[-1][2])
    for most, kk, hits in reversed(PARTITIONS[:-1]):
        k, need = F.when(size <= most, kk).otherwise(k), F.when(size <= most, hits).otherwise(need)
    return sets.select(
        "item_id",
        size.alias("n_item"),
        # a sketch of fewer hashes than needed hits (items of few shingles) asks for half of them
        F.least(need, F.ceil(size / 2).cast("int")).alias("needed"),
        F.slice("hashes", F.lit(1), k).alias("sample"),
    )


def contaminated_pairs(docs: DataFrame, items: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row (doc_id, item_id, n_item, n_shared) for each item contained in a document.

    Needs ``doc_id, text`` and ``item_id, text``; further columns are ignored, whatever their names. Rows with a null id
    are left out; null and empty texts hold nothing. Repeated rows give one pair, as do rows that share an id (their
    shingles are pooled). A text of one to n-1 words counts as a single shingle, which only an equally short text shares.
    """
    d = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    sketches = item_sketches(items, n)
    sample = sketches.select("item_id", "needed", F.explode("sample").alias("h"))
    if sample.count() <= BROADCAST_ROWS:
        sample = F.broadcast(sample)
    # the words' hashes stand in a column of their own, so that the lambda below reads them and does not split again
    split = d.select("doc_id", F.transform(words(F.col("text")), lambda x: F.xxhash64(x)).alias("w"))
    hits = split.select("doc_id", F.explode(shingle_hashes(F.col("w"), n)).alias("h")).join(sample, "h")
    # distinct hits per document and item: first per hash (a hot shingle repeats within a document), then counted
    candidates = (
        hits.groupBy("doc_id", "item_id", "h").agg(F.max("needed").alias("needed"))
        .groupBy("doc_id", "item_id").agg(F.count("*").alias("hits"), F.max("needed").alias("needed"))
        .where("hits >= needed").select("doc_id", "item_id")
    )
    candidates = written(candidates)
    few = d.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", words(F.col("text")).alias("w")).select("doc_id", F.explode(shingles(F.col("w"), n)).alias("s"))
    exact = items.where("item_id is not null").select("item_id", words(F.col("text")).alias("w")).select("item_id", F.explode(shingles(F.col("w"), n)).alias("s")).distinct()
    wanted = candidates.join(exact, "item_id")
    shared = few.distinct().join(wanted, ["doc_id", "s"]).groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared"))
    sizes = exact.groupBy("item_id").agg(F.count("*").alias("n_item"))
    return shared.join(sizes, "item_id").where(F.col("n_shared") >= F.lit(threshold) * F.col("n_item")).select("doc_id", "item_id", "n_item", "n_shared")


def decontaminated(docs: DataFrame, items: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """``docs`` without the documents that contain an item; all columns kept, rows with a null doc_id kept."""
    bad = contaminated_pairs(docs, items, n, threshold).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)


ORACLE = r"""
WITH dw AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
iw AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL),
ds AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM dw),
bs AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM iw),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n_item, n_shared FROM m JOIN n USING (item_id) WHERE n_shared >= 0.8 * n_item
"""
