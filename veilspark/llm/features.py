"""Hashed features of whole texts, computed for many texts at once, and samples of labelled rows for training."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.shared import mixed, powers, release_memory

#: Spaces before, between and after texts laid end to end; n-grams of up to GAP + 1 characters never join two texts.
GAP = 3


def laid(texts: list[str | None], lower: bool = False, most: int = 300_000) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of texts as code points: (number of the first text, codes, begins, lengths)."""
    group: list[str] = []
    first = size = 0
    for k, t in enumerate(texts):
        t = t or ""
        group.append(t.lower() if lower else t)
        size += len(group[-1])
        if size >= most or k == len(texts) - 1:
            gap = " " * GAP
            codes = np.frombuffer((gap + gap.join(group) + gap).encode("utf-32-le", "surrogatepass"), np.uint32)
            length = np.fromiter(map(len, group), np.int64, len(group))
            yield first, codes, np.cumsum(length + GAP) - length, length
            group, size, first = [], 0, k + 1


def gram_ids(codes: np.ndarray, n: int, bits: int) -> np.ndarray:
    """For each place but the last n - 1, the bucket of the n characters from it."""
    m = len(codes) - n + 1
    h = np.full(m, 0x9E3779B1 * n & 0xFFFFFFFF, np.uint32)
    for k in range(n):
        h ^= codes[k : k + m]
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    return h >> np.uint32(32 - bits)


_LETTERS: list[np.ndarray] = []


def alnum_table() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.array([chr(c).isalnum() for c in range(65536)]))
    return _LETTERS[0]


def runs(member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of True; the array begins and ends with False."""
    change = np.flatnonzero(member[1:] != member[:-1]) + 1
    return change[0::2], change[1::2]


def word_ids(codes: np.ndarray, bits: int, alnum: bool, head: int = 0) -> tuple[np.ndarray, ...]:
    """(begins, buckets) of the words: runs of letters and digits, or of anything but white space.

    With ``head`` also the buckets of the words' first ``head`` characters.
    """
    member = (alnum_table()[np.minimum(codes, 65535)] if alnum else ~((codes == 32) | ((codes >= 9) & (codes <= 13))))
    s, e = runs(member)
    p = np.zeros(len(codes) + 1, np.uint64)
    power, inv = powers(len(codes) + 1)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power[: len(codes)], out=p[1:])
    bucket = lambda e: (mixed((p[e] - p[s]) * inv[s]) >> np.uint64(64 - bits)).astype(np.int64)
    return (s, bucket(e), bucket(np.minimum(e, s + head))) if head else (s, bucket(e))


def remainder(by: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % by


def held_out(by: int, left: int) -> Column:
    return F.coalesce(remainder(by) == left, F.lit(False))


def sampled(docs: DataFrame, labels: DataFrame, target: str, by: int, left: int, per_class: int, extra: list[str] = []) -> tuple[DataFrame, float]:
    """About ``per_class`` training rows for each value of ``target``, and the share of 1 among all that may be drawn.

    Columns: doc_id, text, ``extra`` columns of documents, y. Only rows whose remainder is not ``left`` are drawn. The draw is by a hash of doc_id, at the rate that the class
    counts over all labels give. Repeated labels of a document count once (the greatest); nulls do not count.
    """
    y = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull()).groupBy("doc_id").agg(F.max(target).alias("y")).where(remainder(by) != left)
    counts = {r.y: r.n for r in y.groupBy("y").agg(F.count("*").alias("n")).collect()}
    rate = F.lit(0.0)
    for value, n in counts.items():
        rate = F.when(F.col("y") == value, min(1.0, per_class / n)).otherwise(rate)
    drawn = y.where(F.pmod(F.xxhash64("doc_id", F.lit("draw")), F.lit(1_000_000)) < rate * 1_000_000)
    # bounded by per_class rows a class, whatever the input: small enough to broadcast
    rows = docs.select("doc_id", "text", *extra).join(F.broadcast(drawn), "doc_id")
    return rows, counts.get(1, 0) / max(1, sum(counts.values()))


def ordered(rows: pd.DataFrame) -> pd.DataFrame:
    """The rows in the order of doc_id, one for each."""
    return rows.sort_values(["doc_id", "text"], kind="stable").drop_duplicates("doc_id").reset_index(drop=True)


def fitted(rows: DataFrame, fit: Callable[[pd.DataFrame], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """What ``fit`` makes of all rows of ``sampled``, in one task on an executor; only the arrays come to the driver.

    If the executor is lost, Spark repeats the task. No rows give no arrays.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if held := [b for b in batches if len(b)]:
            arrays = io.BytesIO()
            np.savez_compressed(arrays, **fit(ordered(pd.concat(held, ignore_index=True))))
            release_memory()
            yield pd.DataFrame({"arrays": [arrays.getvalue()]})

    found = rows.repartition(1).mapInPandas(run, "arrays binary").collect()
    return dict(np.load(io.BytesIO(found[0].arrays))) if found else {}


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))
