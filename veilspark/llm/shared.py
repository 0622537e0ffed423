"""What the corpus operators share: scratch tables in the cluster's shared folder, connected components, byte hashing."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FALLBACK: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Only local mode, as in tests, does without: there one temporary folder serves."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if "dir" not in _FALLBACK:
        _FALLBACK["dir"] = tempfile.mkdtemp(prefix="veilspark-")
    return _FALLBACK["dir"]


def _located(spark: SparkSession, path: str):
    """(file system, path) as Hadoop has them."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def written(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts the lineage and survives lost executors.

    discard() deletes the table as soon as nothing reads it any more; what a result still reads goes when the
    application ends, a failed one included.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    fs, jpath = _located(spark, path)
    fs.deleteOnExit(jpath)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes what written() made, once nothing reads it any more."""
    for df in frames:
        path = getattr(df, "_scratch_path", None)
        if path:
            fs, jpath = _located(df.sparkSession, path)
            fs.delete(jpath, True)


#: Rows (lean ones) that a single task may well be given.
LIGHT = 200_000


def with_first(rows: DataFrame, count: int, keys: list[str], heavy: int = 1000) -> DataFrame:
    """``rows`` (a written table, or of few rows; ``count`` of them) that share their ``keys`` with another row, with ``first``
    (the least place of these rows, a place being a struct of the first three columns) and ``later`` (whether the row has another).

    The aggregate combines before its shuffle. A group of more than 1/heavy of all its rows would land in one task of the
    join back, so such groups, at most ``heavy`` whatever the input, are broadcast instead; their rows stay put. Fewer than
    LIGHT rows are joined without asking.
    """
    place = F.struct(*rows.columns[:3])
    groups = rows.groupBy(*keys).agg(F.min(place).alias("first"), F.count("*").alias("__n")).where("__n > 1")
    if count < LIGHT:
        out = rows.join(groups, keys)
    else:
        groups = written(groups)
        total = groups.agg(F.sum("__n")).first()[0] or 0
        hot = F.broadcast(groups.where(F.col("__n") * heavy > total))
        others = rows.join(hot.select(*keys), keys, "left_anti").join(groups.where(F.col("__n") * heavy <= total), keys)
        out = rows.join(hot, keys).unionByName(others)
    return out.drop("__n").withColumn("later", place != F.col("first"))


#: Most runs in a table of cuts that is sent to every task, some 12 MB.
FEW_CUTS = 500_000


def with_cuts(docs: DataFrame, cuts: DataFrame, on: list[str]) -> DataFrame:
    """``docs`` with their ``cut`` (runs to remove), null where there is none.

    ``cuts`` is a written table, and counted: few are broadcast, so that the texts stay where they are; else both sides are
    shuffled, and the cuts, a small share of the texts, are the hashed side.
    """
    runs = cuts.agg(F.sum(F.size("cut") + 2)).first()[0] or 0
    return docs.join(F.broadcast(cuts) if runs <= FEW_CUTS else cuts.hint("shuffle_hash"), on, "left")


#: Most rows of an Arrow batch: texts differ in length by four orders of magnitude.
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows per Arrow batch. All operators share one bound and only ever tighten it, so their order doesn't matter."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    have = int(spark.conf.get(name))
    if have <= 0 or have > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def release_memory() -> None:
    """Gives memory that training or collecting has freed back to the system; the driver's share is small."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def components(edges: DataFrame, a: str = "a", b: str = "b", limit: int = 60) -> DataFrame:
    """Connected components of the links ``(a, b)`` by alternating large-star and small-star steps.

    Returns (node, root) for each node that has a link, root being the least node of its component. Every step is an
    aggregate with map-side combining and an equi-join whose large side may be split, so a hub with a third of all
    links is not gathered in one task. Each step's table is written to the shared folder; the driver sees only counts.
    """
    links = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    seen = None
    for _ in range(limit):
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(down, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        after = written(small)
        now = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(links)
        links = after
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    # settled: every link points from a node to the least node of its component
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(links.select(F.col("v"), F.col("v")).distinct())


# ---------------------------------------------------------------------------------------------------------------
# Byte hashing. Prefix sums of byte * base**position, modulo 2**64, give the hash of any substring by one
# subtraction and one multiplication with the inverse power.

MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("n", None)
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        for key, base in (("n", BASE), ("i", BASE_INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            _POWERS[key] = p
    return _POWERS["n"][:n], _POWERS["i"][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix hashes P with P[0] = 0; hash of data[i:j] is (P[j] - P[i]) * base**-i."""
    p, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=out[1:])
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit words."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


#: Space, and tab to carriage return.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[ord("A") : ord("Z") + 1] += 32


def word_shingles(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the n-word shingles of each text.

    A to Z are lowered; words are runs of bytes other than space and tab to carriage return. A text with 1 to n-1 words
    has its whole word sequence as its only shingle; one without words has none.
    """
    out: list[np.ndarray] = []
    group: list[bytes] = []
    size = 0
    for t in texts:
        raw = (t or "").encode("utf-8", "surrogatepass")
        group.append(raw)
        size += len(raw) + 1
        if size > 4_000_000:
            out += _shingled(group, n)
            group, size = [], 0
    return out + (_shingled(group, n) if group else [])


def _shingled(raws: list[bytes], n: int) -> list[np.ndarray]:
    data = LOWERED[np.frombuffer(b" " + b" ".join(raws) + b" ", np.uint8)]
    space = IS_SPACE[data]
    change = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = change[0::2], change[1::2]
    p = prefix_hash(data)
    _, inv = powers(len(data) + 1)
    words = mixed(((p[ends] - p[starts]) * inv[starts]) ^ (ends - starts).astype(np.uint64))
    lengths = np.fromiter(map(len, raws), np.int64, len(raws))
    begin = np.concatenate(([0], np.cumsum(lengths + 1)[:-1])) + 1
    first = np.searchsorted(starts, begin)
    last = np.append(first[1:], len(starts))
    out = []
    full = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        full = (full + mixed(words[k : len(words) - n + 1 + k] + np.uint64(k + 1))) * np.uint64(BASE) if len(full) else full
    full = mixed(full)
    for a, b in zip(first.tolist(), last.tolist()):
        if b - a >= n:
            s = np.sort(full[a : b - n + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            h = 0x5851F42D4C957F2D + (b - a)
            for w in words[a:b].tolist():
                h = ((h ^ w) * BASE + 0x14057B7EF767814F) & MASK
            out.append(np.array([h], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
