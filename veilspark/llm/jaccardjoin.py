"""N-gram Jaccard join by rare-first prefix filtering, with length, positional and suffix filters.

1. ``counted``: every shingle of every document is counted into a table of fixed size (2**22 counters, 16 MB, whatever
   the corpus), so that n-grams shared by very many documents stand out. The table orders n-grams rare first; the order
   is total, since equal counters are ordered by the n-gram's hash.
2. ``postings``: documents with equal shingle sets are one class. Two sets with Jaccard t share an n-gram among the
   first ``n - ceil(t*n) + 1`` of either, so only these are shuffled, grouped by n-gram; an n-gram of one class goes.
3. ``links``: in each group a pivot is paired with the classes not yet connected to it, and each pair that passes the
   length and positional filters is verified once, by suffix filter and intersection. Then each class is paired with
   the nearest one of another component, by parity sketch, for some rounds. In the end all remaining pairs of classes in different components are verified, but for those whose parity sketches differ in more
   bits than similar sets can differ in n-grams. Pairs within a component need no further test, since
   the result is the component; so a group of thousands of near copies costs rounds of stars, not the square.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.shared import components, discard, mixed, release_memory, small_batches, word_shingles, written

#: Counters of the frequency table: fixed, so that it may be broadcast.
COUNTER_BITS = 22
BLOCK_BITS = 16


def digest(s: np.ndarray) -> int:
    """Signed 64-bit name of a shingle set; 0 is kept for the empty set."""
    parts = np.array([[np.bitwise_xor.reduce(mixed(s))], [np.add.reduce(mixed(s ^ np.uint64(0xA5A5)))], [len(s)]], np.uint64)
    h = int(mixed(parts.sum(axis=0, dtype=np.uint64))[0])
    return (h - (1 << 64) if h >> 63 else h) or 1


def _counted(n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(1 << COUNTER_BITS, np.uint32)
        for b in batches:
            sets = word_shingles(b["text"].tolist(), n)
            if sets and (flat := np.concatenate(sets)).size:
                counts += np.bincount((flat >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), minlength=len(counts)).astype(np.uint32)
        for k, block in enumerate(np.split(counts, len(counts) >> BLOCK_BITS)):
            if block.any():
                yield pd.DataFrame({"block": [k], "n": [zlib.compress(block.astype(np.int64).tobytes(), 1)]})

    return run


def _summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds up the counts of each block that meets here; holds 65,536 counters for each of at most 64 blocks."""
    held: dict[int, np.ndarray] = {}
    for b in batches:
        for k, n in zip(b["block"].tolist(), b["n"]):
            held.setdefault(k, np.zeros(1 << BLOCK_BITS, np.int64))
            held[k] += np.frombuffer(zlib.decompress(n), np.int64)
    for k, block in held.items():
        yield pd.DataFrame({"block": [k], "n": [zlib.compress(block.tobytes(), 1)]})


def counted(docs: DataFrame, n: int) -> np.ndarray:
    """The frequency classes (binary logarithms of the counters, rounded down), of fixed size, on the driver."""
    schema = "block int, n binary"
    parts = docs.select("text").mapInPandas(_counted(n), schema)
    # two levels, so that no task adds up more than a share of all tasks' blocks
    spread = parts.withColumn("salt", F.spark_partition_id() % 8).repartition("block", "salt").select("block", "n").mapInPandas(_summed, schema)
    out = np.zeros(1 << COUNTER_BITS, np.uint8)
    for r in spread.repartition(16, "block").mapInPandas(_summed, schema).toLocalIterator():
        at = r.block << BLOCK_BITS
        out[at : at + (1 << BLOCK_BITS)] = np.log2(np.frombuffer(zlib.decompress(r.n), np.int64) + 1).astype(np.uint8)
    return out


def needed(size: np.ndarray | int, percent: int):
    """Least size of a set that can be similar to one of ``size``: ceil(percent * size / 100)."""
    return -(-percent * size // 100)


#: Bits of a set's parity sketch.
SKETCH = 512


def parities(s: np.ndarray) -> bytes:
    """For each of SKETCH buckets, whether an odd number of the set's n-grams fall into it.

    Two sets differ in at least as many n-grams as their sketches differ in bits, whatever the sets.
    """
    return np.packbits((np.bincount((s & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1).astype(bool)).tobytes()


def _prefixes(n: int, percent: int, classes):
    """Rows kind 0: (doc_id, node, size, sketch). Rows kind 1: (gram, node, size, place), the prefix of a node."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        order = classes.value
        told: set[int] = set()
        for b in batches:
            ids, sets = b["doc_id"].to_numpy(), word_shingles(b["text"].tolist(), n)
            nodes = np.array([digest(s) if len(s) else 0 for s in sets], np.int64)
            sizes = np.array([len(s) for s in sets], np.int64)
            yield pd.DataFrame({"kind": np.zeros(len(b), np.int8), "doc_id": ids, "gram": np.int64(0), "node": nodes, "size": sizes.astype(np.int32), "place": np.int32(0), "sketch": [parities(s) for s in sets]})
            grams, owner, place = [], [], []
            if len(told) > 500_000:
                told.clear()
            for k, s in enumerate(sets):
                if len(s) and nodes[k] not in told:
                    told.add(int(nodes[k]))
                    head = len(s) - int(needed(len(s), percent)) + 1
                    rank = order[(s >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)]
                    if head < len(s):  # the hashes are sorted, so a stable sort by class orders ties by hash
                        s = s[np.argsort(rank, kind="stable")[:head]]
                    grams.append(s)
                    owner.append(np.full(len(s), k))
                    place.append(np.arange(len(s)))
            if grams:
                o = np.concatenate(owner)
                yield pd.DataFrame({"kind": np.int8(1), "doc_id": np.int64(0), "gram": np.concatenate(grams).view(np.int64), "node": nodes[o], "size": sizes[o].astype(np.int32), "place": np.concatenate(place).astype(np.int32), "sketch": None})

    return run


def groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Whole groups of a stream sorted by ``key``: all rows of a key are in one of the frames, many keys in each."""
    rest: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        last = b[key].iloc[-1]
        cut = int((b[key].to_numpy() == last).argmax())
        if cut:
            yield pd.concat([*rest, b.iloc[:cut]], ignore_index=True)
            rest = [b.iloc[cut:]]
        elif rest and rest[-1][key].iloc[-1] != last:
            yield pd.concat(rest, ignore_index=True)
            rest = [b]
        else:
            rest.append(b)
    if rest:
        yield pd.concat(rest, ignore_index=True)


def _passes(size_a, place_a, size_b, place_b, percent: int):
    """Length filter and positional filter for pairs that share an n-gram at these places of their ordered sets.

    ``place`` counts from 0; at the first shared n-gram at most ``1 + rest`` n-grams are shared in all.
    """
    least, most = np.minimum(size_a, size_b), np.maximum(size_a, size_b)
    overlap = -(-percent * (size_a + size_b) // (100 + percent))
    return (100 * least >= percent * most) & (np.minimum(size_a - place_a, size_b - place_b) >= overlap)


def _stars(rows: DataFrame, percent: int, turn: int) -> DataFrame:
    """In each group of an n-gram the pivot (least in an order that changes with ``turn``) meets all other components."""
    pivot = rows.groupBy("gram").agg(F.min_by(F.struct("node", "root", "size", "place"), F.xxhash64("node", F.lit(turn))).alias("p"))
    least, most = F.least("size", "p.size"), F.greatest("size", "p.size")
    overlap = F.ceil(percent * (F.col("size") + F.col("p.size")).cast("long") / (100 + percent))
    near = (100 * least.cast("long") >= percent * most.cast("long")) & (F.least(F.col("size") - F.col("place"), F.col("p.size") - F.col("p.place")) >= overlap)
    met = rows.join(pivot, "gram").where((F.col("root") != F.col("p.root")) & near)
    return met.select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")).distinct()


#: Rows of an n-gram's group that are compared at once; a larger group is dealt out in blocks, pair of blocks by pair.
BLOCK_ROWS = 4096


def _rest(rows: DataFrame, sketches: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """All pairs of a group in different components that pass the filters; or each row's ``nearest`` by sketch only."""
    blocks = F.ceil(F.col("n") / BLOCK_ROWS).cast("int")
    dealt = rows.join(sketches, "node").withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cell = F.xxhash64("gram", F.least("own", "other"), F.greatest("own", "other"))
    dealt = dealt.select(cell.alias("cell"), "own", (F.col("own") == F.col("other")).alias("same"), "node", "root", "size", "place", "sketch")
    return dealt.repartition("cell").sortWithinPartitions("cell", "size").mapInPandas(_blocks(percent, nearest), "a long, b long").distinct()


def _blocks(percent: int, nearest: bool, most: int = 300_000):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in groups(batches, "cell"):
            node, root, own, same = (g[c].to_numpy() for c in ("node", "root", "own", "same"))
            size, place, cell = g["size"].to_numpy().astype(np.int64), g["place"].to_numpy().astype(np.int64), g["cell"].to_numpy()
            sketch = np.frombuffer(b"".join(g["sketch"]), np.uint64).reshape(len(g), -1)
            bounds = np.append(np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))), len(cell))
            # for each row, the rows after it in its group whose size is at most 100/percent of its own
            end = np.repeat(bounds[1:], np.diff(bounds))
            wide = np.zeros(len(cell), np.int64)
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                wide[s:e] = s + np.searchsorted(size[s:e], 100 * size[s:e] // percent, "right")
            n = np.maximum(0, np.minimum(end, wide) - np.arange(len(cell)) - 1)
            total = np.cumsum(n)
            at = 0
            while at < len(n):
                upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
                i = np.repeat(np.arange(at, upto), n[at:upto])
                j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n[at:upto]) - n[at:upto], n[at:upto])
                # the rows of a block meet among themselves where it meets itself
                ok = (root[i] != root[j]) & ((own[i] != own[j]) | (same[i] & same[j])) & _passes(size[i], place[i], size[j], place[j], percent)
                i, j = i[ok], j[ok]
                total_size = size[i] + size[j]
                apart = np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1, dtype=np.int64)
                ok = apart <= total_size - 2 * -(-percent * total_size // (100 + percent))
                i, j, apart = i[ok], j[ok], apart[ok]
                if nearest and len(i):
                    ends, pair = np.concatenate((i, j)), np.tile(np.arange(len(i)), 2)
                    o = np.lexsort((apart[pair], ends))
                    first = np.concatenate(([True], ends[o][1:] != ends[o][:-1]))
                    pick = np.unique(pair[o[first]])
                    i, j = i[pick], j[pick]
                a, b = node[i], node[j]
                if len(a):
                    yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()
                at = upto

    return run


def suffix_bound(x: np.ndarray, y: np.ndarray, depth: int = 2) -> int:
    """A lower bound on the symmetric difference of two sorted sets, by halving both at y's middle element."""
    if not depth or not len(x) or not len(y):
        return abs(len(x) - len(y))
    m = len(y) // 2
    k = int(np.searchsorted(x, y[m]))
    hit = k < len(x) and x[k] == y[m]
    return suffix_bound(x[:k], y[:m], depth - 1) + suffix_bound(x[k + hit :], y[m + 1 :], depth - 1) + (not hit)


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * |x & y| >= percent * |x | y| for sorted distinct arrays; the suffix filter first."""
    total = len(x) + len(y)
    shared = -(-percent * total // (100 + percent))
    if suffix_bound(x, y) > total - 2 * shared:
        return False
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    i = int((both[1:] == both[:-1]).sum())
    return 100 * i >= percent * (total - i)


def _verified(n: int, percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for p in batches:
            if len(held) > 2000:
                held.clear()
            new: dict[int, str] = {}
            for node, text in (("a", "text_a"), ("b", "text_b")):
                new.update((k, t) for k, t in zip(p[node].tolist(), p[text]) if k not in held)
            held.update(zip(new, word_shingles(list(new.values()), n)))
            ok = [similar(held[a], held[b], percent) for a, b in zip(p["a"].tolist(), p["b"].tolist())]
            yield p.loc[ok, ["a", "b"]]

    return run


def classes_of(docs: DataFrame, n: int = 4, percent: int = 85, turns: int = 3) -> tuple[DataFrame, DataFrame]:
    """(members, links): members (doc_id, node, size) of every document, links (node, root) of the linked nodes.

    A node is a class of documents with equal shingle sets; root is the least node of its component.
    """
    spark = docs.sparkSession
    small_batches(spark)
    d = docs.select("doc_id", "text").where("doc_id is not null")
    order = spark.sparkContext.broadcast(counted(d, n))
    release_memory()
    schema = "kind byte, doc_id long, gram long, node long, size int, place int, sketch binary"
    made = d.mapInPandas(_prefixes(n, percent, order), schema)
    # one shuffle: members are spread by doc_id under kind 0, prefixes by n-gram under kind 1
    w = Window.partitionBy("kind", "key").orderBy("node", "size", "place")
    keyed = made.select("kind", F.when(F.col("kind") == 0, F.col("doc_id")).otherwise(F.col("gram")).alias("key"), "node", "size", "place", "sketch")
    # the same class told by several tasks stands once; an n-gram of a single class can't link anything
    keyed = keyed.withColumn("before", F.lag("node").over(w)).withColumn("after", F.lead("node").over(w))
    kept = written(keyed.where("kind = 0 or ((before is not null or after is not null) and (before is null or before <> node))").drop("before", "after"), "zstd")
    members = kept.where("kind = 0").select(F.col("key").alias("doc_id"), "node", "size")
    sketches = kept.where("kind = 0 and node <> 0").groupBy("node").agg(F.min("sketch").alias("sketch"))
    postings = kept.where("kind = 1").select(F.col("key").alias("gram"), "node", "size", "place")
    reps = members.where("node <> 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    roots, done, found = None, None, None
    for turn in range(turns + 1):
        rows = postings.withColumn("root", F.col("node")) if roots is None else postings.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        # groups within one component have nothing to add
        many = rows.groupBy("gram").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("gram", "n")
        rows = rows.join(many, "gram").select("gram", "n", "node", "root", "size", "place")
        pairs = _stars(rows, percent, turn) if turn == 0 else _rest(rows, sketches, percent, turn < turns)
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = written(pairs)
        if pairs.isEmpty():
            if turn < turns:
                continue
            break
        done = pairs if done is None else done.union(pairs)
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        texts = written(d.join(reps.join(nodes, "node"), "doc_id").select("node", "text").dropDuplicates(["node"]), "zstd")
        both = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        fresh = written(both.select("a", "b", "text_a", "text_b").mapInPandas(_verified(n, percent), "a long, b long"))
        discard(texts)
        found = fresh if found is None else found.union(fresh)
        if not fresh.isEmpty() or roots is None:
            roots = written(components(found))
    empty = spark.createDataFrame([], "node long, root long")
    return members, roots if roots is not None else empty


def component_report(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id (least doc_id reachable by links) of every document.

    A to Z are lowered; words are runs of anything but space and tab to carriage return; a text of fewer than n words has
    its word sequence as its only shingle, and null or blank texts have no shingle and no link. Rows with a null doc_id
    are left out. Repeated rows come out once each, in the same component.
    """
    members, roots = classes_of(docs, n, percent)
    placed = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.where("node <> 0").groupBy("root").agg(F.min("doc_id").alias("least"))
    return placed.join(least, "root", "left").select("doc_id", F.col("size").cast("long").alias("n_shingles"), F.when(F.col("node") == 0, F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def representatives(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with the least doc_id of each component only; rows with a null doc_id stay."""
    copies = component_report(docs, n, percent).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)
