"""Suffix-array dedup of exact byte substrings: removes every byte of a LENGTH-byte string that also starts earlier.

1. Anchors. Among the GRAM-byte hashes of each LENGTH-byte window the least is an anchor. Equal windows have equal
   anchors at equal offsets, so repeats are found among the occurrences of an anchor, one for some 35 bytes.
2. Each anchor carries the hash of its surroundings: all bytes of all windows that it can anchor. Occurrences with equal
   surroundings repeat whole; each task tells its earliest only, so a passage in a third of all documents is a row a
   task, and a window function ranks these rows. An anchor that occurs once is dropped.
3. Where an anchor has several different surroundings, their suffixes (to the right of the anchor) and reversed prefixes
   (to the left) are sorted by mergesort. Two suffixes are compared by binary search for their common extension over
   prefix polynomial hashes, in a logarithmic number of steps; the extensions between neighbours are then verified
   byte by byte, and a batch with a hash collision is sorted by its bytes. Common extensions of at least t bytes are
   runs of neighbours, so each window's class is its pair of runs; all but the earliest of a class are repeats.
4. The repeats of a document are joined to its bytes and cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.shared import mixed, powers, prefix_hash, small_batches, written

LENGTH, GRAM = 100, 32
#: Bytes before an anchor that its windows can reach.
LEFT = LENGTH - GRAM
#: Anchors held by a task before it tells them.
HELD = 1_500_000
#: An anchor with more different surroundings than this is resolved by an aggregate over window hashes.
HOT = 20_000


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best over x[i : i + width], by doubling; the last width - 1 places are cut off."""
    have = 1
    while 2 * have <= width:
        x = best(x[:-have], x[have:])
        have *= 2
    return best(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def anchors(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """(place, document number, anchor hash, hash of the surroundings, right edge) for documents laid end to end."""
    n = len(data)
    nothing = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64, np.int64))
    if n < LENGTH:
        return nothing
    p = prefix_hash(data)
    _, inv = powers(n + 1)
    full = mixed((p[GRAM:] - p[:-GRAM]) * inv[: n - GRAM + 1])
    size = end - begin
    left_over = np.repeat(end, size) - np.arange(n)  # bytes from here to the document's end
    small = (full >> np.uint64(32)).astype(np.uint32)
    small[left_over[: len(small)] < GRAM] = np.uint32(0xFFFFFFFF)
    low = _sliding(small, LENGTH - GRAM + 1, np.minimum)  # by window start
    low[left_over[: len(low)] < LENGTH] = 0
    width = LENGTH - GRAM + 1
    padded = np.zeros(len(small) + width - 1, np.uint32)
    padded[width - 1 : width - 1 + len(low)] = low
    chosen = np.flatnonzero((small == _sliding(padded, width, np.maximum)) & (left_over[: len(small)] >= GRAM) & (small > 0))
    if not len(chosen):
        return nothing
    doc = np.searchsorted(end, chosen, "right")
    a, b = np.maximum(begin[doc], chosen - LEFT), np.minimum(end[doc], chosen + LENGTH)
    around = (p[b] - p[a]) * inv[a]
    around = mixed(around * np.uint64(0xD1342543DE82EF95) + mixed(((chosen - a) * 512 + (b - chosen)).astype(np.uint64)))
    return chosen - begin[doc], doc, full[chosen], around, b - begin[doc]


def _joined(starts: np.ndarray, stops: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals sorted by document and start, with overlapping and touching ones joined (starts and stops both rise)."""
    new = np.concatenate(([True], (docs[1:] != docs[:-1]) | (starts[1:] > stops[:-1])))
    last = np.append(np.flatnonzero(new)[1:] - 1, len(docs) - 1)
    return starts[new], stops[last], docs[new]


def _told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """kind 0: (seed, ctx, doc_id, pos, stop), the earliest anchor of its kind in this task. kind 1: a repeat [pos, stop)."""
    held: list[tuple[np.ndarray, ...]] = []
    count = 0

    def flush() -> Iterator[pd.DataFrame]:
        ids, pos, seed, ctx, stop = (np.concatenate(x) for x in zip(*held))
        o = np.lexsort((pos, ids))
        o = o[np.argsort((seed ^ (ctx << np.uint64(1)))[o], kind="stable")]
        ids, pos, seed, ctx, stop = ids[o], pos[o], seed[o], ctx[o], stop[o]
        new = np.concatenate(([True], (seed[1:] != seed[:-1]) | (ctx[1:] != ctx[:-1])))
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        again = ~new & ((ids != ids[head]) | (pos != pos[head])) & (stop - np.maximum(0, pos - LEFT) >= LENGTH)
        for s in range(0, len(f := np.flatnonzero(new)), 50_000):
            k = f[s : s + 50_000]
            yield pd.DataFrame({"kind": np.int8(0), "seed": seed[k].view(np.int64), "ctx": ctx[k].view(np.int64), "doc_id": ids[k], "pos": pos[k].astype(np.int32), "stop": stop[k].astype(np.int32)})
        if again.any():
            i, a, b = ids[again], np.maximum(0, pos[again] - LEFT), stop[again]
            o = np.lexsort((b, a, i))
            a, b, i = _joined(a[o], b[o], i[o])
            yield pd.DataFrame({"kind": np.int8(1), "seed": mixed(i.view(np.uint64) * np.uint64(31) + a.astype(np.uint64)).view(np.int64), "ctx": np.int64(0), "doc_id": i, "pos": a.astype(np.int32), "stop": b.astype(np.int32)})

    for batch in batches:
        for ids, data, begin, end in _laid(batch["doc_id"].to_numpy(), batch["text"].tolist()):
            pos, doc, seed, ctx, stop = anchors(data, begin, end)
            held.append((ids[doc], pos, seed, ctx, stop))
            count += len(pos)
        if count > HELD:
            yield from flush()
            held, count = [], 0
    if count:
        yield from flush()


def _laid(ids: np.ndarray, texts: list, most: int = 400_000) -> Iterator[tuple[np.ndarray, ...]]:
    """Documents laid end to end in groups of some ``most`` bytes: (ids, bytes, begins, ends)."""
    raw: list[bytes] = []
    size = first = 0
    for k, t in enumerate(texts):
        raw.append((t or "").encode("utf-8", "surrogatepass"))
        size += len(raw[-1])
        if size >= most or k == len(texts) - 1:
            end = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
            yield ids[first : k + 1], np.frombuffer(b"".join(raw), np.uint8), end - np.fromiter(map(len, raw), np.int64, len(raw)), end
            raw, size, first = [], 0, k + 1


# ---------------------------------------------------------------------------------------------------------------
# The suffix sort.


def extension(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of rows a and b, by binary search over their prefix hashes p[row, length]."""
    low, high = np.zeros(len(a), np.int64), np.full(len(a), p.shape[1] - 1)
    while (open_ := low < high).any():
        mid = (low + high + 1) // 2
        same = p[a, mid] == p[b, mid]
        low = np.where(open_ & same, mid, low)
        high = np.where(open_ & ~same, mid - 1, high)
    return low


def sorted_suffixes(rows: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): rows of symbols sorted within their groups, and each one's common extension with the one before.

    ``begin`` and ``size`` give each row's group, which lies in one piece. Bottom-up mergesort: each suffix finds its
    rank in the neighbouring run by binary search, all of them at once.
    """
    n, width = rows.shape
    power, _ = powers(width + 1)
    p = np.zeros((n, width + 1), np.uint64)
    np.cumsum((rows.astype(np.uint64) + np.uint64(1)) * power[:width], axis=1, out=p[:, 1:])
    order = np.arange(n)
    at = np.arange(n)  # the place of order[k] is k; groups stay where they are
    run = 1
    while run < (size.max() if n else 0):
        offset = at - begin
        mine = offset // run
        low = begin + (mine ^ 1) * run
        low = np.minimum(low, begin + size)
        high = np.minimum(low + run, begin + size)
        start, later = low.copy(), (mine & 1).astype(bool)
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            a, b = order[mid], order[open_]
            e = extension(p, a, b)
            end = e == width
            c = np.minimum(e, width - 1)
            less = np.where(end, later[open_], rows[a, c] < rows[b, c])  # the sibling's suffix comes before this one
            low[open_] = np.where(less, mid + 1, low[open_])
            high[open_] = np.where(less, high[open_], mid)
        place = begin + (mine // 2) * 2 * run + offset % run + (low - start)
        merged = np.empty_like(order)
        merged[place] = order
        order = merged
        run *= 2
    lcp = np.zeros(n, np.int64)
    inner = np.flatnonzero(at > begin)
    lcp[inner] = extension(p, order[inner - 1], order[inner])
    # collision verification: the bytes themselves must agree so far and no further, and be in order
    if len(inner):
        a, b = rows[order[inner - 1]], rows[order[inner]]
        differ = a != b
        true = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        c = np.minimum(true, width - 1)
        k = np.arange(len(inner))
        if (true != lcp[inner]).any() or ((true < width) & (a[k, c] > b[k, c])).any():
            order = np.lexsort((*rows.T[::-1], begin))
            a, b = rows[order[inner - 1]], rows[order[inner]]
            differ = a != b
            lcp[inner] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return order, lcp


def _surroundings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(seed, hot, doc_id, pos, left, bytes) for the anchors listed with each document."""
    for batch in batches:
        out: list[tuple] = []
        for i, t, found in zip(batch["doc_id"].tolist(), batch["text"], batch["found"]):
            raw = (t or "").encode("utf-8", "surrogatepass")
            out += [(f["seed"], f["hot"], i, f["pos"], min(f["pos"], LEFT), raw[max(0, f["pos"] - LEFT) : f["pos"] + LENGTH]) for f in found]
        for s in range(0, len(out), 20_000):
            yield pd.DataFrame(out[s : s + 20_000], columns=["seed", "hot", "doc_id", "pos", "left", "bytes"])


def resolve(seed: np.ndarray, doc: np.ndarray, pos: np.ndarray, left: np.ndarray, raw: list[bytes]) -> pd.DataFrame:
    """The repeats [pos, stop) among surroundings of the same anchor: windows that an earlier surrounding holds too."""
    o = np.lexsort((pos, doc, seed))
    seed, doc, pos, left, raw = seed[o], doc[o], pos[o], left[o], [raw[k] for k in o]
    n = len(seed)
    new = np.concatenate(([True], seed[1:] != seed[:-1]))
    size = np.diff(np.append(np.flatnonzero(new), n))
    begin, group_size = np.repeat(np.flatnonzero(new), size), np.repeat(size, size)
    m = np.full((n, LEFT + LENGTH), 256, np.int16)  # 256: beyond the document
    flat = np.frombuffer(b"".join(raw), np.uint8)
    length = np.fromiter(map(len, raw), np.int64, n)
    row = np.repeat(np.arange(n), length)
    m[row, np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length) + np.repeat(LEFT - left, length)] = flat
    right = length - left
    ranks = []
    for part in (m[:, LEFT:], m[:, :LEFT][:, ::-1]):
        ranks.append(sorted_suffixes(np.ascontiguousarray(part), begin, group_size))
    dup = np.zeros((n, LEFT + 2), bool)
    (ro, rl), (lo, ll) = ranks
    rc, lc = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(LEFT + 1):
        rc[ro] = np.cumsum((rl < LENGTH - d) | new)
        lc[lo] = np.cumsum((ll < d) | new)
        fits = np.flatnonzero((left >= d) & (right >= LENGTH - d))
        if len(fits) > 1:
            key = rc[fits] * np.int64(n + 1) + lc[fits]
            k = np.argsort(key, kind="stable")
            first = np.concatenate(([True], key[k][1:] != key[k][:-1]))
            head = fits[k[np.flatnonzero(first)[np.cumsum(first) - 1]]]
            mine = fits[k]
            dup[mine, d + 1] = (doc[mine] != doc[head]) | (pos[mine] != pos[head])
    edge = np.diff(np.pad(dup, ((0, 0), (0, 1))).astype(np.int8), axis=1)
    r1, d1 = np.nonzero(edge == 1)
    _, d2 = np.nonzero(edge == -1)
    return pd.DataFrame({"doc_id": doc[r1], "pos": (pos[r1] - (d2 - 1)).astype(np.int32), "stop": (pos[r1] - d1 + LENGTH).astype(np.int32)})


def _resolved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole groups of an anchor, some thousands of rows at a time."""

    def out(frames: list[pd.DataFrame]) -> pd.DataFrame:
        g = pd.concat(frames, ignore_index=True)
        return resolve(g["seed"].to_numpy(), g["doc_id"].to_numpy(), g["pos"].to_numpy().astype(np.int64), g["left"].to_numpy().astype(np.int64), g["bytes"].tolist())

    held, rows = [], 0
    for b in batches:
        if not len(b):
            continue
        if rows >= 4096:
            seeds = b["seed"].to_numpy()
            cut = int((seeds != held[-1]["seed"].iloc[-1]).argmax()) if (seeds != held[-1]["seed"].iloc[-1]).any() else len(b)
            held.append(b.iloc[:cut])
            rows += cut
            if cut < len(b):
                yield out(held)
                held, rows = [b.iloc[cut:]], len(b) - cut
        else:
            held.append(b)
            rows += len(b)
    if rows:
        yield out(held)


def _windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every window of a hot anchor's surroundings by its digest: (digest, doc_id, pos)."""
    for b in batches:
        for i, pos, left, raw in zip(b["doc_id"].tolist(), b["pos"].tolist(), b["left"].tolist(), b["bytes"]):
            n = len(raw) - LENGTH + 1
            if n > 0:
                n = min(n, left + 1)
                yield pd.DataFrame({"digest": [hashlib.blake2b(raw[k : k + LENGTH], digest_size=16).digest() for k in range(n)], "doc_id": np.int64(i), "pos": np.arange(pos - left, pos - left + n, dtype=np.int32)})


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, stop): byte intervals that cover exactly what is to be removed; they may overlap and recur."""
    small_batches(docs.sparkSession)
    d = docs.select("doc_id", "text").where("doc_id is not null")
    told = d.where("octet_length(text) >= 100").mapInPandas(_told, "kind byte, seed long, ctx long, doc_id long, pos int, stop int")
    order = [F.col("ctx"), F.col("doc_id"), F.col("pos")]
    by_seed = Window.partitionBy("seed", "kind").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_both = Window.partitionBy("seed", "kind", "ctx").orderBy("doc_id", "pos")
    ranked = (
        told.withColumn("lo", F.min("ctx").over(by_seed)).withColumn("hi", F.max("ctx").over(by_seed)).withColumn("n", F.count("*").over(by_seed))
        .withColumn("rank", F.rank().over(by_both))
        .where("kind = 1 or rank > 1 or lo < hi")
        .select("kind", "seed", "doc_id", "pos", "stop", F.expr("kind = 0 and rank = 1").alias("open"), (F.col("n") > HOT).alias("hot"))
    )
    ranked = written(ranked, "zstd")
    whole = ranked.where("kind = 1").select("doc_id", "pos", "stop")
    first = F.greatest(F.lit(0), F.col("pos") - LEFT)
    same = ranked.where((F.col("kind") == 0) & ~F.col("open") & (F.col("stop") - first >= LENGTH)).select("doc_id", first.alias("pos"), "stop")
    listed = ranked.where("open").groupBy("doc_id").agg(F.collect_list(F.struct("seed", "hot", "pos")).alias("found"))
    around = d.join(listed.hint("shuffle_hash"), "doc_id").mapInPandas(_surroundings, "seed long, hot boolean, doc_id long, pos int, left int, bytes binary")
    around = written(around, "zstd")
    cold = around.where("not hot").repartition("seed").sortWithinPartitions("seed").mapInPandas(_resolved, "doc_id long, pos int, stop int")
    digests = around.where("hot").select("doc_id", "pos", "left", "bytes").mapInPandas(_windows, "digest binary, doc_id long, pos int").distinct()
    earliest = digests.groupBy("digest").agg(F.min(F.struct("doc_id", "pos")).alias("first"))
    hot = digests.join(earliest, "digest").where("first.doc_id <> doc_id or first.pos <> pos").select("doc_id", "pos", (F.col("pos") + LENGTH).alias("stop"))
    return whole.union(same).union(cold).union(hot)


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for i, t, found in zip(b["doc_id"].tolist(), b["text"], b["found"]):
            raw = (t or "").encode("utf-8", "surrogatepass")
            spans = []
            if found is not None and len(found):
                at = np.sort(np.fromiter(found, np.int64, len(found)))
                start, stop = at >> 32, np.maximum.accumulate(at & 0xFFFFFFFF)
                new = np.concatenate(([True], start[1:] > stop[:-1]))
                ends = np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)
                spans = list(zip(start[new].tolist(), stop[ends].tolist()))
            parts, at = [], 0
            for s, e in spans:
                parts.append(raw[at:s])
                at = e
            parts.append(raw[at:])
            rows.append((i, len(raw), sum(e - s for s, e in spans), len(spans), hashlib.sha256(b"".join(parts)).hexdigest(), [x for y in spans for x in y]))
        yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def removal_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and spans (start and stop bytes by turns).

    A null text is empty; a text under 100 bytes loses nothing. Rows with a null doc_id are left out. Rows that share a
    doc_id are taken as one document told again: equal places count as one occurrence, and each row is cut alike.
    """
    packed = F.col("pos").cast("long") * F.lit(1 << 32) + F.col("stop")
    found = repeats(docs).select("doc_id", packed.alias("at")).groupBy("doc_id").agg(F.collect_set("at").alias("found"))
    d = docs.select("doc_id", "text").where("doc_id is not null").join(found.hint("shuffle_hash"), "doc_id", "left")
    return d.select("doc_id", "text", "found").mapInPandas(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>")
