"""Embedding near-dedup with an inverted multi-index.

Codebooks of K centres are learned independently for the two halves of the vectors, on a bounded sample; their product
is a grid of K * K cells, and every vector is filed in the cell of its nearest centres. A vector's search visits cells
in the order of the sum of both distances (the multi-sequence order) until the number of cells at which vectors turned
away by exactly the threshold angle are found at the target recall; everything in those cells is verified by its cosine.
A pair counts for both its vectors once, whichever of the two searches finds it. K grows with the number of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.shared import components, discard, small_batches, written

#: Most vectors that codebooks are learned on, the recall that calibrates the search, and the numbers of centres tried.
SAMPLE, RECALL, CENTRES = 20_000, 0.99, (8, 16, 32, 64, 128, 256)
#: Costs of sending a search to a cell and of a comparison there, in microseconds; only their ratio matters.
VISIT, COMPARE = 1.5, 0.006
#: Vectors of a cell, and searches of it, that meet in one piece; fuller cells are dealt out in pieces of both.
PIECE, SEARCHES = 1024, 4096


def unit(v) -> bytes | None:
    """The vector at length 1 in double precision; None if it is null, empty, zero or holds a null or non-finite part."""
    if v is None:
        return None
    x = np.array([np.nan if e is None else e for e in v], np.float64) if getattr(v, "dtype", None) == object else np.asarray(v, np.float64)
    if not x.size or not np.isfinite(x).all():
        return None
    top = np.abs(x).max()
    if top == 0:
        return None
    x = x / top
    return (x / np.sqrt((x * x).sum())).tobytes()


def _units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        u = [unit(v) for v in b["embedding"]]
        yield pd.DataFrame({"vec_id": b["vec_id"], "label": b["label"], "unit": u})


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = squared(x, c).argmin(axis=1)
        for j in range(len(c)):
            mine = x[own == j]
            c[j] = mine.mean(axis=0) if len(mine) else x[rng.integers(len(x))]
    return c


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)[None, :]


def fit(x: np.ndarray, threshold: float, total: int, seed: int = 1) -> dict:
    """Codebooks of both halves, and the number of cells to visit for RECALL at the threshold angle.

    ``total`` vectors are compared with each other. Of the numbers of centres that the sample supports, the one is taken
    whose searches cost least: more centres mean more cells to visit, but fewer vectors in them.
    """
    half = x.shape[1] // 2
    rng = np.random.default_rng(seed)
    a = x[rng.choice(len(x), min(len(x), 1500), replace=False)]
    turn = rng.normal(size=a.shape)
    turn -= (turn * a).sum(axis=1)[:, None] * a
    norm = np.sqrt((turn * turn).sum(axis=1))[:, None]
    b = threshold * a + np.sqrt(1 - threshold**2) * turn / np.where(norm > 0, norm, 1)
    best: dict = {}
    for tried in CENTRES:
        centres = max(1, min(tried, int(np.sqrt(len(x)) / 2)))  # fewer for a small sample, so that cells hold several
        index = {"half": half, "first": kmeans(x[:, :half], centres, seed=seed), "second": kmeans(x[:, half:], centres, seed=seed + 1)}
        index["visits"] = int(np.quantile(_ranks(index, a, b), RECALL)) + 1
        index["cost"] = index["visits"] * (VISIT + COMPARE * total / centres**2)
        if best and index["cost"] >= best["cost"]:
            break
        best = index
        if centres < tried:
            break
    return best


def _ranks(index: dict, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many cells lie nearer to each row of ``a`` than the cell of the same row of ``b``."""
    home = cells(index, b, 1)[:, 0]
    d1, d2 = squared(a[:, : index["half"]], index["first"]), squared(a[:, index["half"] :], index["second"])
    k, rows = d2.shape[1], np.arange(len(a))
    reach = d1[rows, home // k] + d2[rows, home % k]
    d2 = np.sort(d2, axis=1)
    return np.array([np.searchsorted(y, r - x, "left").sum() for x, y, r in zip(d1, d2, reach)])


def cells(index: dict, x: np.ndarray, visits: int) -> np.ndarray:
    """The ``visits`` nearest cells of each vector, nearest first."""
    d1, d2 = squared(x[:, : index["half"]], index["first"]), squared(x[:, index["half"] :], index["second"])
    o1, o2 = d1.argsort(axis=1, kind="stable"), d2.argsort(axis=1, kind="stable")
    # the n-th cell of the traversal is among the pairs of ranks (i, j) with (i + 1) * (j + 1) <= n
    i, j = np.nonzero(np.outer(np.arange(1, d1.shape[1] + 1), np.arange(1, d2.shape[1] + 1)) <= visits)
    total = np.take_along_axis(d1, o1, 1)[:, i] + np.take_along_axis(d2, o2, 1)[:, j]
    best = total.argsort(axis=1, kind="stable")[:, :visits]
    return (np.take_along_axis(o1[:, i], best, 1) * d2.shape[1] + np.take_along_axis(o2[:, j], best, 1)).astype(np.int64)


def _filed(held):
    """Adds ``cell`` and ``visited`` to each distinct vector."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw = b["unit"].tolist()
            home, visited = np.zeros(len(b), np.int64), np.zeros(len(b), object)
            by_size: dict[int, list[int]] = {}
            for k, r in enumerate(raw):
                by_size.setdefault(len(r) // 8, []).append(k)
            for dim, rows in by_size.items():
                index = held.value.get(dim)
                x = np.frombuffer(b"".join(raw[k] for k in rows)).reshape(len(rows), dim)
                for s in range(0, len(rows), 500):
                    near = cells(index, x[s : s + 500], index["visits"]) if index else np.zeros((len(x[s : s + 500]), 1), np.int64)
                    for k, c in zip(rows[s : s + 500], near):
                        home[k], visited[k] = c[0], c
            yield b.assign(cell=home, visited=visited)

    return run


def _met(threshold: float):
    """For each piece of a cell (kind 0, first) and the searches that visit it: hits of both sides, and links that connect.

    A searcher is credited with every hit; the vector it hits only if that one's own search doesn't visit the searcher's
    cell, since otherwise its own search finds the pair again. So each pair counts once for each of its two vectors.
    """

    def connected(hit: np.ndarray, p: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        big = np.iinfo(np.int64).max
        lp, lt = p.copy(), t.copy()
        while True:
            new = np.minimum(lp, np.where(hit, lt[None, :], big).min(axis=1))
            back = np.minimum(lt, np.where(hit, new[:, None], big).min(axis=0))
            if (new == lp).all() and (back == lt).all():
                return lp, lt
            lp, lt = new, back

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, parts, matrix, t_id, t_n, t_visits = None, [], None, None, None, None
        for b in batches:
            keys = b["piece"].to_numpy()
            bounds = np.append(np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))), len(keys))
            out = []
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if keys[s] != key:
                    key, parts, matrix = keys[s], [], None
                g = b.iloc[s:e]
                kind = g["kind"].to_numpy()
                own = g[kind == 0]
                if len(own):
                    parts.append(own)
                search = g[kind == 1]
                if not len(search) or not parts:
                    continue
                if matrix is None:
                    held = parts[0] if len(parts) == 1 else pd.concat(parts)
                    t_id, t_n = held["node"].to_numpy(), held["n"].to_numpy()
                    matrix = np.frombuffer(b"".join(held["unit"])).reshape(len(t_id), -1)
                    t_visits = np.stack(held["visited"].tolist())
                ids = search["node"].to_numpy()
                hit = np.frombuffer(b"".join(search["unit"])).reshape(len(ids), -1) @ matrix.T >= threshold
                hit &= ids[:, None] != t_id[None, :]
                if not hit.any():
                    continue
                some_p, some_t = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
                hit = hit[np.ix_(some_p, some_t)]
                ids, p_n, home = ids[some_p], search["n"].to_numpy()[some_p], search["home"].to_numpy()[some_p]
                back = np.zeros(len(some_t), np.int64)
                for c in np.unique(home):
                    mine = home == c
                    back += (p_n[mine] @ hit[mine]) * ~(t_visits[some_t] == c).any(axis=1)
                lp, lt = connected(hit, ids, t_id[some_t])
                out.append(pd.DataFrame({"node": np.concatenate((ids, t_id[some_t])), "root": np.concatenate((lp, lt)), "hits": np.concatenate((hit @ t_n[some_t], back))}))
            if out:
                yield pd.concat(out).groupby(["node", "root"], as_index=False)["hits"].sum()

    return run


def units_of(vectors: DataFrame) -> DataFrame:
    small_batches(vectors.sparkSession)
    v = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    return v.mapInPandas(_units, "vec_id long, label string, unit binary")


def linked(units: DataFrame, threshold: float = 0.93) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(copies, hits, links) of units_of(): copies (label, unit, rep, n, node), hits (node, hits), links (node, root).

    A node is a class of equal vectors of one label, whatever their ids; it stands for n rows, of which rep is the least id.
    """
    spark = units.sparkSession
    classes = units.where("label is not null and unit is not null").groupBy("label", "unit").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    # numbered as they are written, so that the numbers hold
    copies = written(classes.select("*", F.monotonically_increasing_id().alias("node")))
    sizes = copies.groupBy("label").agg(F.count("*").alias("n")).agg(F.sum("n").alias("total"), F.max("n").alias("most")).first()
    total, most = sizes.total or 0, sizes.most or 0
    drawn = copies.where(F.pmod(F.xxhash64("unit", F.lit("draw")), F.lit(1_000_000)) < 1e6 * min(1.0, SAMPLE / max(1, total))).select("unit").toArrow()["unit"].to_pylist()
    by_size: dict[int, list[bytes]] = {}
    for u in drawn:
        by_size.setdefault(len(u) // 8, []).append(u)
    indexes = {dim: fit(np.frombuffer(b"".join(us)).reshape(len(us), dim), threshold, most) for dim, us in by_size.items() if dim > 1}
    held = spark.sparkContext.broadcast(indexes)
    filed = written(copies.mapInPandas(_filed(held), "label string, unit binary, rep long, n long, node long, cell long, visited array<long>"))
    dim = F.octet_length("unit")
    where = ["label", "dim", "cell"]
    own = filed.select("label", dim.alias("dim"), "cell", "node", "n", "unit", "visited", F.col("cell").alias("home"))
    search = filed.select("label", dim.alias("dim"), F.explode("visited").alias("cell"), "node", "n", "unit", F.lit(None).cast("array<long>").alias("visited"), F.col("cell").alias("home"))
    full = own.groupBy(where).agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces"))
    asked = search.groupBy(where).agg(F.ceil(F.count("*") / SEARCHES).cast("int").alias("turns"))
    plan = full.join(asked, where)  # cells without vectors are not visited
    salt = lambda n, tag: F.pmod(F.xxhash64("node", F.lit(tag)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = own.join(plan, where).withColumn("k", salt("pieces", "piece")).withColumn("j", each("turns")).withColumn("kind", F.lit(0))
    b = search.join(plan, where).withColumn("j", salt("turns", "turn")).withColumn("k", each("pieces")).withColumn("kind", F.lit(1))
    piece = F.xxhash64(*where, "k", "j")
    columns = [piece.alias("piece"), "kind", "node", "n", "unit", "visited", "home"]
    rows = a.select(columns).union(b.select(columns))
    found = written(rows.repartition("piece").sortWithinPartitions("piece", "kind").mapInPandas(_met(threshold), "node long, root long, hits long"))
    discard(filed)
    hits = found.groupBy("node").agg(F.sum("hits").alias("hits"))
    return copies, hits, components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))


def near_duplicate_report(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector with an id.

    Only vectors of equal, non-null label (and equal length) are compared. Vectors that are null, empty, zero or hold a
    null or non-finite component, and those without label, link with nothing and are kept. Equal vectors of a label are one
    node of the search, counted with their number; repeated rows count as vectors of their own, and rows of one vec_id
    under several labels or vectors as so many vectors, so that labels never meet. Rows with a null vec_id go. An empty
    table gives an empty result. Further columns are ignored.
    """
    units = units_of(vectors)
    copies, hits, links = linked(units, threshold)
    nodes = copies.join(hits, "node", "left").join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = nodes.groupBy("root").agg(F.min("rep").alias("component_id"))
    nodes = nodes.join(least, "root").select("label", "unit", (F.coalesce("hits", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = units.join(nodes, ["label", "unit"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept"))
