"""Toxicity: a convolutional text classifier trained in numpy, with thresholds calibrated by language.

Words (lower-case runs of letters and digits) are hashed to embeddings, each the sum of the whole word's and that of its
first HEAD letters; what fewer than LEAST training documents hold has no embedding of its own. Filters of one, two and three words slide over
the whole text; each filter's largest answer, rectified, goes into a logistic output. The language whose threshold
applies is guessed from the text's own words by hashed word counts of the training rows; the lang column is never read
for a score. A language's threshold is the cut of best F1 on training rows set aside, and the score is shifted so that
each language's cut lies at CUT.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.features import fitted, held_out, laid, sampled, sigmoid, word_ids
from veilspark.llm.shared import small_batches

#: Most training documents drawn for each class.
PER_CLASS = 3000
BITS, DIM, FILTERS, WIDTHS = 15, 12, 12, (1, 2, 3)
HEAD, LEAST = 4, 3
CUT = 0.3
#: The embedding of nothing, after a text's last word; heads have the buckets below it, from 2**BITS.
NONE = 2 << BITS


def sequences(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, buckets of words and of heads, begin of each text): NONEs follow each text's words."""
    pad = max(WIDTHS)
    for first, codes, begin, length in laid(texts, lower=True, most=150_000):
        s, w, heads = word_ids(codes, BITS, True, HEAD)
        at = np.searchsorted(s, begin)
        n = np.diff(np.append(at, len(s)))
        start = np.cumsum(n + pad) - n - pad
        ids = np.full((2, len(w) + pad * len(begin)), NONE, np.int64)
        place = np.arange(len(w)) + pad * np.repeat(np.arange(len(begin)), n)
        ids[0, place], ids[1, place] = w, heads + (1 << BITS)
        yield first, ids, start


def fit(texts: list[str], y: np.ndarray, epochs: int = 5, rate: float = 0.08, seed: int = 3) -> dict[str, np.ndarray]:
    """Embeddings, filters and output weights by stochastic gradient descent with steps that fall with the gradients."""
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (NONE + 1, DIM)).astype(np.float32)
    emb[NONE] = 0
    fil = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    fb = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    out = rng.normal(0, 0.3, (len(WIDTHS), FILTERS)).astype(np.float32)
    bias = np.float32(0)
    s_emb, s_fil, s_fb, s_out = np.full(NONE + 1, 1e-4, np.float32), [np.full_like(f, 1e-2) for f in fil], [np.full_like(b, 1e-2) for b in fb], np.full_like(out, 1e-2)
    docs: list[np.ndarray] = []
    for _, ids, start in sequences(texts):
        docs += np.split(ids, start[1:], axis=1)
    held_by = np.zeros(NONE + 1, np.int64)
    for ids in docs:
        held_by[np.unique(ids)] += 1
    rare = held_by < LEAST
    emb[rare] = 0
    docs = [np.where(rare[ids], NONE, ids).astype(np.int32) for ids in docs]
    f = np.arange(FILTERS)
    for epoch in range(epochs):
        for k in rng.permutation(len(docs)):
            ids = docs[k]
            x = emb[ids[0]] + emb[ids[1]]
            n = len(x) - max(WIDTHS) + 1
            pooled, arg = [], []
            for w, filt, b in zip(WIDTHS, fil, fb):
                z = x[:n] @ filt[0]
                for o in range(1, w):
                    z += x[o : o + n] @ filt[o]
                j = z.argmax(axis=0)
                arg.append(j)
                pooled.append(np.maximum(0, z[j, f] + b))
            p = np.stack(pooled)
            g = np.float32(sigmoid(float((p * out).sum() + bias)) - y[k])
            back = g * out * (p > 0)
            grad = g * p
            s_out += grad * grad
            out -= rate * grad / np.sqrt(s_out)
            bias -= np.float32(0.02) * g
            at, moves = [], []
            for i, w in enumerate(WIDTHS):
                s_fb[i] += back[i] ** 2
                fb[i] -= rate * back[i] / np.sqrt(s_fb[i])
                for o in range(w):
                    at += list(ids[:, arg[i] + o])
                    moves += 2 * [back[i][:, None] * fil[i][o].T]
                    gf = x[arg[i] + o].T * back[i][None, :]
                    s_fil[i][o] += gf * gf
                    fil[i][o] -= rate * gf / np.sqrt(s_fil[i][o])
            rows, moves = np.concatenate(at), np.concatenate(moves)
            keep = rows != NONE
            rows, moves = rows[keep], moves[keep]
            np.add.at(s_emb, rows, (moves * moves).mean(axis=1))
            np.add.at(emb, rows, -rate * moves / np.sqrt(s_emb[rows])[:, None])
    # what a word adds to each filter at each offset, ready for scoring
    table = np.concatenate([emb @ filt[o] for w, filt in zip(WIDTHS, fil) for o in range(w)], axis=1).astype(np.float32)
    return {"table": table, "fb": np.concatenate(fb), "out": out.ravel(), "bias": np.array(bias)}


def logits(model: dict[str, np.ndarray], texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(log-odds before calibration, index of the guessed language) of each whole text."""
    total, lang = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    for first, ids, start in sequences(texts):
        n = ids.shape[1] - max(WIDTHS) + 1
        end = np.append(start[1:], ids.shape[1])
        k = slice(first, first + len(start))
        inside = np.ones(n, bool)  # windows begin at a word or at a text's first NONE, as in training
        for back in range(1, max(WIDTHS)):
            inside[end[:-1] - back] = False
        z, at = [], 0
        rows = model["table"][ids[0]] + model["table"][ids[1]]
        for w in WIDTHS:
            t = rows[:n, at : at + FILTERS].copy()
            for o in range(1, w):
                t += rows[o : o + n, at + o * FILTERS : at + (o + 1) * FILTERS]
            at += w * FILTERS
            t[~inside] = -np.inf
            z.append(np.maximum.reduceat(t, start, axis=0))
        total[k] = np.maximum(0, np.concatenate(z, axis=1) + model["fb"]) @ model["out"] + float(model["bias"])
        lang[k] = np.add.reduceat(model["speech"][ids[1]], start, axis=0).argmax(axis=1)
    return total, lang


def speech(texts: list[str], langs: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Log-probabilities of heads by language, smoothed."""
    names = sorted({x for x in langs if isinstance(x, str)}) or ["und"]
    counts = np.full((NONE + 1, len(names)), 0.05)
    for first, ids, start in sequences(texts):
        for k, piece in enumerate(np.split(ids[1], start[1:])):
            if (lang := langs[first + k]) in names:
                np.add.at(counts[:, names.index(lang)], piece, 1)
    counts[NONE] = 1
    out = np.log(counts / counts.sum(axis=0)).astype(np.float32)
    out[NONE] = 0
    return names, out


def best_cut(z: np.ndarray, y: np.ndarray, weight: float = 1.0) -> float:
    """The log-odds from which on predicting 1 gives the best F1, midway to the next lower value.

    ``weight``: how many texts of class 0 each of them stands for, where the sample has too few or too many of them.
    """
    o = np.argsort(-z, kind="stable")
    hits = np.cumsum(y[o])
    f1 = 2 * hits / (hits + weight * np.cumsum(1 - y[o]) + max(1, y.sum()))
    k = int(f1.argmax())
    return float((z[o[k]] + z[o[k + 1]]) / 2 if k + 1 < len(o) else z[o[k]] - 1)


def calibrated(texts: list[str], y: np.ndarray, langs: list[str | None], share: float) -> dict[str, np.ndarray]:
    """A fitted model with a threshold for each language; every fifth text is set aside for the thresholds.

    The sample is balanced by class and has clean pieces beside; for the thresholds its clean texts weigh as much as the
    true ``share`` of label 1 says.
    """
    # short texts have few words to pool over: a piece of each clean text, as clean, teaches where silence lies
    rng = np.random.default_rng(17)
    pieces = []
    for t, label, lang in zip(texts, y, langs):
        if not label and t:
            n = int(rng.integers(10, 200))
            at = int(rng.integers(0, max(1, len(t) - n)))
            pieces.append((t[at : at + n], lang))
    texts, langs = [*texts, *(t for t, _ in pieces)], [*langs, *(x for _, x in pieces)]
    y = np.concatenate((y, np.zeros(len(pieces), y.dtype)))
    aside = np.arange(len(y)) % 5 == 0
    pick = lambda a, m: [x for x, keep in zip(a, m) if keep]
    model = fit(pick(texts, ~aside), y[~aside])
    names, model["speech"] = speech(pick(texts, ~aside), pick(langs, ~aside))
    z, lang = logits(model, pick(texts, aside))
    toxic = y[aside].sum()
    weight = toxic * (1 - share) / (share * max(1, len(z) - toxic)) if 0 < share < 1 and toxic else 1.0
    # a cut from a handful of toxic texts would be chance; even odds stand in for it
    every = best_cut(z, y[aside], weight) if min(y[aside].sum(), (1 - y[aside]).sum()) >= 5 else 0.0
    cuts = np.full(len(names), every)
    for k in range(len(names)):
        mine = lang == k
        if min(y[aside][mine].sum(), (1 - y[aside][mine]).sum()) >= 10:
            cuts[k] = best_cut(z[mine], y[aside][mine], weight)
    return model | {"cuts": cuts}


def scores(model: dict[str, np.ndarray], texts: list[str | None]) -> np.ndarray:
    if "table" not in model:
        return np.zeros(len(texts))
    z, lang = logits(model, texts)
    return sigmoid(z - model["cuts"][lang] + np.log(CUT / (1 - CUT)))


def scored(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """(doc_id, score, predicted) of every row; a null text scores as an empty one."""
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p = scores(held.value, b["text"].tolist())
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "score": p, "predicted": (p >= CUT).astype(np.int32)})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, score double, predicted int")


def trained(docs: DataFrame, labels: DataFrame, target: str = "toxic", by: int = 4, left: int = 2) -> dict[str, np.ndarray]:
    """A model from labelled rows whose crc32(doc_id) remainder is not ``left``; without both classes every score is 0."""
    small_batches(docs.sparkSession)
    extra = ["lang"] if "lang" in docs.columns else []

    drawn, share = sampled(docs, labels, target, by, left, PER_CLASS, extra)

    def fit_rows(rows: pd.DataFrame) -> dict[str, np.ndarray]:
        if rows["y"].nunique() < 2:
            return {}
        return calibrated(rows["text"].tolist(), rows["y"].to_numpy(), rows["lang"].tolist() if extra else [None] * len(rows), share)

    return fitted(drawn, fit_rows)


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``, in a row each, nulls and repeats included.

    A null or empty text is one without words. A score of exactly CUT predicts 1. Of repeated labels the greatest counts,
    of repeated documents in training the first text. An empty table gives an empty result. Further columns are ignored.
    """
    return scored(docs, trained(docs, labels)).select("doc_id", held_out(4, 2).alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that score CUT or more; rows with a null doc_id are scored too. Columns stay."""
    model = trained(docs, labels)
    if not model:
        return docs
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def clean(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series(scores(held.value, t.tolist()) < CUT)

    return docs.where(clean(F.col("text")))
