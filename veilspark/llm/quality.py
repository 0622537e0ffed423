"""Quality classifier: learned vectors of hashed words and character n-grams, averaged per document, softmax output.

Trained by stochastic gradient descent in numpy on a bounded sample (PER_CLASS labelled documents a class); applied to
every whole text. Since vectors are averaged before a linear output, a feature's vector times the output weights is one
number, so scoring is a table lookup for each word and n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.features import fitted, gram_ids, held_out, laid, sampled, sigmoid, word_ids
from veilspark.llm.shared import small_batches

#: Most training documents drawn for each class.
PER_CLASS = 3000
BITS, DIM, GRAMS = 16, 8, (2, 3, 4)
#: Distances at which a word that stands again counts as a feature, an n-gram of word equality instead of words.
AGAIN = (1, 2, 3, 4)
SIZE = ((len(GRAMS) + 1) << BITS) + (1 << len(AGAIN))


def _features(codes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, ...]:
    """(n-gram buckets by place, one row a length; word begins; word buckets; repeat buckets), each kind with its own."""
    m = len(codes) - max(GRAMS) + 1
    grams = np.stack([gram_ids(codes, n, BITS)[:m].astype(np.int64) + (k << BITS) for k, n in enumerate(GRAMS)])
    s, w = word_ids(codes, BITS, alnum=False)
    number = np.arange(len(s)) - np.searchsorted(s, begin)[np.searchsorted(begin, s, "right") - 1]
    again = np.zeros(len(s), np.int64)  # each word's own feature: the pattern of its repeats within its text
    for k, back in enumerate(AGAIN):
        if len(s) > back:
            again[back:] |= ((w[back:] == w[:-back]) & (number[back:] >= back)).astype(np.int64) << k
    return grams, s, w + (len(GRAMS) << BITS), again + ((len(GRAMS) + 1) << BITS)


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of a text and their shares."""
    for _, codes, begin, length in laid([text]):
        grams, _, w, again = _features(codes, begin)
        ids, n = np.unique(np.concatenate((grams[:, begin[0] : begin[0] + length[0]].ravel(), w, again)), return_counts=True)
        return ids, n / max(1, n.sum())
    return np.zeros(0, np.int64), np.zeros(0)


def fit(texts: list[str], y: np.ndarray, share: float, epochs: int = 6, rate: float = 0.5, seed: int = 7) -> dict[str, np.ndarray]:
    """The table of feature scores and the bias: log-odds of label 1. ``share``: of label 1 among all labels."""
    rng = np.random.default_rng(seed)
    size = SIZE
    table = rng.uniform(-1 / DIM, 1 / DIM, (size, DIM)).astype(np.float32)
    out = rng.uniform(-0.5, 0.5, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    # squared gradients so far: each parameter's step falls with them
    seen, seen_out = np.full(size, 1e-6, np.float32), np.full((DIM, 2), 1e-3, np.float32)
    bags = [bag(t) for t in texts]
    for epoch in range(epochs):
        for k in rng.permutation(len(bags)):
            ids, share_of = bags[k]
            if not len(ids):
                continue
            c = share_of.astype(np.float32)
            h = c @ table[ids]
            z = h @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            g = p
            g[int(y[k])] -= 1
            dh = out @ g
            do = np.outer(h, g)
            seen_out += do * do
            out -= rate * do / np.sqrt(seen_out)
            bias -= 0.05 * g
            grad = c[:, None] * dh[None, :]
            seen[ids] += (grad * grad).mean(axis=1)
            table[ids] -= 0.1 * rate * grad / np.sqrt(seen[ids])[:, None]
    drawn = min(max(float(np.mean(y)), 1e-3), 1 - 1e-3) if len(y) else 0.5
    share = min(max(share, 1e-3), 1 - 1e-3)
    # the sample is balanced by class; the prior puts the true shares back
    prior = np.log(share / (1 - share)) - np.log(drawn / (1 - drawn))
    return {"table": (table @ (out[:, 1] - out[:, 0])).astype(np.float32), "bias": np.array(bias[1] - bias[0] + prior)}


def scores(model: dict[str, np.ndarray], texts: list[str | None]) -> np.ndarray:
    """Probability of label 1 for each whole text; a text without features gets the bias alone."""
    out = np.zeros(len(texts))
    table = model["table"]
    for first, codes, begin, length in laid(texts):
        grams, s, w, again = _features(codes, begin)
        by_place = np.zeros(len(codes) + 1, np.float64)
        by_place[: grams.shape[1]] = sum(table[g] for g in grams)
        by_place[s] += table[w] + table[again]
        total, words = np.cumsum(by_place) - by_place, np.searchsorted(s, np.concatenate((begin, begin + length)))
        n = len(GRAMS) * length + 2 * (words[len(begin) :] - words[: len(begin)])
        out[first : first + len(begin)] = (total[begin + length] - total[begin]) / np.maximum(1, n)
    return sigmoid(out + float(model["bias"]))


def scored(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """(doc_id, score, predicted) of every row; a null text scores as an empty one."""
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p = scores(held.value, b["text"].tolist())
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "score": p, "predicted": (p >= 0.5).astype(np.int32)})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, score double, predicted int")


def trained(docs: DataFrame, labels: DataFrame, target: str = "quality", by: int = 3, left: int = 1) -> dict[str, np.ndarray]:
    """A model from labelled rows whose crc32(doc_id) remainder is not ``left``; without any, every score is 0.5.

    Trained in one task on an executor, over the bounded sample; only the model comes to the driver.
    """
    small_batches(docs.sparkSession)
    rows, share = sampled(docs, labels, target, by, left, PER_CLASS)
    found = fitted(rows, lambda r: fit(r["text"].tolist(), r["y"].to_numpy(), share))
    return found or {"table": np.zeros(SIZE, np.float32), "bias": np.array(0.0)}


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``, in a row each, nulls and repeats included.

    A null or empty text has no feature and scores by the classes' shares alone; a score of exactly 0.5 predicts 1. Of
    repeated labels the greatest counts, of repeated documents in training the first text. An empty table gives an empty
    result. Further columns are ignored.
    """
    out = scored(docs, trained(docs, labels))
    return out.select("doc_id", held_out(3, 1).alias("held_out"), "score", "predicted")
