"""Language identification by error-correcting output codes.

Each language has a codeword; each bit of it is predicted by a binary logistic classifier over hashed character n-grams,
all trained in numpy on a bounded sample. Decoding is loss-weighted: the loss of every bit's margin under a codeword,
weighted by that bit's accuracy in training, is summed, and the codeword of least loss wins. If the runner-up is within
AMBIGUOUS of it, the document is flagged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.features import fitted, gram_ids, held_out, laid, remainder, sigmoid
from veilspark.llm.shared import small_batches

#: Most training documents drawn for each language.
PER_LANGUAGE = 800
BITS, GRAMS = 15, (1, 2, 3)
AMBIGUOUS = 0.1


def codewords(k: int, seed: int = 5) -> np.ndarray:
    """k rows of +1 and -1: for up to 5 languages all splits, beyond it random ones whose least distance is large."""
    if k <= 1:
        return np.ones((k, 1), np.float32)
    if k <= 5:
        splits = [[1 if (s >> i) & 1 else -1 for i in range(k)] for s in range(1, 1 << (k - 1))]
        return np.array(splits, np.float32).T
    rng = np.random.default_rng(seed)
    bits = max(15, int(np.ceil(8 * np.log2(k))))
    best, far = None, -1
    for _ in range(200):
        m = rng.choice([-1.0, 1.0], (k, bits)).astype(np.float32)
        d = (bits - m @ m.T) / 2
        np.fill_diagonal(d, bits)
        if (least := d.min()) > far and (abs(m.sum(axis=0)) < k).all():
            best, far = m, least
    return best


def _bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    for _, codes, begin, length in laid([text], lower=True):
        a, b = begin[0] - 1, begin[0] + length[0]  # from the space before, so that word beginnings show
        ids, n = np.unique(np.concatenate([gram_ids(codes, g, BITS)[a:b].astype(np.int64) + (k << BITS) for k, g in enumerate(GRAMS)]), return_counts=True)
        return ids, (n / n.sum()).astype(np.float32)
    return np.zeros(0, np.int64), np.zeros(0, np.float32)


def fit(texts: list[str], langs: list[str], epochs: int = 4, rate: float = 0.3, seed: int = 11) -> dict:
    """Bit classifiers for the languages seen, trained on each whole text and on two short pieces of it."""
    names = sorted(set(langs))
    code = codewords(len(names))
    rng = np.random.default_rng(seed)
    bags, rows = [], []
    for t, lang in zip(texts, langs):
        for piece in [t] + [t[(s := int(rng.integers(0, max(1, len(t) - n)))) : s + n] for n in (25, 80)]:
            if any(c.isalpha() for c in piece):
                bags.append(_bag(piece))
                rows.append(names.index(lang))
    bits = code.shape[1]
    w = np.zeros((len(GRAMS) << BITS, bits), np.float32)
    bias = np.zeros(bits, np.float32)
    seen = np.full(len(w), 1e-8, np.float32)
    scale = 20.0  # shares are small; the margin is scaled instead of the step
    right = np.zeros(bits)
    for epoch in range(epochs):
        for k in rng.permutation(len(bags)):
            ids, c = bags[k]
            target = code[rows[k]]
            margin = scale * (c @ w[ids]) + bias
            if epoch == epochs - 1:
                right += margin * target > 0
            g = -target * sigmoid(-target * margin).astype(np.float32)
            grad = scale * c[:, None] * g[None, :]
            seen[ids] += (grad * grad).mean(axis=1)
            w[ids] -= rate * grad / np.sqrt(seen[ids])[:, None]
            bias -= 0.02 * g
    accuracy = np.clip(right / max(1, len(bags)), 0.5, 1 - 1e-4)
    weight = np.log(accuracy / (1 - accuracy)) + 1e-3
    return {"names": names, "code": code, "w": w * scale, "bias": bias, "weight": (weight / weight.sum()).astype(np.float64)}


def margins(model: dict, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(bit margins of each whole text, whether it has a letter)."""
    bits = model["w"].shape[1]
    out, letters = np.zeros((len(texts), bits)), np.zeros(len(texts), bool)
    for first, codes, begin, length in laid(texts, lower=True, most=100_000):
        m = len(codes) - max(GRAMS) + 1
        total = np.zeros((m, bits), np.float32)
        for k, g in enumerate(GRAMS):
            total += model["w"][gram_ids(codes, g, BITS)[:m].astype(np.int64) + (k << BITS)]
        edges = np.empty(2 * len(begin), np.int64)
        edges[0::2], edges[1::2] = begin - 1, begin + length
        sums = np.add.reduceat(total, edges, axis=0, dtype=np.float64)[0::2]
        out[first : first + len(begin)] = sums / (len(GRAMS) * (length + 1))[:, None] + model["bias"]
    for k, t in enumerate(texts):
        letters[k] = t is not None and (t[:1].isalpha() or any(map(str.isalpha, t)))
    return out, letters


def decode(model: dict, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the language, score 0 to 1, ambiguous) from bit margins."""
    loss = np.stack([(np.logaddexp(0, -m * row[None, :]) * model["weight"]).sum(axis=1) for row in model["code"]], axis=1)
    best = loss.argmin(axis=1)
    e = np.exp(-4 * (loss - loss.min(axis=1, keepdims=True)))
    p = e / e.sum(axis=1, keepdims=True)
    two = np.sort(p, axis=1)[:, ::-1]
    return best, two[:, 0], (two[:, 0] - two[:, 1] < AMBIGUOUS) if p.shape[1] > 1 else np.zeros(len(m), bool)


def identified(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) of every row; ``und``, score 0, for a null text or one without a letter."""
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = held.value
        names = np.array([*model["names"], "und"], object)
        for b in batches:
            if not len(b):
                continue
            m, letters = margins(model, b["text"].tolist())
            if len(names) > 1:
                best, score, odd = decode(model, m)
            else:
                best, score, odd = np.zeros(len(b), int), np.zeros(len(b)), np.zeros(len(b), bool)
            best, score, odd = np.where(letters, best, len(names) - 1), np.where(letters, score, 0.0), odd | ~letters
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "lang_pred": names[best], "score": score, "ambiguous": odd})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def trained(docs: DataFrame, by: int = 5, left: int = 0) -> dict:
    """A model from the texts and languages of rows whose crc32(doc_id) remainder is not ``left``.

    Trained in one task on an executor, over the bounded sample; only the model comes to the driver.
    """
    small_batches(docs.sparkSession)
    fit_on = docs.where("lang is not null and text is not null and doc_id is not null").where(remainder(by) != left)
    counts = {r.lang: r.n for r in fit_on.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    rate = F.lit(0.0)
    for lang, n in counts.items():
        rate = F.when(F.col("lang") == lang, min(1.0, PER_LANGUAGE / n)).otherwise(rate)
    drawn = fit_on.select("doc_id", "text", "lang").where(F.pmod(F.xxhash64("doc_id", F.lit("draw")), F.lit(1_000_000)) < rate * 1_000_000)
    found = fitted(drawn, lambda r: {k: np.asarray(v) for k, v in fit(r["text"].tolist(), r["lang"].tolist()).items()})
    return {**found, "names": found["names"].tolist()} if found else fit([], [])


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous for every row of ``docs``, nulls and repeats included.

    A null text, or one without a letter, is ``und`` with score 0, as is everything where nothing could be learned. Of
    languages whose codewords are equally near, the first in alphabetical order is taken and the row is ambiguous. An
    empty table gives an empty result. Further columns are ignored.
    """
    return identified(docs, trained(docs)).select("doc_id", held_out(5, 0).alias("held_out"), "lang_pred", "score", "ambiguous")
