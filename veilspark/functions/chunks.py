"""Sentences and chunks as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions import patterns as P


def checked(size: int, overlap: int) -> None:
    """A chunk must hold something, and the next one must begin after it did."""
    if not 0 <= overlap < size:
        raise ValueError(f"chunks of {size} characters can't overlap by {overlap}")


def sentences(text: Column, lang: Column) -> Column:
    """Sentences in order, trimmed. A language without abbreviations of its own has none."""
    cut = F.split(text, P.sentence_end(""))
    for name in P.LANGUAGES:
        cut = F.when(lang == name, F.split(text, P.sentence_end(name))).otherwise(cut)
    return F.filter(F.transform(cut, lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != "")


def windows(text: Column, size: int, overlap: int) -> Column:
    """Character windows that start every size - overlap characters; the last may lie inside the one before."""
    checked(size, overlap)
    n = F.length(text)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1, F.lit(size - overlap)), lambda s: F.substring(text, s + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def packed(parts: Column, size: int) -> Column:
    """Sentences joined by a space to chunks of at most ``size`` characters; a longer one stands alone."""
    empty = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("open"))

    def step(acc: Column, s: Column) -> Column:
        fits = acc["open"].isNotNull() & (F.length(acc["open"]) + 1 + F.length(s) <= size)
        out = F.when(fits | acc["open"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["open"])))
        return F.struct(out.alias("out"), F.when(fits, F.concat(acc["open"], F.lit(" "), s)).otherwise(s).alias("open"))

    return F.aggregate(parts, empty, step, lambda acc: F.when(acc["open"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["open"]))))


def sentence_chunks(text: Column, lang: Column, size: int = 800, overlap: int = 120) -> Column:
    """Chunks of whole sentences, disjoint; a text without a sentence is cut into character windows."""
    checked(size, overlap)
    parts = sentences(text, lang)
    return F.when(F.size(parts) > 0, packed(parts, size)).otherwise(windows(text, size, overlap))
