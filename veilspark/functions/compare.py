"""Tolerant comparison of names, and what models return, as column expressions."""

from __future__ import annotations

import string
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folds() -> tuple[str, str]:
    """Letters of the Latin blocks that fold to one ASCII letter, and those letters: derived from Unicode, not listed."""
    pairs = []
    for code in (*range(0x80, 0x250), *range(0x1E00, 0x1F00), 0x212A, 0x212B):
        folded = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if len(folded) == 1:
            pairs.append((chr(code), folded))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


FROM, TO = _folds()
_PUNCTUATION = "[" + "".join("\\" + c for c in string.punctuation) + "]"


def folded(text: Column) -> Column:
    """Accents dropped, letters lowered, other non-ASCII characters dropped; one character for one, or none."""
    return F.regexp_replace(F.lower(F.translate(text, FROM, TO)), r"[^\x00-\x7F]", "")


def normalised(text: Column) -> Column:
    """folded(), without punctuation, blanks as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(folded(text), _PUNCTUATION, ""), r"\s+", " "))


#: Stands for a character that normalised() drops, so that offsets stay.
_DROPPED = "\x01"


def same_length(text: Column) -> Column:
    """folded() with blanks as spaces, in which _DROPPED stands for each character that normalised() drops."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.translate(text, FROM, TO)), r"[^\x00-\x7F]", _DROPPED), _PUNCTUATION, _DROPPED), r"\s", " ")


def flexible_spans(haystack: Column, needle: Column) -> Column:
    """(start, end) of the non-overlapping occurrences of a name under normalised(), in the text's own offsets.

    A needle that normalises to nothing is nowhere. The name's pattern passes over dropped characters and runs of blanks,
    so that a whole text is searched without being taken apart into characters.
    """
    ndl = normalised(needle)
    gap = f"{_DROPPED}*+"
    pattern = F.regexp_replace(F.regexp_replace(ndl, "([^ ])(?=[^ ])", f"$1{gap}"), " ", f"(?:{gap} )++{gap}")
    # one-element arrays, so that the text is folded and searched once
    folded_text = F.array(F.struct(same_length(haystack).alias("hay"), pattern.alias("pattern")))
    lengths = F.transform(folded_text, lambda r: F.struct(F.transform(F.regexp_extract_all(r["hay"], r["pattern"], F.lit(0)), lambda m: F.length(m)).alias("n"), F.transform(F.split(r["hay"], r["pattern"], -1), lambda g: F.length(g)).alias("gap")))
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc: Column, r: Column) -> Column:
        start = acc["at"] + r["gap"]
        end = start + r["n"]
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end")))).alias("out"))

    pairs = lambda r: F.zip_with(r["n"], F.slice(r["gap"], F.lit(1), F.size(r["n"])), lambda n, g: F.struct(n.alias("n"), g.alias("gap")))
    found = F.transform(lengths, lambda r: F.aggregate(pairs(r), F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"]))
    return F.when((F.length(ndl) > 0) & ~ndl.contains(_DROPPED) & haystack.isNotNull(), found[0]).otherwise(empty)


def plain_spelling(found: Column, needle: Column) -> Column:
    """Whether a place is the folded name itself, whatever the case and the blanks between words: nothing else was passed over."""
    # the two letters beyond ASCII that differ from an ASCII one by case alone
    return F.regexp_replace(F.lower(F.translate(found, "\u017f\u212a", "sk")), r"[ \t\n\f\r]+", " ") == normalised(needle)


def stands_alone(text: Column, start: Column, end: Column) -> Column:
    """Whether no letter, mark, digit or underscore of a longer word touches the place."""
    at = lambda i: F.substring(text, i, F.lit(1)).rlike(r"[\p{L}\p{M}\p{N}_]")
    return ~((start > 0) & at(start)) & ~at(end + 1)


def name_variants(given: Column, family: Column) -> Column:
    """Given and family name in both orders, or the one there is; repeats go."""
    g, f = F.array_join(given, " "), F.array_join(family, " ")
    both = F.array(F.concat(g, F.lit(" "), f), F.concat(f, F.lit(" "), g))
    return F.when((g != "") & (f != ""), F.array_distinct(both)).when(f != "", F.array(f)).when(g != "", F.array(g)).otherwise(F.array().cast("array<string>"))


def tolerant_json(answer: Column) -> Column:
    """A model's answer as a variant: whole, or else from its first brace to its last; null if neither parses."""
    return F.coalesce(F.try_parse_json(answer), F.try_parse_json(F.regexp_extract(answer, r"(?s)\{.*\}", 0)))


def _list(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _int(v: Column, path: str) -> Column:
    """An integer of the answer; text, fractions and truth values are none."""
    inner = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(inner) == "BIGINT", F.try_variant_get(v, path, "int"))


def model_spans(answer: Column, text: Column, path: str, label: Column | str | None) -> Column:
    """(start, end, label) of the valid spans at ``path``: whole numbers with 0 <= start < end <= length.

    With ``label`` None each item names its own.
    """
    rows = F.transform(_list(tolerant_json(answer), path), lambda v: F.struct(_int(v, "$.start").alias("start"), _int(v, "$.end").alias("end"), (F.try_variant_get(v, "$.label", "string") if label is None else F.lit(label)).alias("label")))
    return F.filter(rows, lambda r: (r["start"] >= 0) & (r["start"] < r["end"]) & (r["end"] <= F.length(text)))


def persons(answer: Column) -> Column:
    """(given, family) of each person named in the answer: trimmed strings, empty ones dropped, persons without any too."""

    def names(v: Column, path: str) -> Column:
        items = F.transform(_list(v, path), lambda x: F.when(F.schema_of_variant(x) == "STRING", F.regexp_replace(F.try_variant_get(x, "$", "string"), r"(?U)^\s+|\s+$", "")))
        return F.filter(items, lambda s: s.isNotNull() & (s != ""))

    rows = F.transform(_list(tolerant_json(answer), "$.persons"), lambda v: F.struct(names(v, "$.given").alias("given"), names(v, "$.family").alias("family")))
    return F.filter(rows, lambda r: (F.size(r["given"]) > 0) | (F.size(r["family"]) > 0))
