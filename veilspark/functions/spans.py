"""Detectors as column expressions: from a text to an array of (start, end, label, seq), in code points, end exclusive.

A detector is a list of rules. All rules of a call share one expression that takes the matches apart, so that the plan
stays small however many there are.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions import patterns as P

SPAN = "struct<start:int,end:int,label:string,seq:int>"
NO_SPANS = f"array<{SPAN}>"


def none() -> Column:
    return F.array().cast(NO_SPANS)


@dataclass(frozen=True)
class Rule:
    """A pattern and what its matches are. A group must stand at the end of its match; matches whose group is empty go."""

    label: str
    seq: int
    pattern: str
    group: int = 0
    #: A cheaper pattern that every match contains; texts without it are not searched further.
    hint: str | None = None
    #: Whether the match is told instead of its group.
    whole: bool = False
    #: What becomes of a match: kept as it is, or shaved in the way of its kind.
    kind: str = "plain"


#: Stand before and after each match, and between it and its group, in a marked text. No pattern can match them.
_EDGE_MARK, _GROUP_MARK, _OTHER = "\x02", "\x03", "\x04"


def _marked(text: Column, rule: Rule) -> Column:
    """The rule with the text in which its matches are marked; null where the hint is missing. One run over the text."""
    marked = F.regexp_replace(text, rule.pattern, f"{_EDGE_MARK}$0{_GROUP_MARK}${rule.group}{_EDGE_MARK}")
    if rule.hint is not None:
        marked = F.when(text.rlike(rule.hint), marked)
    return F.struct(marked.alias("text"), F.lit(rule.label).alias("label"), F.lit(rule.seq).alias("seq"), F.lit(rule.whole).alias("whole"), F.lit(rule.kind).alias("kind"))


_FOUND = "array<struct<start:int,end:int,found:string>>"


def _taken_apart(m: Column) -> Column:
    """(start, end, found) of a marked text's matches, from left to right: gaps and matches stand in it by turns."""
    pieces = F.transform(F.split(m["text"], _EDGE_MARK, -1), lambda p, i: F.struct(p.alias("p"), (i % 2 == 1).alias("hit")))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(_FOUND).alias("out"))

    def step(acc: Column, r: Column) -> Column:
        match, part = F.substring_index(r["p"], _GROUP_MARK, 1), F.substring_index(r["p"], _GROUP_MARK, -1)
        end = acc["at"] + F.length(match)
        told = F.when(m["whole"], match).otherwise(part)
        one = F.struct((end - F.length(told)).alias("start"), end.alias("end"), told.alias("found"))
        return F.struct(end.alias("at"), F.when(r["hit"] & (part != ""), F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    return F.when(m["text"].contains(_EDGE_MARK), F.aggregate(pieces, empty, step, lambda acc: acc["out"])).otherwise(F.array().cast(_FOUND))


def found(text: Column, rules: list[Rule], by: dict[str, list[Rule]] | None = None, lang: Column | None = None) -> Column:
    """Spans of all ``rules``, and of those ``by`` language that go for ``lang``."""
    plain = F.when(text.contains(_EDGE_MARK) | text.contains(_GROUP_MARK), F.translate(text, _EDGE_MARK + _GROUP_MARK, _OTHER * 2)).otherwise(text)
    marked = [_marked(plain, r) for r in rules]
    parts = [F.array(*marked)] if marked else []
    if by and any(by.values()):
        kind = "array<struct<text:string,label:string,seq:int,whole:boolean,kind:string>>"
        one = {g: F.array(*(_marked(plain, r) for r in rs)) if rs else F.array().cast(kind) for g, rs in by.items()}
        c = supported(lang)
        parts.append(F.when(c == "fr", one["fr"]).when(c == "en", one["en"]).otherwise(one["nl"]))
    if not parts:
        return none()
    used = {r.kind for rs in (rules, *(by or {}).values()) for r in rs}

    def shaped(m: Column) -> Column:
        rows = _taken_apart(m)
        for k in SHAPES:
            if k in used:
                rows = F.when(m["kind"] == k, SHAPES[k](rows)).otherwise(rows)
        return F.transform(rows, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), m["label"].alias("label"), m["seq"].alias("seq")))

    return F.flatten(F.transform(F.concat(*parts), shaped))


_EDGE = "[" + re.escape(P.EDGE_PUNCTUATION) + "]"


def trimmed(rows: Column) -> Column:
    """Blanks and then punctuation shaved off both edges, each once; spans left empty go."""

    def shave(r: Column) -> Column:
        s = r["found"]
        a = F.length(s) - F.length(F.regexp_replace(s, r"(?U)^\s+", ""))
        s1 = F.regexp_replace(s, r"(?U)^\s+", "")
        s2 = F.regexp_replace(s1, r"(?U)\s+$", "")
        s3 = F.regexp_replace(s2, f"^{_EDGE}+", "")
        s4 = F.regexp_replace(s3, f"{_EDGE}+$", "")
        start = r["start"] + a + (F.length(s2) - F.length(s3))
        return F.struct(start.alias("start"), (start + F.length(s4)).alias("end"), s4.alias("found"))

    return F.filter(F.transform(rows, shave), lambda r: r["end"] > r["start"])


def _valid_phones(rows: Column) -> Column:
    """A plus sign, 7 to 15 digits without a bracketed zero, the first not 0; shaved."""

    def valid(r: Column) -> Column:
        plain = F.regexp_replace(r["found"], r"(?U)^\+([1-9][0-9]{0,2})\s*\(0\)", "+$1")
        return F.regexp_replace(plain, "[^0-9]", "").rlike("^[1-9][0-9]{6,14}$")

    return trimmed(F.filter(rows, valid))


def _ending(rows: Column, found: Callable[[Column], Column]) -> Column:
    return F.transform(rows, lambda r: F.struct(r["start"].alias("start"), (r["start"] + F.length(found(r))).alias("end"), found(r).alias("found")))


#: kind of a rule -> what becomes of its matches
SHAPES: dict[str, Callable[[Column], Column]] = {
    "phone": _valid_phones,
    "trimmed": lambda rows: trimmed(rows),
    "address": lambda rows: _ending(rows, lambda r: F.regexp_replace(r["found"], f"[{P.QUOTES}]+$", "")),
    "generic": lambda rows: F.filter(_ending(rows, lambda r: F.regexp_replace(r["found"], P.GENERIC_EXCESS, "")), lambda r: r["found"].rlike(r"(?U)\s")),
}


def starting(first: str, pattern: str) -> str:
    """``pattern`` with a cheap look at what it must begin with, since a Unicode word boundary at every place is dear."""
    return f"{P.FLAGS}(?={first}){pattern}"


def identifiers(lang: str = "", labels: tuple[str, ...] = ("IBAN", "EMAIL", "BE_RRN")) -> list[Rule]:
    """Identifiers known by their form alone, those of the labels asked for."""
    known = {"IBAN": (r"[A-Z]{2}\d", P.IBAN, P.HINTS["IBAN"]), "EMAIL": ("[A-Za-z0-9._%+-]", P.EMAIL, "@"), "BE_RRN": (r"\d{2}", P.BE_RRN, P.HINTS["BE_RRN"])}
    return [Rule(x, 1, starting(*known[x][:2]), hint=known[x][2]) for x in labels]


def phones(lang: str = "") -> list[Rule]:
    """International numbers."""
    return [Rule("PHONE", 2, "(?U)" + P.PHONE, hint=r"\+[0-9]", kind="phone")]


def long_dates(lang: str) -> list[Rule]:
    return [Rule("DATE_LONG", 3, starting(r"[\dJFMASOND]" if lang == "en" else r"\d", P.long_date(lang)), hint=P.HINTS["YEAR"])]


def numeric_dates(lang: str = "") -> list[Rule]:
    return [Rule("DATE_NUMERIC", 3, starting(r"\d", P.DATE_NUMERIC), hint=P.HINTS["DATE_NUMERIC"])]


def birthplaces(lang: str) -> list[Rule]:
    return [Rule("BIRTHPLACE", 3, starting("[BGN]", P.birthplace(lang)), 1, P.HINTS["BORN"])]


def addresses(lang: str) -> list[Rule]:
    """Full addresses: matches whose group 1 is filled, less quotes at the end."""
    return [Rule("ADDRESS", 3, P.FLAGS + P.address(lang), 1, P.address_hint(lang), whole=True, kind="address")]


def residences(lang: str) -> list[Rule]:
    return [Rule("ADDRESS", 4, starting("[WVDRL]", P.residence(lang)), 1, P.HINTS["LIVES"])]


def birthdates(lang: str) -> list[Rule]:
    return [Rule("DATE_OF_BIRTH", 5, starting("[BGN]", p), 1, P.HINTS["BORN"]) for p in P.birthdates(lang)]


def honorifics(lang: str) -> list[Rule]:
    return [Rule("PERSON", 8, starting("[DM]", p), 1, P.honorific_hint(lang), kind="trimmed") for p in P.honorifics(lang)]


def safety(lang: str = "") -> list[Rule]:
    """The last sweep: a number and the words after it. It would find the identifiers again; equal spans of equal label
    change no merge, so they are left out."""
    return [Rule("ADDRESS", 9, starting(r"\d", P.GENERIC), hint=P.HINTS["GENERIC"], kind="generic")]


#: name -> rules for a language, or a caller's own function of text and language, as columns, to an array of SPAN.
DETECTORS: dict[str, Callable] = {
    "identifiers": identifiers, "phones": phones, "long_dates": long_dates, "numeric_dates": numeric_dates, "birthplaces": birthplaces,
    "addresses": addresses, "residences": residences, "birthdates": birthdates, "honorifics": honorifics, "safety": safety,
}
_OWN: set[str] = set()


def register(name: str, detector: Callable[[Column, Column], Column]) -> None:
    """Adds a detector: a function of text and language, as columns, to an array of SPAN. It may take a known one's place."""
    DETECTORS[name] = detector
    _OWN.add(name)


def unregister(name: str) -> None:
    DETECTORS.pop(name, None)
    _OWN.discard(name)


def supported(lang: Column) -> Column:
    """The language whose rules apply: nl where it is none of the supported ones."""
    return F.when(lang.isin(*P.LANGUAGES), lang).otherwise("nl")


def by_rules(text: Column, lang: Column, detectors: list[Callable[[str], list[Rule]]]) -> Column:
    """Spans of detectors given as rules; rules that are the same for all languages are searched without asking which it is."""
    rules = {g: [r for f in detectors for r in f(g)] for g in P.LANGUAGES}
    same = [r for r in rules[P.LANGUAGES[0]] if all(r in rs for rs in rules.values())]
    return found(text, same, {g: [r for r in rs if r not in same] for g, rs in rules.items()}, lang)


def all_spans(text: Column, lang: Column, model_spans: Column | None = None, names: list[str] | None = None) -> Column:
    """Union of all detectors, duplicates kept; ``model_spans`` are spans found by a model (seq 6 to 8)."""
    wanted = list(names or DETECTORS)
    parts = [by_rules(text, lang, [DETECTORS[n] for n in wanted if n not in _OWN])]
    parts += [F.coalesce(DETECTORS[n](text, lang).cast(NO_SPANS), none()) for n in wanted if n in _OWN]
    return F.concat(*parts, *([F.coalesce(model_spans, none())] if model_spans is not None else []))


def merged(spans: Column) -> Column:
    """Spans that overlap (touching is not overlapping) become one, under the label of highest priority, ties to the first."""
    priority = F.create_map(*(F.lit(x) for kv in P.PRIORITY.items() for x in kv))
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["seq"].alias("seq"), s["label"].alias("label"), F.coalesce(F.element_at(priority, s["label"]), F.lit(0)).alias("pri"))))
    empty = F.array().cast("array<struct<start:int,end:int,label:string,pri:int>>")
    lean = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"), s["pri"].alias("pri"))

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        keep = last["pri"] >= s["pri"]
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), F.when(keep, last["label"]).otherwise(s["label"]).alias("label"), F.greatest(last["pri"], s["pri"]).alias("pri"))
        return F.when((F.size(acc) > 0) & (s["start"] < F.get(acc, F.size(acc) - 1)["end"]), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(lean(s))))

    return F.aggregate(order, empty, step, lambda acc: F.transform(acc, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"))))


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by [FILTERED_label]; spans must be sorted and apart, as merged() gives them."""
    empty = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        before = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(F.concat(acc["out"], before, F.lit("[FILTERED_"), s["label"], F.lit("]")).alias("out"), s["end"].alias("at"))

    return F.aggregate(spans, empty, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def report(text: Column, spans: Column) -> Column:
    """The spans with their texts as JSON. It holds raw personal data: off unless asked for."""
    return F.to_json(F.struct(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"), F.substring(text, s["start"] + 1, s["end"] - s["start"]).alias("text"))).alias("spans")))
