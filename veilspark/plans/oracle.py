"""The queries' SQL, for a second engine: spans by plain scans, merging by windows, masking by string aggregation.

RE2 knows only ASCII word characters, so word characters are spelled out and a consumed character stands in for a
boundary in front. Its engine does not backtrack, so the patterns need no possessive repeats.
"""

from __future__ import annotations

from veilspark.functions import patterns as P

W = r"[\p{L}\p{N}_]"
WQ = rf"[\p{{L}}\p{{N}}_{P.QUOTES}]"
FRONT = rf"(?:^|[^\p{{L}}\p{{N}}_])"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def corpus(templates: list[tuple[str, str]]) -> str:
    """documents with a template's text before each text, by doc_id, and the template's language."""
    pick = lambda k: "CASE doc_id % " + str(len(templates)) + "".join(f" WHEN {i} THEN {quoted(t[k])}" for i, t in enumerate(templates)) + " END"
    return f"SELECT doc_id, {pick(1)} || text AS text, {pick(0)} AS lang FROM documents"


def scan(pattern: str, label: str, seq: int, part: int, where: str = "true", front: bool = True, keep: str = "true", edit: str = "found") -> str:
    """(doc_id, s, e, label, seq, part) of a pattern's group 1, which ends its match. ``edit`` may shorten the end."""
    p = quoted("(?i)" + (FRONT if front else "") + pattern)
    return f"""SELECT doc_id, (e - length(found))::BIGINT AS s, (e - length(found) + length({edit}))::BIGINT AS e, {quoted(label)} AS label, {seq} AS seq, {part} AS part FROM (
  SELECT doc_id, g[i] AS found, list_sum(list_transform(gap[1:i], lambda x: length(x))) + list_sum(list_transform(w[1:i], lambda x: length(x))) AS e FROM (
    SELECT doc_id, g, w, gap, unnest(range(1, len(w) + 1)) AS i FROM (
      SELECT doc_id, regexp_extract_all(text, {p}, 1) AS g, regexp_extract_all(text, {p}, 0) AS w, string_split_regex(text, {p}) AS gap FROM c WHERE {where})))
  WHERE {keep} AND length({edit}) > 0"""


_first = rf"[A-ZÀ-Ý]{WQ}*"
_next = rf"[A-ZÀ-Ýa-zà-ÿ]{WQ}*"
_ascii = rf"[A-Z][A-Za-z{P.QUOTES}]*"
_place = {"nl": rf"{_first}(?:\s+{_next})*", "fr": rf"{_first}(?:\s+{_next})*", "en": rf"{_ascii}(?:\s+{_ascii})*"}
_edge = "[" + "".join("\\" + c if c in r"[]-\^" else c for c in P.EDGE_PUNCTUATION) + "]+"
_trim = f"regexp_replace(regexp_replace(found, '\\s+$', ''), {quoted(_edge + '$')}, '')"
_digits = r"regexp_replace(regexp_replace(found, '^\+([1-9][0-9]{0,2})\s*\(0\)', '+\1'), '[^0-9]', '', 'g')"


def _plain(p: str) -> str:
    return "(" + p.replace(r"\b", "", 1).removesuffix(r"\b") + ")"


def _date(lang: str) -> str:
    return "(" + P.long_date(lang).replace(r"\b", "") + ")"


def detectors(lang: str | None) -> dict[str, list[str]]:
    """Name -> scans, for documents whose language has the rules of ``lang``; None: detectors for any language."""
    if lang is None:
        return {
            "iban": [scan(_plain(P.IBAN) + r"\b", "IBAN", 1, 0)],
            "email": [scan("(" + P.EMAIL + ")", "EMAIL", 1, 1, front=False)],
            "rrn": [scan(_plain(P.BE_RRN) + r"\b", "BE_RRN", 1, 2)],
            "phone": [scan("(" + P.PHONE + ")", "PHONE", 2, 0, front=False, keep=f"regexp_matches({_digits}, '^[1-9][0-9]{{6,14}}$')", edit=_trim)],
            "date_numeric": [scan("(" + P.DATE_NUMERIC + ")", "DATE_NUMERIC", 3, 1, front=False)],
            "generic": [scan(rf"(\d{{1,4}}(?:\s+[A-ZÀ-Ýa-zà-ÿ]{WQ}+)*\s+[A-ZÀ-Ýa-zà-ÿ]{WQ}*{W})", "ADDRESS", 9, 0)],
        }
    where = f"lang = '{lang}'" if lang != "nl" else "lang NOT IN ('fr', 'en')"
    street = "(?:" + "|".join(P.STREETS[lang]) + ")"
    tail = rf"\s+\d+[A-Za-z]?(?:\s*(?:{P.UNITS[lang]})\s*{W}+)?(?:\s*,\s*[1-9]\d{{3}}\s+{_first}(?:\s+{_next})*)?"
    name = rf"[A-Z][A-Za-z{P.QUOTES}]{{2,}}" if lang == "en" else rf"[A-ZÀ-Ý]{WQ}{{2,}}"
    return {
        "date_long": [scan(_date(lang), "DATE_LONG", 3, 0, where)],
        "birthplace": [scan(rf"{P.BORN_IN[lang]}\s+({_place[lang]})", "BIRTHPLACE", 3, 2, where)],
        "address": [scan(rf"({street}\s+{_first}(?:\s+{_next})*{tail})" if lang == "fr" else rf"({_first}(?:\s+{_next})*\s+{street}{tail})", "ADDRESS", 3, 3, where, edit=f"regexp_replace(found, {quoted('[' + P.QUOTES + ']+$')}, '')")],
        "residence": [scan(rf"{P.LIVES_IN[lang]}\s+({_place[lang]})", "ADDRESS", 4, 0, where)],
        "birthdate": [scan(rf"{P.BORN_ON[lang]}\s+{d}", "DATE_OF_BIRTH", 5, k, where) for k, d in enumerate((_date(lang), "(" + P.DATE_NUMERIC.replace(r"\b", "") + ")"))],
        "honorific": [scan(rf"{h}\s+((?:{name}\s+){{0,5}}{name})", "PERSON", 8, k, where, edit=_trim) for k, h in enumerate(P.HONORIFICS[lang])],
    }


def spans(names: list[str], templates: list[tuple[str, str]]) -> str:
    """WITH clause that defines c (the corpus) and x (all spans of the named detectors)."""
    found = [s for lang in (None, *P.LANGUAGES) for n, scans in detectors(lang).items() if n in names for s in scans]
    return f"WITH c AS ({corpus(templates)}),\nx AS ({' UNION ALL '.join(found)})"


def listed(name: str, templates: list[tuple[str, str]]) -> str:
    return spans([name], templates) + "\nSELECT doc_id, s::BIGINT AS span_start, e::BIGINT AS span_end, label FROM x"


_PRIORITY = "CASE label " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in P.PRIORITY.items()) + " ELSE 0 END"
MERGE = f""",
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, e, seq, label) AS rn, max(e) OVER (PARTITION BY doc_id ORDER BY s, e, seq, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY rn) AS island FROM o),
m AS (SELECT doc_id, min(s) AS s, max(e) AS e, arg_max(label, {_PRIORITY} * 1000000 - rn) AS label FROM i GROUP BY doc_id, island)"""


def merged(names: list[str], templates: list[tuple[str, str]]) -> str:
    return spans(names, templates) + MERGE + "\nSELECT doc_id, s::BIGINT AS span_start, e::BIGINT AS span_end, label FROM m"


def masked(names: list[str], templates: list[tuple[str, str]]) -> str:
    return (
        spans(names, templates)
        + MERGE
        + """,
p AS (SELECT m.doc_id, m.s, substring(c.text, lag(m.e, 1, 0) OVER (PARTITION BY m.doc_id ORDER BY m.s) + 1, m.s - lag(m.e, 1, 0) OVER (PARTITION BY m.doc_id ORDER BY m.s)) || '[FILTERED_' || label || ']' AS piece, c.text, m.e FROM m JOIN c USING (doc_id)),
t AS (SELECT doc_id, string_agg(piece, '' ORDER BY s) || substring(any_value(text), max(e) + 1) AS masked FROM p GROUP BY doc_id)
SELECT c.doc_id, coalesce(t.masked, c.text) AS masked FROM c LEFT JOIN t USING (doc_id)"""
    )


def label_counts(names: list[str], templates: list[tuple[str, str]]) -> str:
    return spans(names, templates) + MERGE + "\nSELECT label, count(*) AS n_spans, count(DISTINCT doc_id) AS n_docs, sum(e - s)::BIGINT AS n_chars FROM m GROUP BY label"


def values(rows: list[tuple], columns: str) -> str:
    """A table of literals."""
    one = lambda v: "NULL" if v is None else quoted(v) if isinstance(v, str) else str(v)
    return f"(VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) t({columns})"
