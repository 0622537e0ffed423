"""Fixed word lists and pattern parts of the detectors, and the Java patterns built from them.

The patterns run over words with possessive repeats, so that a run of twenty thousand words neither recurses nor backtracks.
"""

from __future__ import annotations

LANGUAGES = ("nl", "fr", "en")

# Month names, street words, anchors, honorifics, priorities, abbreviations, edge punctuation.
MONTHS = {
    "nl": ["januari", "februari", "maart", "april", "mei", "juni", "juli", "augustus", "september", "oktober", "november", "december"],
    "fr": ["janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre"],
    "en": ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"],
}
STREETS = {
    "nl": ["straat", "laan", "steenweg", "weg", "plein", "dreef", "lei", "kaai", "baan", "hof", "markt", "vest", "ring", "kouter", "oever"],
    "fr": ["rue", "avenue", "boulevard", "chaussée", "place", "allée", "quai", "impasse", "cours"],
    "en": ["Street", "Avenue", "Boulevard", "Road", "Lane", "Drive", "Court", "Place", "Square", "Way"],
}
UNITS = {"nl": r"bus|busnr\.?|b\.?|box|unit|apt\.?|suite", "fr": r"bte|boîte|box", "en": r"bus|busnr\.?|b\.?|box|unit|apt\.?|suite"}
BORN_IN = {"nl": r"geboren\s+(?:te|in)", "fr": r"n[ée]\(?e\)?\s+à", "en": r"born\s+(?:in|at)"}
BORN_ON = {"nl": r"geboren\s+op", "fr": r"n[ée]\(?e\)?\s+le", "en": r"born\s+on"}
LIVES_IN = {"nl": r"(?:wonende|woonachtig|verblijvend)\s+te", "fr": r"(?:domicilié(?:e)?|demeurant)\s+à", "en": r"(?:residing|domiciled|living)\s+in"}
HONORIFICS = {"nl": [r"De\s+heer", "Mevrouw", r"Dhr\.?", r"Mevr\.?"], "fr": ["Monsieur", "Madame", r"M\.?", r"Mme\.?"], "en": [r"Mr\.?", r"Mrs\.?", r"Ms\.?"]}
PRIORITY = {"PERSON": 100, "DATE_OF_BIRTH": 90, "BIRTHPLACE": 85, "ADDRESS": 80, "IBAN": 76, "EMAIL": 72, "PHONE": 70, "BE_RRN": 70, "DATE_LONG": 60, "DATE_NUMERIC": 55}
ABBREVIATIONS = {
    "nl": ["dhr.", "mevr.", "mej.", "mw.", "mvr.", "dr.", "prof.", "mr.", "ir.", "ing.", "bv.", "nv.", "art.", "pag.", "blz."],
    "fr": ["m.", "mme.", "mlle.", "dr.", "pr.", "prof.", "av.", "env.", "etc.", "p.ex.", "art.", "n°.", "cf."],
    "en": ["mr.", "mrs.", "ms.", "dr.", "prof.", "sr.", "jr.", "etc.", "e.g.", "i.e.", "no.", "art.", "cf."],
}
EDGE_PUNCTUATION = ",.;:!?()[]{}<>“”‘’\"-–—/\\"
CLOSING_QUOTES = "»›’”\""
IBAN = r"\b[A-Z]{2}\d{2}[A-Z0-9]{1,30}\b"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
BE_RRN = r"\b\d{2}[.\-/]?\d{2}[.\-/]?\d{2}\s*-\s*\d{3}[.\-/]?\d{2}\b"
DATE_NUMERIC = r"\b[0-3]?\d[./-][0-1]?\d[./-]\d{2,4}\b"
PHONE = r"\+[0-9][0-9\s().\-]{5,}"
POSTAL = r"\b[1-9]\d{3}\b"
QUOTES = "’'`-"

#: Case-insensitive, with Unicode classes.
FLAGS = "(?iU)"
NOTHING = "$^"


def months(lang: str) -> str:
    """Alternation of a language's months; an empty one for other languages."""
    return "(?:" + "|".join(MONTHS.get(lang, [])) + ")"


def long_date(lang: str) -> str:
    """Day, month and year; English has both orders, ordinals and commas."""
    day, m = r"[0-3]?\d", months(lang)
    if lang in ("nl", "fr"):
        return rf"\b{day}\s+{m}\s+\d{{4}}\b"
    if lang == "en":
        nth = r"(?:st|nd|rd|th)?"
        return rf"(?:\b{day}{nth}\s+{m},?\s+\d{{4}}\b|\b{m}\s+{day}{nth},?\s+\d{{4}}\b)"
    return NOTHING


# A capitalised first word, a further word (no backtracking into either), and the English forms in ASCII letters.
_FIRST = rf"[A-ZÀ-Ý][\w{QUOTES}]*+"
_NEXT = rf"[A-ZÀ-Ýa-zà-ÿ][\w{QUOTES}]*+"
_ASCII = rf"[A-Z][A-Za-z{QUOTES}]*+"
_PLACE = {"nl": rf"{_FIRST}(?:\s+{_NEXT})*+", "fr": rf"{_FIRST}(?:\s+{_NEXT})*+", "en": rf"{_ASCII}(?:\s+{_ASCII})*+"}


def birthplace(lang: str) -> str:
    return rf"\b{BORN_IN[lang]}\s+({_PLACE[lang]})" if lang in BORN_IN else NOTHING


def residence(lang: str) -> str:
    return rf"\b{LIVES_IN[lang]}\s+({_PLACE[lang]})" if lang in LIVES_IN else NOTHING


def birthdates(lang: str) -> list[str]:
    """The date after the anchor, long and numeric; languages without an anchor use the English one."""
    lang = lang if lang in BORN_ON else "en"
    return [rf"\b{BORN_ON[lang]}\s+({date})" for date in (long_date(lang), DATE_NUMERIC)]


def honorifics(lang: str) -> list[str]:
    name = rf"[A-Z][A-Za-z{QUOTES}]{{2,}}" if lang == "en" else rf"[A-ZÀ-Ý][\w{QUOTES}]{{2,}}"
    return [rf"\b{h}\s+((?:{name}\s+){{0,5}}{name})" for h in HONORIFICS.get(lang, [])]


def address(lang: str) -> str:
    """Street address; group 1 is empty where a run of words turns out not to lead to a street and number.

    nl, en: words, then a street word, then a number. A whole run of words is taken at once and the number looked for
    behind it only if the run's last word is a street. fr: the street word comes first.
    """
    if lang not in STREETS:
        return NOTHING
    street = "(?:" + "|".join(STREETS[lang]) + ")"
    tail = rf"\s+\d+[A-Za-z]?(?:\s*(?:{UNITS[lang]})\s*\w+)?(?:\s*,\s*{POSTAL}\s+{_FIRST}(?:\s+{_NEXT})*+|\b)"
    if lang == "fr":
        return rf"\b({street}\s+{_FIRST}(?:\s+{_NEXT})*+{tail})"
    return rf"\b{_FIRST}(?:(?:\s+{_NEXT})++((?<=\s{street}){tail})?+)?+"


GENERIC = rf"\b\d{{1,4}}\s+[A-ZÀ-Ý][\w{QUOTES}]++(?:\s+[A-ZÀ-Ýa-zà-ÿ][\w{QUOTES}]++)*+"
#: What GENERIC takes too much at its end: quotes, and last words that without them are a single character.
GENERIC_EXCESS = rf"(?U)(?:\s+\S?[{QUOTES}]*|[{QUOTES}]+)+$"


def sentence_end(lang: str) -> str:
    """Between a sentence's end mark and a next one that begins, after closing quotes and blanks, with a capital."""
    words = "|".join(a[:-1].replace(".", r"\.") for a in ABBREVIATIONS.get(lang, []))
    guard = rf"(?<!(?<![^\s])(?iu:{words})\.)" if words else ""
    return rf"(?U)(?<=[.!?…]){guard}(?=[{CLOSING_QUOTES}]*\s*\p{{IsUppercase}})\s*"


#: Cheaper patterns that any match of a detector contains; they only save work. They look for the rarest character first,
#: and back from there. \p{Nd} and the long s and Kelvin signs are there because the detectors' classes take them, too.
HINTS = {
    "IBAN": r"\p{Nd}(?<=[A-Za-z\u017F\u212A]{2}\p{Nd})\p{Nd}[A-Za-z0-9\u017F\u212A]",
    "BE_RRN": r"\p{Nd}{2}[.\-/]?\p{Nd}{2}[.\-/]?\p{Nd}{2}(?U:\s)*-",
    "YEAR": r"\p{Nd}{4}",
    "DATE_NUMERIC": r"\p{Nd}[./-]\p{Nd}",
    "BORN": r"(?=[BbGgNn])(?iu:born|geboren|n[ée]\(?e)",
    "LIVES": r"(?=[WwVvDdRrLl])(?iu:wonende|woonachtig|verblijvend|domicili|demeurant|residing|living)",
    "GENERIC": r"\p{Nd}(?U:\s)",
}


def address_hint(lang: str) -> str | None:
    if lang not in STREETS:
        return None
    words = "|".join(STREETS[lang])
    return rf"(?U:\s)(?<=(?iu:{words})(?U:\s))" if lang == "fr" else rf"(?=(?U:\s)++\p{{Nd}})(?<=(?iu:{words}))"


def honorific_hint(lang: str) -> str | None:
    """A title as a word of its own."""
    return rf"(?iU)(?=[DM])\b(?:{'|'.join(HONORIFICS[lang])})\s" if lang in HONORIFICS else None
