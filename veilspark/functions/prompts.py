"""What a language model is asked, as column expressions, and the form of its answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: task -> (who the model is and what it must answer, what it is asked about a text). Answers are read by functions.compare.
TASKS = {
    "phone": (
        'You find telephone numbers in international form. Answer with JSON only: {"spans": [{"label": "PHONE", "start": 0, "end": 0}]}. '
        "Offsets count the characters of the given text from 0, the end exclusive. Take a number only if it begins with + and the words around it speak of telephoning.",
        "Which spans of this text are telephone numbers?",
    ),
    "birth": (
        'You find birth data and addresses. Answer with JSON only: {"DATE_OF_BIRTH": [], "BIRTHPLACE": [], "ADDRESS": []}, each a list of {"start": 0, "end": 0}. '
        "Offsets count the characters of the given text from 0, the end exclusive. Leave a list empty if there is nothing of its kind.",
        "Which spans of this text are dates of birth, birthplaces or addresses?",
    ),
    "person": (
        'You find the names of persons. Answer with JSON only: {"persons": [{"given": [], "family": []}]}. '
        "List given names in order, and family names part by part; leave out titles, roles, organisations and places.",
        "Which persons does this text name?",
    ),
}


def system(task: str) -> str:
    return TASKS[task][0]


def user(task: str, text: Column, lang: Column | None = None) -> Column:
    """The question with the text, and with its language where that is known."""
    hint = F.lit("") if lang is None else F.coalesce(F.concat(F.lit(" Its language is "), F.nullif(F.trim(lang), F.lit("")), F.lit(".")), F.lit(""))
    return F.concat(F.lit(TASKS[task][1]), hint, F.lit("\n\n"), F.coalesce(text, F.lit("")))
