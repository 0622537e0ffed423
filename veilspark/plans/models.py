"""Language models: a provider answers prompts; its answers become columns that filtered() reads."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.functions import prompts

#: The columns that answered() adds, in the order that filtered(answers=...) takes.
ANSWERS = ("phone_answer", "birth_answer", "person_answer")


def answered(docs: DataFrame, provider: Callable[[str, str], str], text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` with a model's answers to the three questions about each text.

    ``provider(system, user)`` returns the model's answer as text. It is called in the executors, once for each text and
    question; where it fails the answer is null, which finds nothing. Null and empty texts are not asked about.
    """
    tasks = tuple(prompts.TASKS)
    asked = docs.select("*", *(F.when(F.length(text) > 0, prompts.user(t, F.col(text), F.col(lang))).alias(a) for t, a in zip(tasks, ANSWERS)))

    def answer(task: str, question: str | None) -> str | None:
        if question is None:
            return None
        try:
            return provider(prompts.system(task), question)
        except Exception:  # whatever a remote service throws: the document goes on without its answer
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{a: [answer(t, q) for q in b[a]] for t, a in zip(tasks, ANSWERS)})

    return asked.mapInPandas(run, asked.schema)
