"""Which texts of a list are covered by other texts, by character grams.

Forms are texts without spaces and punctuation.  One form covers another if it
contains it, is in it, or shares COVERED_RATIO of the smaller one's grams (one
form in another of two characters or more shares them all).  A document's
distinct forms meet through an inverted list of their grams: the lists of a
form's grams, counted together, are its overlaps with all others at once.
Built-in functions could only compare all pairs, so this is an Arrow-batched
function; it sees the forms alone.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from capturelake.functions import rules as R
from capturelake.functions import text as T


def cover_functions(greedy: bool, ratio: float = R.COVERED_RATIO, n: int = 2):
    """The function of one document's forms, and the same of columns of them."""

    # everything is local, so that tasks need no import of this package
    def cover(clauses, texts) -> list[bool]:
        import numpy as np

        def grams(form: str) -> set[str]:
            return {form[i : i + n] for i in range(len(form) - n + 1)} or {form}

        number = {form: k for k, form in enumerate(filter(None, dict.fromkeys([*texts, *clauses])))}
        own = [grams(form) for form in number]
        gram_number: dict[str, int] = {}
        numbered = [[gram_number.setdefault(g, len(gram_number)) for g in gs] for gs in own]
        size = np.array([len(gs) for gs in own], np.int64)
        gram = np.array([g for gs in numbered for g in gs], np.int64)
        form_of = np.repeat(np.arange(len(own)), size)[np.argsort(gram, kind="stable")]
        lists = np.split(form_of, np.cumsum(np.bincount(gram, minlength=len(gram_number)))[:-1]) if len(gram) else []
        there = np.zeros(len(own), bool)
        # forms below the gram size share no gram with a longer one that holds them
        short: set[str] = set()
        parts: set[str] = set()

        def add(form: str) -> None:
            there[number[form]] = True
            parts.update(form[i : i + k] for k in range(1, n) for i in range(len(form) - k + 1))
            if len(form) < n:
                short.add(form)

        def covered(form: str) -> bool:
            if not form or there[number[form]] or form in parts or any(s in form for s in short):
                return True
            k = number[form]
            shared = np.bincount(np.concatenate([lists[g] for g in numbered[k]]), minlength=len(own))
            return bool((there & (shared / np.minimum(size, size[k]) >= ratio)).any())

        for form in filter(None, texts):
            add(form)
        found = []
        for form in clauses:
            found.append(covered(form))
            if greedy and not found[-1]:
                add(form)
        return found

    def flags(clauses, texts):
        import pandas as pd

        return pd.Series(
            [
                None if c is None else cover([f or "" for f in c], [f or "" for f in ([] if t is None else t)])
                for c, t in zip(clauses, texts, strict=True)
            ],
            dtype=object,
        )

    flags.__annotations__ = {"clauses": pd.Series, "texts": pd.Series, "return": pd.Series}
    return cover, flags


def forms(texts: Column) -> Column:
    """Texts of an array in the form in which they are compared."""
    return F.transform(texts, lambda t: T.normalize_for_match(F.coalesce(t, F.lit(""))))


def covered_flags(clauses: Column, texts: Column) -> Column:
    """For each clause whether one of the texts covers it; null for a null list."""
    return F.pandas_udf(cover_functions(False)[1], "array<boolean>")(forms(clauses), forms(texts))


def covered_in_order(clauses: Column, texts: Column) -> Column:
    """The same where a clause that is not covered joins the texts before the next is judged."""
    return F.pandas_udf(cover_functions(True)[1], "array<boolean>")(forms(clauses), forms(texts))
