"""Whole-word term lists as one regular expression each."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain(term: str) -> str:
    left = "".join(c for c in unicodedata.normalize("NFKD", term) if not unicodedata.combining(c))
    return re.sub(r"\s+", " ", left.lower()).strip()


def term_regex(terms, boundary: str = "word") -> str | None:
    """One alternation of all terms, or None without terms.

    ``word`` asks for a word boundary at both ends, ``alnum`` for no letter or digit
    beyond an end of a term that is itself one, so that ``c++`` and ``.net`` work.
    """
    made = []
    for term in map(plain, terms or ()):
        if not term:
            continue
        quoted = re.sub(r"([^\w\s])", r"\\\1", term)
        if boundary == "word":
            made.append(rf"\b{quoted}\b")
        else:
            left = r"(?<![a-z0-9])" if re.match("[a-z0-9]", term) else ""
            right = r"(?![a-z0-9])" if re.search("[a-z0-9]$", term) else ""
            made.append(f"{left}{quoted}{right}")
    return ("(?U)" if boundary == "word" else "") + "|".join(made) if made else None


def any_term(normal: Column, terms, boundary: str = "word", empty: bool = False) -> Column:
    """Whether normalised text holds a term; ``empty`` is the answer for an empty list."""
    pattern = term_regex(terms, boundary)
    return F.lit(empty) if pattern is None else normal.rlike(pattern)


def any_substring(normal: Column, terms) -> Column:
    found = F.lit(False)
    for term in map(plain, terms or ()):
        if term:
            found = found | normal.contains(term)
    return found
