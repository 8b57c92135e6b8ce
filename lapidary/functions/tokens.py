"""Search tokens: accent-folded, lower-cased runs of letters and digits."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def _accent_pairs() -> tuple[str, str]:
    """Latin, Greek and Cyrillic letters that decompose to a base letter and marks."""
    accented, plain = [], []
    for code in [*range(0xC0, 0x530), *range(0x1E00, 0x2000)]:
        char = chr(code)
        decomposed = unicodedata.normalize("NFD", char)
        if len(decomposed) > 1 and all(unicodedata.combining(mark) for mark in decomposed[1:]):
            accented.append(char)
            plain.append(decomposed[0])
    return "".join(accented), "".join(plain)


def fold_accents(text: Column) -> Column:
    accented, plain = _accent_pairs()
    bare = F.when(text.rlike(r"\p{Mn}"), F.regexp_replace(text, r"\p{Mn}+", "")).otherwise(text)
    return F.translate(bare, accented, plain)


def token_list(text: Column) -> Column:
    """Distinct tokens of a text."""
    return F.array_distinct(
        F.array_remove(F.split(F.lower(fold_accents(text)), r"[^\p{L}\p{N}\p{Co}]+"), "")
    )
