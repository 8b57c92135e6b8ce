"""Text functions as JVM-side column expressions.

Whitespace is spelled out everywhere: the warehouse rules trim Unicode space
separators but collapse only the five ASCII blanks, the page rules follow the
Unicode notion of whitespace, and Java's own ``\\s`` is neither of the two.
"""

from __future__ import annotations

import sys
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE_SEPARATORS = " \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"
ALL_WHITESPACE = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\u2028\u2029" + SPACE_SEPARATORS
_BLANK = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def trim_separators(text: Column) -> Column:
    return F.trim(text, F.lit(SPACE_SEPARATORS))


def collapse_blanks(text: Column) -> Column:
    """Turn runs of ASCII blanks into one space; runs that already are one space do not match."""
    return F.regexp_replace(text, r"[\t\n\f\r][\t\n\f\r ]*| [\t\n\f\r ]+", " ")


def strip_whitespace(text: Column) -> Column:
    return F.trim(text, F.lit(ALL_WHITESPACE))


def collapse_whitespace(text: Column) -> Column:
    """Unicode-whitespace collapse and strip, as page text needs it."""
    return strip_whitespace(F.regexp_replace(text, rf"(?! (?!{_BLANK})){_BLANK}+", " "))


def strip_outer_quotes(text: Column) -> Column:
    return strip_whitespace(F.trim(collapse_whitespace(text), F.lit('"“”')))


def clean_text(raw: Column) -> Column:
    """Normalise blanks and drop trailing footnote marks and quote marks, one pass each.

    Every step reads its input once. Guards around the regexes would read it
    twice, and a filter that Catalyst pushes below this expression would then
    carry a copy of the chain per branch.
    """
    text = collapse_blanks(trim_separators(raw))
    text = F.regexp_replace(text, r"(?<! ) *(?:\[[0-9]+\])++\z", "")
    text = F.regexp_replace(text, r'"\z', "")
    return F.regexp_replace(text, r'"([.!?])\z', "$1")


def has_source_artifacts(text: Column) -> Column:
    return (
        (text.endswith("]") & text.rlike(r"\[[0-9]+\]\z"))
        | text.endswith('"')
        | F.right(text, F.lit(2)).isin('".', '"!', '"?')
    )


def is_citation_only(text: Column) -> Column:
    """A bare reference: plain ASCII words ending in a Roman numeral and page figures."""
    stem = F.rtrim(text, F.lit("0123456789. -"))
    return (
        (F.length(stem) >= 2)
        & F.right(stem, F.lit(1)).isin(*"IVXLCDM")
        & text.rlike(r"^[\p{Alnum} ._-]+\z")
    )


def is_leading_fragment(text: Column) -> Column:
    return text.startswith("...") | text.startswith("(...)")


def section_base(title: Column) -> Column:
    """Section title without its parenthesised suffix, stripped and lower-cased."""
    return F.lower(strip_whitespace(F.regexp_replace(title, rf"(?d)(?<!{_BLANK}){_BLANK}*\(.*?\){_BLANK}*$", "")))


def percent_encoded_title(title: Column) -> Column:
    encoded = F.url_encode(F.replace(title, F.lit(" "), F.lit("_")))
    for found, wanted in (("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        encoded = F.replace(encoded, F.lit(found), F.lit(wanted))
    return encoded


def page_url(title: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), percent_encoded_title(title))


@lru_cache(maxsize=1)
def _fold_exceptions() -> dict[str, str]:
    """Lower-case characters that case folding changes further, from the Unicode tables."""
    found = {}
    for code in range(0x80, sys.maxunicode + 1):
        char = chr(code)
        if char.casefold() != char.lower() and char.lower() == char:
            found[char] = char.casefold()
    return found


def _ranges(chars: dict[str, str], gap: int) -> str:
    """A short character class that covers the characters and gaps of up to ``gap`` between them."""
    spans: list[list[int]] = []
    for code in sorted(map(ord, chars)):
        if spans and code - spans[-1][1] <= gap:
            spans[-1][1] = code
        else:
            spans.append([code, code])
    return "[" + "".join(f"\\x{{{low:x}}}-\\x{{{high:x}}}" for low, high in spans) + "]"


def casefold(text: Column) -> Column:
    """Unicode case folding: ``lower`` plus the characters that fold further.

    Sharp s, the one that ordinary text has, is replaced outright. Texts with
    characters near the others are translated, and those near a character that
    folds to several, such as a ligature, are taken apart; both are exact for
    any text, so the guards may be wider than need be.
    """
    exceptions = {char: folded for char, folded in _fold_exceptions().items() if char != "\u00df"}
    single = {char: folded for char, folded in exceptions.items() if len(folded) == 1}
    longer = {char: folded for char, folded in exceptions.items() if len(folded) > 1}
    lowered = F.replace(F.lower(text), F.lit("\u00df"), F.lit("ss"))
    translated = F.translate(lowered, "".join(single), "".join(single.values()))
    table = F.create_map(*[F.lit(part) for pair in longer.items() for part in pair])
    rebuilt = F.concat_ws("", F.transform(F.split(translated, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)))
    return (
        F.when(~lowered.rlike(_ranges(exceptions, 1024)), lowered)
        .when(~lowered.rlike(_ranges(longer, 16)), translated)
        .otherwise(rebuilt)
    )


def comparison_key(text: Column) -> Column:
    return collapse_whitespace(casefold(text))
