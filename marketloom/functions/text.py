"""Text passes: compatibility normalisation, cleaning, look-alike letters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cyrillic letters that look like Latin ones, and those.
LOOKALIKES_FROM = "АВСЕКМНОРТУХІавсекмнортухі"
LOOKALIKES_TO = "ABCEKMHOPTYXIabcekmhoptyxi"

#: Prefix of every pattern: case folding, ``\w`` and ``\b`` for all scripts, as Java needs to be told.
UNICODE = "(?iuU)"


def pattern(text: str) -> str:
    return UNICODE + text


def matches(col: Column | str, text: str) -> Column:
    """Whether the pattern occurs; false for null."""
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(col.rlike(pattern(text)), F.lit(False))


def matches_lower(col: Column, text: str) -> Column:
    """Whether a lower-case pattern occurs in text that is in lower case already, which is faster; false for null."""
    return F.coalesce(col.rlike("(?U)" + text), F.lit(False))


def contains_any(col: Column, words: list[str]) -> Column:
    """Whether any of the words is a substring; ``col`` is in the case that the words are in."""
    found = F.lit(False)
    for w in words:
        found = found | col.contains(w)
    return F.coalesce(found, F.lit(False))


def nfkc(col: Column) -> Column:
    """Unicode NFKC of text outside ASCII, by the ICU library that Spark ships; it leaves ASCII as it is."""
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), col, F.lit(True))
    return F.when(col.rlike("[^\\x00-\\x7F]"), composed).otherwise(col)


def clean_text(col: Column, compatibility: bool = True) -> Column:
    """Invisible characters out, decimal commas as points, white space as single spaces, trimmed; null as empty.

    ``compatibility`` applies NFKC first; leave it off for text known to be normalised.
    """
    col = F.coalesce(col, F.lit(""))
    if compatibility:
        col = nfkc(col)
    col = F.regexp_replace(col, "[\\u200B\\uFEFF\\u200E\\u200F\\u202A-\\u202E]", "")
    col = F.regexp_replace(col, "(\\d+),(\\d+)", "$1.$2")
    return F.trim(F.regexp_replace(col, "(?U)\\s+", " "))


def semantic_text(col: Column, compatibility: bool = True) -> Column:
    """Cleaned text in lower case, letters untouched."""
    return F.lower(clean_text(col, compatibility))


def fold_lookalikes(col: Column) -> Column:
    """Every look-alike letter as its Latin twin."""
    return F.translate(col, LOOKALIKES_FROM, LOOKALIKES_TO)


def fold_identifiers(col: Column) -> Column:
    """Look-alike letters as Latin inside vehicle identifiers only (A6, C4-C8, 4B, 1.8T, 2.7T)."""
    given = col
    classes = [("а", "А", "a", "A", "", "6"), ("с", "С", "c", "C", "", "[4-8]"), ("в", "В", "b", "B", "4", ""), ("т", "Т", "t", "T", "1\\.8", ""), ("т", "Т", "t", "T", "2\\.7", "")]
    for small, big, to_small, to_big, before, after in classes:
        for letter, to in ((small, to_small), (big, to_big)):
            col = F.regexp_replace(col, f"(?U)\\b({before}){letter}({after})\\b", f"$1{to}$2")
    return F.when(given.rlike("[аАсСвВтТ]"), col).otherwise(given)
