"""Normalisation of single listing fields; every function is Column to Column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.schema import FX_RATES, MONEY

#: Spellings of currencies.
CURRENCY_NAMES = {"$": "USD", "US": "USD", "USD": "USD", "€": "EUR", "EUR": "EUR", "ГРН": "UAH", "ГРН.": "UAH", "UAH": "UAH"}
#: Spellings of cities.
CITY_NAMES = {
    "kyiv": ["киев", "київ"],
    "lviv": ["львов", "львів"],
    "odesa": ["одесса", "одеса"],
    "dnipro": ["днепр", "дніпро", "днепропетровск", "дніпропетровськ"],
    "kharkiv": ["харьков", "харків"],
}


def lookup(mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def first_filled(*cols: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def harmonise(df: DataFrame) -> DataFrame:
    """Fill each of a pair of equivalent columns from the other."""
    out = {}
    for a, b in (("description", "raw_text"), ("seller", "seller_name")):
        out[a], out[b] = first_filled(F.col(a), F.col(b)), first_filled(F.col(b), F.col(a))
    empty = F.array().cast("array<string>")
    for a, b in (("images", "image_urls"), ("image_urls", "images")):
        out[a] = F.when(F.size(F.coalesce(F.col(a), empty)) > 0, F.col(a)).otherwise(F.col(b))
    return df.withColumns(out)


def phone(col: Column) -> Column:
    """A telephone number as ``+380...``; other digits as ``+digits``; null without digits."""
    digits = F.regexp_replace(col, "\\D", "")
    n = F.length(digits)
    return (
        F.when(n == 0, F.lit(None).cast("string"))
        .when(digits.startswith("380") & (n == 12), F.concat(F.lit("+"), digits))
        .when(digits.startswith("0") & (n == 10), F.concat(F.lit("+38"), digits))
        .when(n == 9, F.concat(F.lit("+380"), digits))
        .otherwise(F.concat(F.lit("+"), digits))
    )


def image_list(col: Column) -> Column:
    """Trimmed, without blanks and repeats, in order."""
    trimmed = F.transform(F.coalesce(col, F.array().cast("array<string>")), lambda x: F.trim(x))
    return F.array_distinct(F.filter(trimmed, lambda x: x.isNotNull() & (x != "")))


def currency(col: Column) -> Column:
    """A currency code; unknown spellings in upper case, dollars for nothing."""
    given = F.upper(F.trim(col))
    return F.when(F.coalesce(col, F.lit("")) == "", F.lit("USD")).otherwise(F.coalesce(F.element_at(lookup(CURRENCY_NAMES), given), given))


def to_usd(price: Column, code: Column) -> Column:
    """The price in dollars, rounded half up to cents."""
    rate = F.coalesce(F.element_at(lookup(FX_RATES), F.upper(F.coalesce(code, F.lit("USD")))), F.lit("1.0")).cast("decimal(10,4)")
    return F.round(price.cast(MONEY) * rate, 2).cast(MONEY)


def city_segment(col: Column) -> Column:
    """What stands before the first separator; null when blank."""
    return F.nullif(F.trim(F.get(F.split(col, "[,/|;]"), F.lit(0))), F.lit(""))


def city_name(col: Column) -> Column:
    """A city in lower case, without a settlement word, known spellings as one name."""
    plain = F.trim(F.regexp_replace(F.trim(F.lower(col)), "^(?:м\\.|г\\.|город|місто)\\s*", ""))
    names = {s: name for name, spellings in CITY_NAMES.items() for s in spellings}
    return F.coalesce(F.element_at(lookup(names), plain), plain)


def mileage_bucket(col: Column) -> Column:
    """Kilometres rounded down to ten thousands, as text; a placeholder for nothing or zero."""
    return F.when(col > 0, (F.floor(col / 10_000) * 10_000).cast("string")).otherwise(F.lit("UNKNOWN_MILEAGE"))
