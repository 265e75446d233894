"""Users' texts and commands, folded into their saved filters."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from marketloom.functions.canonical import let
from marketloom.functions.text import matches, pattern
from marketloom.operators.history import in_key_order, key_starts, last_key
from marketloom.schema import FILTER_DEFAULTS

#: Texts that lift a bound, words of mileage, presets and keyboard codes.
RESET_PRICE = ["0", "скинути", "скинь", "будь-яка", "будь яка", "люба", "все", "reset", "none"]
RESET_MILEAGE = ["0", "скинути", "скинь", "будь-який", "будь який", "любий", "все", "reset", "none"]
MILEAGE_WORDS = ["пробіг", "пробег", "км"]
YEAR_PRESETS = {"dorest": (1997, 2001), "rest": (2001, 2005)}
ALL_YEARS = (1997, 2005)
MODEL_CODES = {"A6C5": "A6 C5", "A6C6": "A6 C6", "A6C7": "A6 C7", "A6C4": "A6 C4", "A4B6": "A4 B6", "A4B7": "A4 B7", "A4B8": "A4 B8", "A4B5": "A4 B5"}
ENGINE_CODES = {"1.8T": "1.8T", "2.4": "2.4", "1.9TDI": "1.9 TDI"}

#: Patterns of numbers in typed texts.
_THOUSANDS = r"(\d+(?:\.\d+)?)\s*[kк]\b"
_RANGE = r"(\d{3,6})\s*(?:-|—|–|\.\.|/|to|до)\s*(\d{3,6})"
_NUMBER = r"\b(\d{3,6})\b"
_LEAST, _MOST = r"(?:від|от|>|\+)\s*(\d{3,6})", r"(?:до|<)\s*(\d{3,6})"
_MILEAGE_THOUSANDS = r"(\d+(?:[.,]\d+)?)\s*(?:тис|тыс|тис\.|тыс\.|[kк])\b"
_MILEAGE_NEAR = r"(?:пробіг|пробег|км)?[:\s]*(\d[\d\s]{4,7})\s*(?:км)?"


def _with_thousands(text: Column) -> Column:
    """``3.5k`` as ``3500``, wherever a number with k stands: what is between these numbers, and each of them in full."""
    between = F.split(text, pattern(_THOUSANDS), -1)
    whole = F.regexp_extract_all(text, F.lit(pattern(_THOUSANDS)), F.lit(0))
    numbers = F.regexp_extract_all(text, F.lit(pattern(_THOUSANDS)), F.lit(1))
    full = F.zip_with(numbers, whole, lambda n, w: F.coalesce(F.floor(n.try_cast("decimal(12,4)") * 1000).cast("string"), w))
    return F.array_join(F.zip_with(between, full, lambda x, n: F.concat(x, F.coalesce(n, F.lit("")))), "")


def price_bounds(text: Column) -> Column:
    """``recognised``, ``min_price`` and ``max_price`` of a typed price."""
    clean = F.lower(F.trim(text))
    return let(F.struct(clean.alias("clean"), _with_thousands(clean).alias("plain")), lambda x: _price_of(x["clean"], x["plain"]))


def _price_of(clean: Column, plain: Column) -> Column:
    none = F.lit(None).cast("int")

    def result(low: Column, high: Column) -> Column:
        return F.struct(F.lit(True).alias("recognised"), low.cast("int").alias("min_price"), high.cast("int").alias("max_price"))

    def group(p: str, i: int) -> Column:
        return F.regexp_extract(plain, pattern(p), i).try_cast("int")

    numbers = F.transform(F.regexp_extract_all(plain, F.lit(pattern(_NUMBER)), F.lit(1)), lambda x: x.try_cast("int"))
    low, high = group(_RANGE, 1), group(_RANGE, 2)
    first, second = F.get(numbers, F.lit(0)), F.get(numbers, F.lit(1))
    least, most = group(_LEAST, 1), group(_MOST, 1)
    return (
        F.when(clean.isin(RESET_PRICE), result(none, none))
        .when(low.isNotNull(), result(F.least(low, high), F.greatest(low, high)))
        .when(F.size(numbers) == 2, result(F.least(first, second), F.greatest(first, second)))
        .when(least.isNotNull(), result(least, none))
        .when(most.isNotNull(), result(none, most))
        .when(F.size(numbers) == 1, result(none, first))
        .otherwise(F.struct(F.lit(False).alias("recognised"), none.alias("min_price"), none.alias("max_price")))
    )


def mileage_bound(text: Column) -> Column:
    """``recognised`` and ``max_mileage`` of a typed mileage."""
    return let(F.lower(F.trim(text)), _mileage_of)


def _mileage_of(clean: Column) -> Column:
    none = F.lit(None).cast("int")
    thousands = F.translate(F.regexp_extract(clean, pattern(_MILEAGE_THOUSANDS), 1), ",", ".").try_cast("decimal(12,4)")
    near = F.regexp_replace(F.regexp_extract(clean, pattern(_MILEAGE_NEAR), 1), "\\s+", "").try_cast("long")
    context = matches(clean, "|".join(MILEAGE_WORDS))
    digits = F.regexp_replace(clean, "\\D", "").try_cast("long")

    def result(value: Column) -> Column:
        return F.struct(F.lit(True).alias("recognised"), value.cast("int").alias("max_mileage"))

    return (
        F.when(clean.isin(RESET_MILEAGE), result(none))
        .when(thousands.isNotNull(), result(F.floor(thousands * 1000)))
        .when(context & near.between(10_000, 1_000_000), result(near))
        .when(digits.between(50, 999), result(digits * 1000))
        .when(digits.between(10_000, 1_000_000), result(digits))
        .otherwise(F.struct(F.lit(False).alias("recognised"), none.alias("max_mileage")))
    )


def intent(text: Column, awaiting: Column | None = None) -> Column:
    """Where a free text goes: ``op`` (set_mileage, set_price or none) with its bounds."""
    context = matches(F.lower(text), "|".join(MILEAGE_WORDS))
    if awaiting is not None:
        context = context | F.coalesce(awaiting == "awaiting_mileage", F.lit(False))
    parsed = F.struct(price_bounds(text).alias("price"), mileage_bound(text).alias("mileage"), context.alias("context"))
    return let(parsed, lambda x: _intent_of(x["price"], x["mileage"], x["context"]))


def _intent_of(price: Column, mileage: Column, context: Column) -> Column:
    none = F.lit(None).cast("int")

    def result(op: str, low: Column, high: Column, most: Column) -> Column:
        return F.struct(F.lit(op).alias("op"), low.alias("min_price"), high.alias("max_price"), most.alias("max_mileage"))

    return (
        F.when(context & mileage["recognised"], result("set_mileage", none, none, mileage["max_mileage"]))
        .when(price["recognised"], result("set_price", price["min_price"], price["max_price"], none))
        .when(mileage["recognised"] & (mileage["max_mileage"] >= 50_000), result("set_mileage", none, none, mileage["max_mileage"]))
        .otherwise(result("none", none, none, none))
    )


def defaults() -> dict[str, Column]:
    """A filter before any command, as literal columns."""
    kinds = {"selected_models": "array<string>", "engines": "array<string>", "transmission": "string", "drive_type": "string", "body_type": "string", "exclude_damaged": "boolean"}
    return {c: (F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v)).cast(kinds.get(c, "int")) for c, v in FILTER_DEFAULTS.items()}


#: The columns of a filter, without its chat.
FIELDS = list(FILTER_DEFAULTS)


def apply_command(now: dict, kind: str | None, arg: str | None, i: dict | None) -> dict:
    """The filter ``now`` after one command; ``i``: the intent of a text. A toggle that would leave nothing selected is refused."""
    if kind == "action_reset":
        return dict(FILTER_DEFAULTS)
    if kind in ("toggle_model", "toggle_eng"):
        name, codes = ("selected_models", MODEL_CODES) if kind == "toggle_model" else ("engines", ENGINE_CODES)
        item, have = codes.get(arg, arg), now[name]
        if item not in have:
            return now | {name: [*have, item]}
        return now if len(have) == 1 else now | {name: [x for x in have if x != item]}
    if kind == "set_year":
        low, high = YEAR_PRESETS.get(arg, ALL_YEARS)
        return now | {"min_year": low, "max_year": high}
    if kind == "text" and i["op"] == "set_price":
        return now | {"min_price": i["min_price"], "max_price": i["max_price"]}
    if kind == "text" and i["op"] == "set_mileage":
        return now | {"max_mileage": i["max_mileage"]}
    lifted = {"reset_price": {"min_price": None, "max_price": None}, "reset_mileage": {"max_mileage": None}}
    if kind in lifted:
        return now | lifted[kind]
    chosen = {"set_trans": "transmission", "set_drive": "drive_type", "set_body": "body_type"}
    if kind in chosen:
        return now | {chosen[kind]: arg}
    return now | {"exclude_damaged": not now["exclude_damaged"]} if kind == "toggle_cond" else now


def fold_commands(log: DataFrame) -> DataFrame:
    """The filter of each ``chat_id`` after its commands (``chat_id``, ``seq``, ``kind``, ``arg``) in order of ``seq``.

    A toggle that would leave nothing selected is refused. Kinds: text, toggle_model, toggle_eng, set_trans, set_drive,
    set_body, set_year, toggle_cond, reset_price, reset_mileage, action_reset; others change nothing.
    """
    parsed = log.withColumn("i", F.when(F.col("kind") == "text", intent(F.col("arg"))))
    # the intent is computed where the rows are, before they are brought together by user
    source = in_key_order(parsed.select("chat_id", "seq", "kind", "arg", "i"), ["chat_id"], ["seq", "kind", "arg"])
    fields = parsed.select("chat_id").limit(0).withColumns(defaults()).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, chat, now = None, None, None
        names = [f.name for f in fields]
        kinds = to_arrow_schema(fields)

        def rows(done: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([d[n] for d in done], kinds.field(n).type) for n in names], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            done = []
            columns = (batch.column(c).to_pylist() for c in ("chat_id", "kind", "arg", "i"))
            for new, who, kind, arg, i in zip(key_starts(batch, last), *columns):
                if new:
                    if now is not None:
                        done.append({"chat_id": chat} | now)
                    chat, now = who, dict(FILTER_DEFAULTS)
                now = apply_command(now, kind, arg, i)
            last = last_key(batch)
            if done:
                yield rows(done)
        if now is not None:
            yield rows([{"chat_id": chat} | now])

    return source.mapInArrow(run, fields)


def get_or_create(filters: DataFrame, chats: DataFrame) -> DataFrame:
    """``filters`` with a default row for every chat that has none."""
    new = chats.select("chat_id").distinct().join(filters.select("chat_id"), "chat_id", "left_anti")
    return filters.unionByName(new.withColumns(defaults()).select(*filters.columns))


def overlay(filters: DataFrame, changes: DataFrame) -> DataFrame:
    """Set the non-null columns of ``changes`` in the filters of the same chat."""
    names = [c for c in filters.columns if c != "chat_id"]
    joined = filters.join(changes.select("chat_id", *[F.col(c).alias(f"_{c}") for c in names if c in changes.columns]), "chat_id", "left")
    return joined.select("chat_id", *[F.coalesce(f"_{c}", c).alias(c) if c in changes.columns else F.col(c) for c in names])
