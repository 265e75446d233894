"""Keyed state of live streams: price versions and saved filters, by ``transformWithState``."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from marketloom.operators.commands import FIELDS, apply_command, intent
from marketloom.schema import FILTER_DEFAULTS, MONEY

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_on_disk(spark: SparkSession) -> None:
    """State in RocksDB, which ``transformWithState`` asks for and which is not bounded by an executor's heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def version_row(keys: list[str], order: list[str]) -> Row:
    """The row of a recorded version, to be called with its values."""
    return Row(*keys, *order, "version", "change_type", "_price", "_diff")


class PriceTracker(StatefulProcessor):
    """The recorded price in cents and the number of versions of each listing; with ``idle_ms`` forgotten when not seen for so long."""

    def __init__(self, keys: list[str], order: list[str], least: int, idle_ms: int | None):
        self.keys, self.order, self.least, self.idle_ms = keys, order, least, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("recorded", "cents long, versions int", ttlDurationMs=self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        cents, versions = self.state.get() if self.state.exists() else (None, 0)
        made = version_row(self.keys, self.order)
        for row in sorted(rows, key=lambda r: tuple(r[c] for c in self.order)):  # one key's rows of one trigger
            seen = row["_cents"]
            diff = 0 if seen is None or cents is None else seen - cents
            if versions and (seen is None or cents is not None and abs(diff) < self.least):
                continue
            kind = "INITIAL" if not versions else "PRICE_SET" if cents is None else "PRICE_DROP" if diff < 0 else "PRICE_INCREASE"
            yield made(*key, *(row[c] for c in self.order), versions, kind, seen or 0, diff)
            cents, versions = seen, versions + 1
        self.state.update((cents, versions))

    def close(self) -> None:
        pass


def price_versions(stream: DataFrame, keys: list[str], order: list[str], price: str = "price", threshold: str = "1.0", idle_ms: int | None = None) -> DataFrame:
    """The recorded versions of a stream of observations, as they arise: ``keys``, ``order``, ``version``, ``change_type``, ``price``, ``price_diff``.

    Over all triggers this is what :func:`marketloom.operators.history.fold_prices` records, if triggers come in order; the
    rows of one trigger may come in any order. All sums are in cents.
    """
    keep_state_on_disk(stream.sparkSession)
    source = stream.select(*keys, *order, (F.col(price).cast(MONEY) * 100).cast("long").alias("_cents"))
    fields = [*(source.schema[c] for c in (*keys, *order)), T.StructField("version", T.IntegerType()), T.StructField("change_type", T.StringType()), T.StructField("_price", T.LongType()), T.StructField("_diff", T.LongType())]
    tracker = PriceTracker(keys, order, round(float(threshold) * 100), idle_ms)
    out = source.groupBy(*keys).transformWithState(tracker, T.StructType(fields), "append", "processingTime" if idle_ms else "none")
    money = lambda c: (F.col(c).cast("decimal(20,0)") / 100).cast(MONEY)
    return out.select(*keys, *order, "version", "change_type", money("_price").alias("price"), money("_diff").alias("price_diff"))


class FilterKeeper(StatefulProcessor):
    """Each chat's filter, and the last update that changed it: updates that come again are not applied again."""

    def __init__(self, order: list[str]):
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("filter", "settings string, last string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now, last = dict(FILTER_DEFAULTS), None
        if self.state.exists():
            settings, seen = self.state.get()
            now, last = json.loads(settings), tuple(json.loads(seen))
        for row in sorted(rows, key=lambda r: tuple(r[c] for c in self.order)):
            at = tuple(row[c] for c in self.order)
            if last is None or at > last:
                now, last = apply_command(now, row["kind"], row["arg"], row["i"]), at
        self.state.update((json.dumps(now), json.dumps(last)))
        yield Row("chat_id", *FIELDS)(key[0], *(now[name] for name in FIELDS))

    def close(self) -> None:
        pass


def saved_filters(log: DataFrame, order: list[str]) -> DataFrame:
    """The filter of each chat that a trigger has commands of (``chat_id``, ``kind``, ``arg`` and the numbers of ``order``), after them.

    For an upsert into a table keyed by ``chat_id``. ``order`` are numbers that rise from update to update of a chat; an update that
    is not beyond the last one applied was applied before.
    """
    keep_state_on_disk(log.sparkSession)
    source = log.select("chat_id", *order, "kind", "arg", F.when(F.col("kind") == "text", intent(F.col("arg"))).alias("i"))
    return source.groupBy("chat_id").transformWithState(FilterKeeper(order), FILTER_STRUCT, "update", "none")


_LISTS = T.ArrayType(T.StringType())
_KINDS = {"selected_models": _LISTS, "engines": _LISTS, "transmission": T.StringType(), "drive_type": T.StringType(), "body_type": T.StringType(), "exclude_damaged": T.BooleanType()}
FILTER_STRUCT = T.StructType([T.StructField("chat_id", T.StringType()), *(T.StructField(n, _KINDS.get(n, T.IntegerType())) for n in FIELDS)])
