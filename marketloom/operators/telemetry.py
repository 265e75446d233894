"""Run telemetry: counters and states of each source, totals, and runs of failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def run_status(errors: Column, scanned: Column, own: Column | None = None) -> Column:
    """The status of a run; an extractor's own final status wins."""
    computed = F.when((errors > 0) & (scanned > 0), "PARTIAL").when(errors > 0, "FAILED").otherwise("SUCCESS")
    return computed if own is None else F.when(own.isin("FAILED", "DEGRADED", "PARTIAL"), own).otherwise(computed)


COUNTERS = ["scanned", "matched_filter", "new", "updated", "duplicates", "notified", "errors"]


def run_counters(items: DataFrame, *keys: str) -> DataFrame:
    """Counters of each source from items with ``is_error``, ``status``, ``action``, ``is_price_drop`` and ``is_notified``.

    Updated are price drops only; all other observations of known listings count as duplicates.
    """
    fine = ~F.coalesce("is_error", F.lit(False))
    passed = fine & (F.coalesce(F.col("status"), F.lit("")) != "REJECT")
    drop = F.coalesce("is_price_drop", F.lit(False))
    out = items.groupBy(*keys).agg(
        F.count("*").alias("scanned"), F.count_if(passed).alias("matched_filter"), F.count_if(passed & (F.col("action") == "CREATED")).alias("new"), F.count_if(passed & drop).alias("updated"),
        F.count_if(passed & ~drop & (F.col("action") != "CREATED")).alias("duplicates"), F.count_if(passed & F.coalesce("is_notified", F.lit(False))).alias("notified"), F.count_if(~fine).alias("errors"),
    )
    return out.withColumn("status", run_status(F.col("errors"), F.col("scanned") - F.col("errors")))


def totals(counters: DataFrame, key: str = "source") -> DataFrame:
    """The counters of each source and a row of totals, whose ``key`` is null."""
    return counters.rollup(key).agg(*[F.sum(c).alias(c) for c in COUNTERS])


def page_state(status_code: Column, body: Column) -> Column:
    """OK, or DEGRADED for a refused request or a login wall."""
    refused = status_code.isin(401, 403, 429, 302)
    wall = body.contains("/accounts/login/") | body.contains("Login • Instagram") | body.contains("<!DOCTYPE html>")
    return F.when(F.coalesce(refused, F.lit(False)) | F.coalesce(wall, F.lit(False)), "DEGRADED").otherwise("OK")


def failure_islands(df: DataFrame, keys: list[str], order: list[str], ok: Column) -> DataFrame:
    """Add ``failures``, the length so far of the current run of failed rows (0 for a good one)."""
    seen = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    island = df.withColumn("_ok", ok).withColumn("_island", F.sum(F.col("_ok").cast("int")).over(seen))
    inside = Window.partitionBy(*keys, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return island.withColumn("failures", F.when(F.col("_ok"), 0).otherwise(F.sum((~F.col("_ok")).cast("int")).over(inside))).drop("_ok", "_island")


def until_stopped(df: DataFrame, keys: list[str], order: list[str], ok: Column, most: int = 3) -> DataFrame:
    """The rows that are read before, and with, the ``most``-th failure in a row."""
    seen = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    counted = failure_islands(df, keys, order, ok)
    stopped = F.coalesce(F.max((F.col("failures") >= most).cast("int")).over(seen), F.lit(0))
    return counted.withColumn("_stopped", stopped).where("_stopped = 0").drop("_stopped")
