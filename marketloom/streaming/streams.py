"""Structured Streaming forms of the stateful operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marketloom.operators.dedup import deduplicate
from marketloom.operators.quality import upsert
from marketloom.sources.landing import message_images


def distinct_within(stream: DataFrame, keys: list[str], event_time: str, horizon: str) -> DataFrame:
    """The first row of each key within a horizon of event time; state is dropped after it."""
    return stream.withWatermark(event_time, horizon).dropDuplicatesWithinWatermark(keys)


def windowed_rollup(stream: DataFrame, event_time: str, value: str, keys: list[str], length: str = "1 hour", slide: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """Count, sum and extremes of ``value`` in tumbling or sliding windows of event time; later rows are dropped."""
    at = stream.withWatermark(event_time, lateness) if stream.isStreaming else stream
    window = F.window(event_time, length, slide) if slide else F.window(event_time, length)
    out = at.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(F.col(value).cast("decimal(18,4)")).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "total", "least", "most")


def album_sessions(messages: DataFrame, gap: str = "2 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Albums of a message stream: a session of messages of one group; photos after the watermark are dropped."""
    at = messages.withColumn("photos", message_images(messages))
    at = at.withWatermark("date", lateness) if messages.isStreaming else at
    caption = F.struct(F.trim("message").alias("text"), "date")
    filled = F.trim(F.coalesce("message", F.lit(""))) != ""
    return at.groupBy(F.session_window("date", gap).alias("w"), "channel", "grouped_id").agg(
        F.min("id").alias("id"), F.count("*").alias("n_messages"), F.coalesce(F.min_by(caption, F.when(filled, F.col("seq"))), F.min_by(caption, "seq")).alias("caption"),
        F.slice(F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("seq", "photos"))), lambda x: x["photos"]))), 1, 10).alias("images"),
    )


CHANGES = "listing string, version int, change_type string, price double, price_diff double, at long"


def track_prices(stream: DataFrame, threshold: float = 1.0, idle: str | None = None) -> DataFrame:
    """Price versions of a stream (``listing``, ``at``, ``price``): an ordered fold against the last recorded price.

    State is the recorded price in cents and the number of versions. Rows of one trigger are taken in the order of ``at``;
    the result over all triggers is that of the batch fold when rows arrive in that order. With ``idle`` (say "90 days") a listing
    not seen for that long is forgotten, so state is bounded by what is on the market.
    """
    least = round(threshold * 100)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        cents, versions = state.get if state.exists else (None, 0)
        rows = pd.concat(list(frames)).sort_values("at", kind="stable")
        out = []
        for at, seen in zip(rows["at"], rows["price"]):
            seen = None if pd.isna(seen) else round(float(seen) * 100)
            diff = 0 if seen is None or cents is None else seen - cents
            if versions and (seen is None or cents is not None and abs(diff) < least):
                continue
            kind = "INITIAL" if versions == 0 else "PRICE_SET" if cents is None else "PRICE_DROP" if diff < 0 else "PRICE_INCREASE"
            out.append((key[0], versions, kind, (seen or 0) / 100, diff / 100, int(at)))
            cents, versions = seen, versions + 1
        state.update((cents, versions))
        if idle:
            state.setTimeoutDuration(idle)
        yield pd.DataFrame(out, columns=["listing", "version", "change_type", "price", "price_diff", "at"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return stream.groupBy("listing").applyInPandasWithState(step, CHANGES, "cents long, versions int", "append", timeout)


#: What a later observation of a known listing refreshes.
REFRESHED = ("price", "price_usd", "currency", "mileage", "last_checked_at")


def snapshot_writer(spark, path: str, order: list[str], keys: tuple[str, ...] = ("source", "source_id"), refreshed: tuple[str, ...] = REFRESHED) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: each micro-batch is deduplicated against the snapshot at ``path`` and merged into it.

    New listings are added; an observation of a known one refreshes those of its ``refreshed`` columns that it fills.
    Snapshots are versioned folders ``v=<batch>``; a batch that runs again writes the same folder, so a restart gives no
    duplicates. The newest older folder is the store.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        jvm = batch.sparkSession.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(path)
        fs = root.getFileSystem(batch.sparkSession.sparkContext._jsc.hadoopConfiguration())
        older = sorted(int(f.getPath().getName()[2:]) for f in fs.listStatus(root) if f.getPath().getName().startswith("v=")) if fs.exists(root) else []
        older = [v for v in older if v < batch_id]
        store = batch.sparkSession.read.parquet(f"{path}/v={older[-1]}") if older else None
        known = None if store is None else store.withColumn("duplicate_of_id", F.col("duplicate_of_id").cast("long"))
        new = deduplicate(batch, order, known, keys)
        rows = new.where("is_insert").select(*batch.columns, "dedup_level", F.coalesce(F.col("root.id"), F.xxhash64(*[F.col(f"root.{c}") for c in order])).alias("root_id"), F.xxhash64(*[F.col(c) for c in order]).alias("id"))
        rows = rows.withColumn("duplicate_of_id", F.when(F.col("dedup_level") > 0, F.col("root_id"))).drop("root_id")
        merged = rows if store is None else upsert(store, rows, *keys)
        names = [c for c in refreshed if c in batch.columns]
        if names:
            # the latest value that any observation of this batch has
            latest = batch.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(f"_{c}") for c in names])
            columns = merged.columns
            merged = merged.join(latest, list(keys), "left").withColumns({c: F.coalesce(f"_{c}", c) for c in names}).select(*columns)
        merged.write.mode("overwrite").parquet(f"{path}/v={batch_id}")

    return write


def newest_snapshot(spark, path: str) -> DataFrame:
    """The last snapshot under ``path``."""
    rows = spark.read.parquet(path)
    return rows.where(F.col("v") == rows.agg(F.max("v")).first()[0]).drop("v")
