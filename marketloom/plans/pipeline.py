"""The batch pipeline: raw rows to listings, decisions, duplicates, history, alerts and telemetry."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.functions.canonical import canonical_url, content_fingerprint
from marketloom.functions.fields import city_segment, currency, harmonise, image_list, phone, to_usd
from marketloom.operators.alerts import alert_columns, alert_gate, price_drop_badge
from marketloom.operators.classify import apply_decision, route
from marketloom.operators.dedup import deduplicate
from marketloom.operators.history import with_price_drops
from marketloom.operators.quality import split_valid
from marketloom.operators.rules import RuleSet
from marketloom.operators.stats import market_peers, seller_counts
from marketloom.operators.telemetry import run_counters, totals
from marketloom.operators.user_filter import match_users
from marketloom.tables import written


def derive(raw: DataFrame) -> DataFrame:
    """Normalised fields and derived columns of raw rows; values that are given stay."""
    df = harmonise(raw).withColumns({"seller_phone": phone(F.col("seller_phone")), "images": image_list(F.col("images")), "currency": currency(F.col("currency"))})
    for c in ("canonical_url", "price_usd", "location_city", "engine_code", "status"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("decimal(12,2)" if c == "price_usd" else "string"))
    df = df.withColumns({
        "canonical_url": F.coalesce("canonical_url", canonical_url(F.col("source"), F.col("url"))), "price_usd": F.coalesce("price_usd", to_usd(F.col("price"), F.col("currency"))),
        "location_city": F.coalesce("location_city", city_segment(F.col("location"))),
    })
    return df.withColumns({"content_fingerprint": content_fingerprint(True), "fuzzy_fingerprint": content_fingerprint(False)})


@dataclass
class Result:
    listings: DataFrame
    quarantine: DataFrame
    rejected: DataFrame
    alerts: DataFrame
    telemetry: DataFrame


def run_batch(raw: DataFrame, order: list[str], store: DataFrame | None = None, ruleset: RuleSet | None = None, allow_review: bool = True, filters: DataFrame | None = None) -> Result:
    """Run a batch of raw rows. ``order`` is a total order of the rows; ``store`` is the snapshot so far.

    Prices are folded over the batch, after the price of the same listing in ``store`` if that has ``price_usd``.
    With ``filters`` the alerts are those that pass a user's filter, a row for each (``chat_id``).
    """
    valid, quarantine = split_valid(derive(raw))
    decided = route(valid, ruleset)
    rejected = decided.where("decision.status = 'REJECT'")
    rows = apply_decision(decided.where("decision.status <> 'REJECT'"))
    # both are read many times: written down once, so the classifier is not in every branch of the plan
    rows = written(rows.withColumn("content_fingerprint", content_fingerprint(True)))
    found = written(with_price_drops(deduplicate(rows, order, store), ["source", "source_id"], order, store=store))
    stats = seller_counts(market_peers(found))
    gated = alert_gate(stats, allow_review=allow_review)
    if filters is not None:
        gated = match_users(gated.withColumn("id", F.xxhash64("source", "source_id", *order)), filters)
    alerts = alert_columns(gated).withColumn("price_drop", price_drop_badge(F.col("price_usd"), F.col("price_diff")))
    sent = alerts.select(*dict.fromkeys(("source", "source_id", *order))).distinct().withColumn("is_notified", F.lit(True))
    same = reduce(and_, [F.col(f"i.{c}").eqNullSafe(F.col(f"s.{c}")) for c in dict.fromkeys(("source", "source_id", *order))])
    told = found.alias("i").join(sent.alias("s"), same, "left").select("i.*", F.coalesce("is_notified", F.lit(False)).alias("is_notified"))
    items = told.select("source", F.lit(False).alias("is_error"), F.lit("PASS").alias("status"), "action", "is_price_drop", "is_notified")
    none = F.lit(None).cast("string")
    items = items.unionByName(quarantine.select("source", F.lit(True).alias("is_error"), none.alias("status"), none.alias("action"), F.lit(False).alias("is_price_drop"), F.lit(False).alias("is_notified")))
    items = items.unionByName(rejected.select("source", F.lit(False).alias("is_error"), F.lit("REJECT").alias("status"), none.alias("action"), F.lit(False).alias("is_price_drop"), F.lit(False).alias("is_notified")))
    return Result(found, quarantine, rejected, alerts, totals(run_counters(items, "source")))
