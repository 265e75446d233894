from decimal import Decimal

from pyspark.sql import functions as F

from marketloom.operators.history import with_price_drops
from marketloom.plans.demo import ORDER, user_filters
from marketloom.plans.queries import QUERIES, _dedup_rows

SF = "/root/testdata/sf0.001"


def row_at_a_time(rows, filters):
    """Each row in order: known listing, then URL, then fingerprint; the recorded price; each user's filter."""
    prices, urls, prints, out = {}, set(), set(), []
    for r in rows:
        key, diff, drop = (r.source, r.source_id), Decimal(0), False
        new = key not in prices and r.canonical_url not in urls and r.content_fingerprint not in prints
        if key not in prices:
            prices[key] = r.price_usd
            urls.add(r.canonical_url)
            prints.add(r.content_fingerprint)
        elif abs(r.price_usd - prices[key]) >= 1:
            diff, prices[key] = r.price_usd - prices[key], r.price_usd
            drop = diff < 0
        for f in filters if new or drop else ():
            bounds = (r.price_usd, f.min_price, f.max_price), (r.year, f.min_year, f.max_year), (r.mileage, None, f.max_mileage)
            if f"{r.model} {r.generation}" in f.selected_models and all((low is None or x >= low) and (high is None or x <= high) for x, low, high in bounds):
                out.append((f.chat_id, r.l_orderkey, r.l_linenumber, r.l_partkey, drop, diff))
    return sorted(out)


def test_alert_feed_against_row_at_a_time(spark):
    rows = _dedup_rows(spark, SF).orderBy(*ORDER).collect()
    want = row_at_a_time(rows, user_filters(spark, SF).collect())
    got = [tuple(r) for r in QUERIES["alert_feed"](spark, SF).select("chat_id", "l_orderkey", "l_linenumber", "l_partkey", "is_price_drop", "price_diff").collect()]
    assert sorted(got) == want and want


def test_price_drops_of_observations(spark):
    log = [("a", 1, "100"), ("a", 2, "90"), ("a", 3, "89.5"), ("a", 4, "95"), ("b", 1, "50"), ("b", 2, None), ("b", 3, "10"), ("c", 1, "7")]
    df = spark.createDataFrame(log, "k string, seq int, p string").withColumn("price_usd", F.col("p").cast("decimal(12,2)"))
    d = {(r.k, r.seq): r.price_diff for r in with_price_drops(df, ["k"], ["seq"]).where("is_price_drop").collect()}
    assert d == {("a", 2): Decimal(-10), ("b", 3): Decimal(-40)}
    store = spark.createDataFrame([("c", Decimal(9))], "k string, price_usd decimal(12,2)")
    assert [(r.k, r.price_diff) for r in with_price_drops(df, ["k"], ["seq"], store=store).where("is_price_drop and k = 'c'").collect()] == [("c", Decimal(-2))]


def test_run_batch_alerts_price_drops(spark):
    from pyspark.sql import types as T

    from marketloom.plans.pipeline import run_batch
    from marketloom.schema import RAW_SCHEMA

    common = {"source": "olx", "source_id": "1", "url": "https://olx.ua/1", "title": "Audi A6 C5 1.8T 2000", "year": 2000, "currency": "USD", "model": "A6", "generation": "C5", "engine": "1.8T"}
    prices = [("5000", 1), ("4000", 2), ("4000", 3), ("4500", 4)]
    raw = T.StructType([*RAW_SCHEMA.fields, T.StructField("seq", T.LongType())])
    at = spark.createDataFrame([tuple((common | {"price": Decimal(p), "seq": n}).get(f.name) for f in raw.fields) for p, n in prices], raw)
    total = run_batch(at, ["seq"]).telemetry.where("source = 'olx'").first()
    assert (total.scanned, total.new, total.updated, total.duplicates, total.notified) == (4, 1, 1, 2, 2)
