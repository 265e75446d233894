"""Registered queries of field rules, typed intents, saved filters and sinks, and their DuckDB twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from marketloom.functions.fields import city_name, harmonise
from marketloom.operators.commands import get_or_create, intent, overlay
from marketloom.plans.demo import FILTERS_SQL, table, user_filters
from marketloom.plans.queries import query
from marketloom.sources.landing import provision_sources, write_snapshot
from marketloom.tables import shared_dir

CITIES = ["м. Київ", "Киев ", "г.Одесса", "Львов", "місто Харків", "ДНЕПР", "Рівне", "город  Дніпропетровськ", ""]


def _picked(values: list, key) -> F.Column:
    return F.get(F.array(*[F.lit(v) for v in values]), (key % len(values)).cast("int"))


@query("city_names", """SELECT c_custkey, ['kyiv', 'kyiv', 'odesa', 'lviv', 'kharkiv', 'dnipro', 'рівне', 'dnipro', ''][c_custkey % 9 + 1] || CASE WHEN c_custkey % 2 = 0 AND c_custkey % 9 = 6 THEN ' ' || c_custkey ELSE '' END AS city FROM customer""")
def _city_names(spark, sf):
    k = F.col("c_custkey")
    text = F.concat(_picked(CITIES, k), F.when((k % 2 == 0) & (k % 9 == 6), F.concat(F.lit(" "), k.cast("string"))).otherwise(""))
    return table(spark, sf, "customer").select(k, city_name(text).alias("city"))


@query("harmonised", """WITH o AS (SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 1 THEN '' WHEN 2 THEN o_orderstatus END AS d, CASE o_orderkey % 4 WHEN 1 THEN '' WHEN 2 THEN 'raw' WHEN 3 THEN o_orderpriority END AS r,
 CASE WHEN o_orderkey % 5 > 1 THEN 'seller ' || o_custkey END AS s, CASE o_orderkey % 6 WHEN 0 THEN [] WHEN 1 THEN ['a', 'b'] END AS i, CASE WHEN o_orderkey % 7 < 3 THEN ['c'] WHEN o_orderkey % 7 = 3 THEN [] END AS u FROM orders)
SELECT k AS o_orderkey, coalesce(nullif(d, ''), nullif(r, '')) AS description, coalesce(nullif(r, ''), nullif(d, '')) AS raw_text, s AS seller, s AS seller_name,
 array_to_string(CASE WHEN len(i) > 0 THEN i ELSE u END, ',') AS images, array_to_string(CASE WHEN len(u) > 0 THEN u ELSE i END, ',') AS image_urls FROM o""")
def _harmonised(spark, sf):
    k, strings = F.col("o_orderkey"), "array<string>"
    given = table(spark, sf, "orders").select(
        k, F.when(k % 3 == 1, "").when(k % 3 == 2, F.col("o_orderstatus")).alias("description"), F.when(k % 4 == 1, "").when(k % 4 == 2, "raw").when(k % 4 == 3, F.col("o_orderpriority")).alias("raw_text"),
        F.when(k % 5 > 1, F.concat(F.lit("seller "), F.col("o_custkey").cast("string"))).alias("seller"), F.lit(None).cast("string").alias("seller_name"),
        F.when(k % 6 == 0, F.array().cast(strings)).when(k % 6 == 1, F.array(F.lit("a"), F.lit("b"))).alias("images"), F.when(k % 7 < 3, F.array(F.lit("c"))).when(k % 7 == 3, F.array().cast(strings)).alias("image_urls"),
    )
    return harmonise(given).withColumns({c: F.array_join(c, ",") for c in ("images", "image_urls")})


TYPED = ["{a} тис", "пробіг до {a}000", "{a}00", "{a}000 км", "3500-5500", "hello", "до {a}к", "скинути"]


@query("command_routes", """WITH o AS (SELECT o_orderkey, 100 + o_orderkey % 300 AS a, o_orderkey % 8 AS k, o_orderkey % 3 = 0 AS waits FROM orders),
 r AS (SELECT *, CASE WHEN k = 5 THEN 'none' WHEN k IN (1, 3) OR waits AND k <> 4 THEN 'set_mileage' ELSE 'set_price' END AS op FROM o)
SELECT o_orderkey, op, CASE WHEN op = 'set_price' AND k = 4 THEN 3500 END::INT AS min_price, CASE WHEN op = 'set_price' THEN CASE k WHEN 0 THEN a WHEN 2 THEN a * 100 WHEN 4 THEN 5500 WHEN 6 THEN a * 1000 END END::INT AS max_price,
 CASE WHEN op = 'set_mileage' THEN CASE k WHEN 2 THEN a * 100 WHEN 7 THEN NULL ELSE a * 1000 END END::INT AS max_mileage FROM r""")
def _command_routes(spark, sf):
    """Free texts of chats, some of which have been asked for a mileage."""
    k = F.col("o_orderkey")
    text = F.replace(_picked(TYPED, k), F.lit("{a}"), (100 + k % 300).cast("string"))
    waits = F.when(k % 3 == 0, "awaiting_mileage")
    return table(spark, sf, "orders").select(k, intent(text, waits).alias("i")).select("o_orderkey", "i.*")


@query("filter_store", f"""WITH {FILTERS_SQL}, u AS (SELECT c_custkey, c_custkey::VARCHAR AS chat_id FROM customer)
SELECT u.chat_id, CASE WHEN c_custkey % 4 = 0 THEN 1500 WHEN f.chat_id IS NOT NULL THEN f.min_price END::INT AS min_price, CASE WHEN f.chat_id IS NOT NULL THEN f.max_price END::INT AS max_price,
 CASE WHEN f.chat_id IS NULL THEN 'A6 C5' ELSE array_to_string(f.models, ',') END AS selected_models, CASE WHEN c_custkey % 4 = 0 THEN 'manual' ELSE 'any' END AS transmission, f.chat_id IS NULL AS exclude_damaged
FROM u LEFT JOIN filters f USING (chat_id)""")
def _filter_store(spark, sf):
    """Every customer gets a filter, the default where none is saved; some then change two of its columns."""
    k = F.col("c_custkey")
    customers = table(spark, sf, "customer")
    every = get_or_create(user_filters(spark, sf), customers.select(k.cast("string").alias("chat_id")))
    changes = customers.where(k % 4 == 0).select(k.cast("string").alias("chat_id"), F.lit(1500).alias("min_price"), F.lit("manual").alias("transmission"), F.lit(None).cast("int").alias("max_price"))
    return overlay(every, changes).select("chat_id", "min_price", "max_price", F.array_join("selected_models", ",").alias("selected_models"), "transmission", "exclude_damaged")


HOST_SQL = "regexp_extract(url, '^https?://([^/?#]*)', 1)"


@query("provisioned", f"""WITH h AS (SELECT DISTINCT {HOST_SQL} AS id FROM pages), s AS (SELECT DISTINCT {HOST_SQL} AS id FROM pages WHERE starts_with(url, 'https:'))
SELECT id, CASE WHEN id IN (SELECT id FROM s) THEN 'known' ELSE array_to_string(list_transform(string_split(replace(id, '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') END AS name, CASE WHEN id IN (SELECT id FROM s) THEN 1 ELSE 30 END AS rate_limit_per_min FROM h""")
def _provisioned(spark, sf):
    hosts = table(spark, sf, "pages").select("url", F.regexp_extract("url", "^https?://([^/?#]*)", 1).alias("source"))
    have = hosts.where(F.startswith("url", F.lit("https:"))).select(F.col("source").alias("id")).distinct()
    have = have.select("id", F.lit("known").alias("name"), F.lit("").alias("base_url"), F.lit("WEB_SCRAPER").alias("source_type"), F.lit(True).alias("is_active"), F.lit(1).alias("rate_limit_per_min"), F.lit(15).alias("scrape_interval_minutes"))
    return provision_sources(have, hosts).select("id", "name", "rate_limit_per_min")


@query("snapshot_partitions", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'again' ELSE 'first' END AS written, o_orderstatus AS source FROM orders WHERE o_orderstatus <> 'F' OR o_orderkey % 2 = 0")
def _snapshot_partitions(spark, sf):
    """A snapshot by source, of which one source is written again with half of its rows; the others stay."""
    path = f"{shared_dir(spark)}/snapshot-{uuid.uuid4().hex}"
    rows = table(spark, sf, "orders").select("o_orderkey", F.lit("first").alias("written"), F.col("o_orderstatus").alias("source"))
    write_snapshot(rows, path)
    write_snapshot(rows.where("source = 'F' and o_orderkey % 2 = 0").withColumn("written", F.lit("again")), path)
    return spark.read.parquet(path)
