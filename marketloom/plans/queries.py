"""The registered queries over the generic tables, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.functions import extract as E
from marketloom.functions.canonical import canonical_url, content_fingerprint
from marketloom.functions.fields import city_name, city_segment, currency, image_list, mileage_bucket, phone, to_usd
from marketloom.functions.text import clean_text, fold_lookalikes
from marketloom.operators import alerts as A
from marketloom.operators.classify import classify
from marketloom.operators.commands import fold_commands, mileage_bound, price_bounds
from marketloom.operators.dedup import deduplicate, earliest, first_seen
from marketloom.operators.history import current_rows, fold_prices, price_actions, version_rows, with_price_drops
from marketloom.operators.quality import delete_listings, insert_absent, orphans, repeated_keys, upsert, violations
from marketloom.operators.stats import market_overview, market_peers, market_price, seller_counts, source_counts, top_models
from marketloom.operators.telemetry import COUNTERS, failure_islands, run_counters, totals, until_stopped
from marketloom.operators.user_filter import listing_facts, match_users, newest_matches, search, selections_of
from marketloom.plans.demo import ADS_SQL, FILTERS_SQL, LISTINGS_SQL, ORDER, ads, listings, table, user_filters
from marketloom.streaming.streams import windowed_rollup
from marketloom.tables import delete, free_shuffles, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can say it, its DuckDB form."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


WITH_LISTINGS = f"WITH {LISTINGS_SQL} "


def _ids(*more) -> list:
    return ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", *more]


ID_SQL = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate"


# --- statistics -----------------------------------------------------------------------------------------------------


@query("market_overview", WITH_LISTINGS + """, p AS (SELECT *, CASE WHEN price_usd > 300 THEN price_usd END AS p FROM listings)
SELECT CASE WHEN grouping(model) = 1 AND grouping(source) = 1 THEN 'total' WHEN grouping(model) = 0 THEN 'model' ELSE 'source' END AS kind, model, generation, source, count(*) AS n, count(p) AS n_priced,
  round(round(sum(p)::DECIMAL(30,6) / count(p), 6), 2)::DOUBLE AS avg_price, min(p)::DOUBLE AS min_price, max(p)::DOUBLE AS max_price
FROM p GROUP BY GROUPING SETS ((), (model, generation), (source))""")
def _market_overview(spark, sf):
    return market_overview(listings(spark, sf)).withColumns({c: F.col(c).cast("double") for c in ("avg_price", "min_price", "max_price")})


@query("top_models", WITH_LISTINGS + "SELECT model, generation, count(*) AS n FROM listings GROUP BY ALL ORDER BY n DESC, model, generation LIMIT 6")
def _top_models(spark, sf):
    return top_models(listings(spark, sf))


@query("source_counts", WITH_LISTINGS + "SELECT source, count(*) AS n FROM listings GROUP BY ALL")
def _source_counts(spark, sf):
    return source_counts(listings(spark, sf))


@query("market_price", WITH_LISTINGS + "SELECT round(sum(price_usd)::DECIMAL(30,6) / count(price_usd), 2)::DOUBLE AS avg_price, count(price_usd) AS n FROM listings WHERE price_usd > 500 AND model = 'ECONOMY' AND generation = 'G1' AND year BETWEEN 1997 AND 1999")
def _market_price(spark, sf):
    return market_price(listings(spark, sf), "ECONOMY", 1998, "G1").withColumn("avg_price", F.col("avg_price").cast("double"))


@query("market_peers", WITH_LISTINGS + f""", y AS (SELECT brand, model, generation, year, sum(CASE WHEN price_usd > 500 THEN price_usd END) AS s, count(*) FILTER (WHERE price_usd > 500) AS n FROM listings GROUP BY ALL),
 p AS (SELECT a.brand, a.model, a.generation, a.year, sum(b.s) AS s, sum(b.n) AS n FROM y a JOIN y b ON a.brand = b.brand AND a.model = b.model AND a.generation = b.generation AND (a.year IS NULL OR b.year BETWEEN a.year - 1 AND a.year + 1) GROUP BY ALL)
SELECT {ID_SQL}, (floor(p.s * 100 / p.n + 0.5 + 1e-9) / 100)::DOUBLE AS peer_avg, p.n::BIGINT AS peer_count FROM listings l JOIN p ON l.brand = p.brand AND l.model = p.model AND l.generation = p.generation AND l.year IS NOT DISTINCT FROM p.year""")
def _market_peers(spark, sf):
    return market_peers(listings(spark, sf)).select(*_ids("peer_count"), F.col("peer_avg").cast("double").alias("peer_avg"))


def _sellers(spark, sf) -> DataFrame:
    """Customers as sellers: some without a number, several with the same one."""
    k = F.col("c_custkey")
    number = F.when(k % 5 != 0, F.concat(F.lit("+38050"), F.lpad((k % 97).cast("string"), 7, "0")))
    name = F.when(k % 7 != 0, F.concat(F.lit("Seller "), (k % 83).cast("string"))).otherwise("ab")
    return table(spark, sf, "customer").select("c_custkey", number.alias("seller_phone"), name.alias("seller"))


@query("seller_count", """WITH s AS (SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN '+38050' || lpad((c_custkey % 97)::VARCHAR, 7, '0') END AS phone, CASE WHEN c_custkey % 7 <> 0 THEN 'Seller ' || (c_custkey % 83) ELSE 'ab' END AS name FROM customer)
SELECT a.c_custkey, a.phone AS seller_phone, a.name AS seller, count(b.c_custkey) AS seller_ads FROM s a LEFT JOIN s b ON (a.phone = b.phone) OR (length(a.name) > 3 AND a.name = b.name) GROUP BY ALL""")
def _seller_count(spark, sf):
    return seller_counts(_sellers(spark, sf))


# --- field functions ------------------------------------------------------------------------------------------------


@query("fx_normalise", WITH_LISTINGS + f"SELECT {ID_SQL}, currency, price_usd::DOUBLE AS price_usd FROM listings")
def _fx(spark, sf):
    return listings(spark, sf).select(*_ids("currency"), F.col("price_usd").cast("double").alias("price_usd"))


@query("mileage_bucket", WITH_LISTINGS + f"SELECT {ID_SQL}, CASE WHEN mileage - 10000 > 0 THEN ((mileage - 10000) // 10000 * 10000)::VARCHAR ELSE 'UNKNOWN_MILEAGE' END AS bucket FROM listings")
def _mileage(spark, sf):
    return listings(spark, sf).select(*_ids(), mileage_bucket(F.col("mileage") - 10_000).alias("bucket"))


@query("city_segment", "SELECT c_custkey, nullif(trim(regexp_split_to_array(c_name || CASE c_custkey % 3 WHEN 0 THEN ' , ' WHEN 1 THEN '/' ELSE ';' END || c_mktsegment, '[,/|;]')[1]), '') AS city, lower(trim(c_mktsegment)) AS plain FROM customer")
def _city(spark, sf):
    joined = F.concat("c_name", F.when(F.col("c_custkey") % 3 == 0, " , ").when(F.col("c_custkey") % 3 == 1, "/").otherwise(";"), "c_mktsegment")
    return table(spark, sf, "customer").select("c_custkey", city_segment(joined).alias("city"), city_name(F.col("c_mktsegment")).alias("plain"))


@query("currency_normalise", "SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'USD' WHEN 1 THEN 'USD' WHEN 2 THEN 'EUR' WHEN 3 THEN 'UAH' WHEN 4 THEN 'UAH' WHEN 5 THEN 'PLN' ELSE 'USD' END AS currency FROM orders")
def _currency(spark, sf):
    given = F.get(F.array(*[F.lit(x) for x in ("$", "us", " € ", "грн", "ГРН.", "pln", "")]), (F.col("o_orderkey") % 7).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", currency(given).alias("currency"))


@query("phone_normalise", """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '+380' || lpad((c_custkey % 1000000000)::VARCHAR, 9, '5') WHEN 1 THEN '+380' || lpad((c_custkey % 1000000000)::VARCHAR, 9, '6') WHEN 2 THEN '+380' || lpad((c_custkey % 1000000000)::VARCHAR, 9, '7') ELSE '+48' || c_custkey END AS phone FROM customer""")
def _phone(spark, sf):
    k = F.col("c_custkey").cast("string")
    nine = lambda c: F.lpad(k, 9, c)
    given = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("+380 ("), nine("5"), F.lit(")"))).when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("0-"), nine("6"))).when(F.col("c_custkey") % 4 == 2, nine("7")).otherwise(F.concat(F.lit("+48 "), k))
    return table(spark, sf, "customer").select("c_custkey", phone(given).alias("phone"))


@query("image_clean", """WITH l AS (SELECT page_id, list_transform(regexp_extract_all(html, 'href="([^"]*)"', 1), lambda x: trim(x)) AS x FROM pages)
SELECT page_id, len(y) AS n, array_to_string(y, '|') AS links FROM (SELECT page_id, list_filter(x, lambda v, i: v <> '' AND list_position(x, v) = i) AS y FROM l)""")
def _images(spark, sf):
    links = image_list(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))
    return table(spark, sf, "pages").select("page_id", F.size(links).cast("long").alias("n"), F.array_join(links, "|").alias("links"))


@query("canonical_url", """WITH u AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS q FROM pages),
 k AS (SELECT *, list_sort(list_filter(string_split(q, '&'), lambda x: regexp_extract(x, '^([^=]*)=(.+)$', 1) NOT IN ('', 'ref', 'from', 'hash', 'tab') AND NOT starts_with(x, 'utm_'))) AS kept FROM u)
SELECT page_id, 'https://' || CASE WHEN contains(lower(host), 'auto.ria') THEN 'auto.ria.com' WHEN contains(lower(host), 'olx') THEN 'www.olx.ua' WHEN contains(lower(host), 'rst') THEN 'rst.ua' WHEN contains(lower(host), 't.me') THEN 't.me' WHEN contains(lower(host), 'instagram') THEN 'www.instagram.com' ELSE lower(string_split(host, ':')[1]) END || regexp_replace(path, '/+$', '') || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical_url FROM k""")
def _canonical(spark, sf):
    return table(spark, sf, "pages").select("page_id", canonical_url(F.lit(""), F.col("url")).alias("canonical_url"))


@query("listing_url", WITH_LISTINGS + f"SELECT {ID_SQL}, 'https://' || source || '.example.com/p/' || l_partkey || '?o=' || (l_orderkey % 50) AS canonical_url FROM listings")
def _listing_url(spark, sf):
    return listings(spark, sf).select(*_ids(), canonical_url(F.lit("x"), F.col("url")).alias("canonical_url"))


def _fingerprinted(spark, sf, rows: DataFrame | None = None) -> DataFrame:
    none = {c: F.lit(None).cast("string") for c in ("body_type", "engine_code", "fuel_type", "transmission", "drive_type", "location_city")}
    rows = listings(spark, sf) if rows is None else rows
    return rows.withColumns(none | {"engine": F.col("brand")}).withColumn("content_fingerprint", content_fingerprint(True))


FINGERPRINT_SQL = "sha256(concat_ws('|', 'AUDI_A6_C5', year::VARCHAR, 'unknown', upper(trim(brand)), 'other', 'unknown', 'unknown', CASE WHEN mileage > 0 THEN (mileage // 10000 * 10000)::VARCHAR ELSE 'UNKNOWN_MILEAGE' END, lower(trim(location)), lower(trim(seller))))"


@query("content_fingerprint", WITH_LISTINGS + f"SELECT {ID_SQL}, {FINGERPRINT_SQL} AS content_fingerprint FROM listings")
def _fingerprint(spark, sf):
    return _fingerprinted(spark, sf).select(*_ids("content_fingerprint"))


@query("text_normalise", """SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '(\\d+),(\\d+)', '\\1.\\2', 'g'), '\\s+', ' ', 'g'))) AS clean, md5(lower(trim(regexp_replace(regexp_replace(text, '(\\d+),(\\d+)', '\\1.\\2', 'g'), '\\s+', ' ', 'g')))) AS semantic FROM documents""")
def _text(spark, sf):
    at = table(spark, sf, "documents").select("doc_id", clean_text(F.col("text"), compatibility=True).alias("c"))
    return at.select("doc_id", F.md5(fold_lookalikes(F.col("c"))).alias("clean"), F.md5(F.lower("c")).alias("semantic"))


@query("year_extract", "SELECT doc_id, nullif(regexp_extract(text, '\\b(199\\d|200\\d|201\\d|202\\d)\\b', 1), '')::INT AS year FROM documents")
def _year(spark, sf):
    from marketloom.operators.classify import extract_year

    return table(spark, sf, "documents").select("doc_id", extract_year(F.lit(None).cast("int"), F.col("text")).alias("year"))


# --- classifier -----------------------------------------------------------------------------------------------------

CLASSIFY_SQL = f"""WITH {ADS_SQL}, f AS (SELECT *, regexp_matches(title, '(?i)\\ba6\\b') AS a6, regexp_matches(title, '(?i)\\bc5\\b') AS c5, regexp_extract(title, '\\b(199\\d|200\\d|201\\d|202\\d)\\b', 1)::INT AS y,
  CASE WHEN regexp_matches(title, '(?i)\\bc4\\b') THEN 'GENERATION_C4' WHEN regexp_matches(title, '(?i)\\bc6\\b') THEN 'GENERATION_C6' WHEN regexp_matches(title, '(?i)\\bc7\\b') THEN 'GENERATION_C7' WHEN regexp_matches(title, '(?i)\\bc8\\b') THEN 'GENERATION_C8' END AS g,
  CASE WHEN title LIKE '% 2.5 TDI%' THEN 'REJECTED_ENGINE_2.5_TDI' WHEN title LIKE '% 2.7T%' THEN 'REJECTED_ENGINE_2.7T' WHEN title LIKE '% 2.8%' THEN 'REJECTED_ENGINE_2.8' WHEN title LIKE '% 3.0%' THEN 'REJECTED_ENGINE_3.0' WHEN title LIKE '% 2.0%' THEN 'REJECTED_ENGINE_2.0' END AS bad,
  CASE WHEN title LIKE '% 1.8T%' THEN '1.8T' WHEN title LIKE '% 2.4%' THEN '2.4' WHEN title LIKE '% 1.9 TDI%' THEN '1.9_TDI' END AS e, title LIKE '% avant%' AS avant FROM ads),
 r AS (SELECT *, CASE WHEN title LIKE 'bmw%' AND NOT (a6 AND NOT lower(title) LIKE '%на%') THEN 'NOT_AUDI_A6' WHEN NOT a6 AND NOT c5 AND title LIKE '% A4%' THEN 'WRONG_MODEL_A4' WHEN NOT a6 AND NOT c5 AND title LIKE '% A8%' THEN 'WRONG_MODEL_A8'
    WHEN NOT a6 AND NOT c5 THEN 'NOT_AUDI_A6' WHEN NOT a6 AND title LIKE '% A4%' THEN 'WRONG_MODEL_A4' WHEN NOT a6 AND title LIKE '% A8%' THEN 'WRONG_MODEL_A8' END AS wrong,
    c5 OR y BETWEEN 1998 AND 2003 AS sure FROM f),
 d AS (SELECT *, coalesce(sure OR (y = 1997 AND e IN ('1.8T', '2.4')) OR (y = 2004 AND (e IN ('1.8T', '1.9_TDI') OR (e = '2.4' AND avant))), false) AS confirmed FROM r),
 x AS (SELECT *, CASE WHEN wrong IS NOT NULL THEN 'REJECT|' || wrong WHEN g IS NOT NULL AND y < 1997 THEN 'REJECT|YEAR_TOO_EARLY_' || y || ',' || g WHEN g IS NOT NULL AND y > 2005 THEN 'REJECT|' || g || ',YEAR_TOO_LATE_' || y WHEN g IS NOT NULL THEN 'REJECT|' || g
    WHEN y < 1997 THEN 'REJECT|YEAR_TOO_EARLY_' || y WHEN y > 2005 THEN 'REJECT|YEAR_TOO_LATE_' || y WHEN bad IS NOT NULL THEN 'REJECT|' || bad
    WHEN y = 1997 AND e = '1.9_TDI' AND NOT sure THEN 'NEEDS_REVIEW|YEAR_1997_1.9TDI_CHECK_C4_OR_C5' WHEN y = 2004 AND e = '2.4' AND NOT avant AND NOT sure THEN 'NEEDS_REVIEW|YEAR_2004_2.4_CHECK_C5_OR_C6' WHEN y = 2005 AND NOT sure THEN 'REJECT|YEAR_2005_CHECK_C5_OR_C6'
    WHEN e IS NULL AND title LIKE '% 1.8%' THEN 'NEEDS_REVIEW|AMBIGUOUS_1.8_CHECK_TURBO' WHEN e IS NULL THEN 'NEEDS_REVIEW|ENGINE_NOT_IDENTIFIED' WHEN NOT confirmed THEN 'NEEDS_REVIEW|AMBIGUOUS_GENERATION_CHECK_C5' ELSE 'PASS|AUDI_A6_C5_' || e END AS out FROM d)
"""


@query("classify_text", CLASSIFY_SQL + "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, title, string_split(out, '|')[1] AS status, string_split(out, '|')[2] AS reasons FROM x")
def _classify(spark, sf):
    at = classify(ads(spark, sf))
    return at.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "title", F.col("decision.status").alias("status"), F.array_join("decision.reasons", ",").alias("reasons"))


@query("decision_counts", CLASSIFY_SQL + "SELECT string_split(out, '|')[1] AS status, string_split(out, '|')[2] AS reasons, count(*) AS n FROM x GROUP BY ALL")
def _decision_counts(spark, sf):
    return classify(ads(spark, sf)).groupBy(F.col("decision.status").alias("status"), F.array_join("decision.reasons", ",").alias("reasons")).agg(F.count("*").alias("n"))


# --- quality --------------------------------------------------------------------------------------------------------


@query("quality_quarantine", WITH_LISTINGS + f"SELECT {ID_SQL}, concat_ws(',', CASE WHEN length(title) > 500 THEN 'TOO_LONG_TITLE' END, CASE WHEN year NOT BETWEEN 1996 AND 2000 THEN 'YEAR_RANGE' END, CASE WHEN mileage NOT BETWEEN 0 AND 450000 THEN 'MILEAGE_RANGE' END) AS violations FROM listings WHERE year NOT BETWEEN 1996 AND 2000 OR mileage NOT BETWEEN 0 AND 450000")
def _quarantine(spark, sf):
    at = listings(spark, sf).withColumn("v", violations(["source", "source_id", "url", "title", "year", "mileage", "price"], year=(1996, 2000), mileage=450_000))
    return at.where(F.size("v") > 0).select(*_ids(), F.array_join("v", ",").alias("violations"))


@query("fk_orphans", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')")
def _orphans(spark, sf):
    return orphans(table(spark, sf, "orders"), table(spark, sf, "customer").where("c_mktsegment <> 'BUILDING'"), "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


@query("unique_violations", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _unique(spark, sf):
    return repeated_keys(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")


@query("delete_cascade", """WITH g AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'P'), l AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey // 2 END AS d FROM orders)
SELECT 'listing' AS kind, id, CASE WHEN d NOT IN (SELECT id FROM g) THEN d END AS duplicate_of_id FROM l WHERE id NOT IN (SELECT id FROM g)
UNION ALL SELECT 'version', l_orderkey, NULL FROM lineitem WHERE l_orderkey NOT IN (SELECT id FROM g)""")
def _delete(spark, sf):
    orders = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    own = orders.select(k.alias("id"), F.when(k % 3 == 0, F.floor(k / 2)).alias("duplicate_of_id"))
    versions = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("listing_id"))
    kept, history = delete_listings(own, versions, orders.where("o_orderstatus = 'P'").select(k.alias("id")))
    return kept.select(F.lit("listing").alias("kind"), "id", "duplicate_of_id").union(history.select(F.lit("version"), "listing_id", F.lit(None).cast("long")))


@query("upsert_snapshot", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'NEW' ELSE o_orderstatus END AS o_orderstatus FROM orders UNION ALL SELECT -o_orderkey - 1, 'NEW' FROM orders WHERE o_orderkey % 100 = 0")
def _upsert(spark, sf):
    store = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    k = F.col("o_orderkey")
    changes = store.where(k % 10 == 0).select(k, F.lit("NEW").alias("o_orderstatus")).union(store.where(k % 100 == 0).select(-k - 1, F.lit("NEW")))
    return upsert(store, changes, "o_orderkey")


HOST_SQL = "regexp_extract(url, '^https?://([^/?#]*)', 1)"


@query("seed_sources", f"""WITH s AS (SELECT DISTINCT {HOST_SQL} AS id FROM pages WHERE starts_with(url, 'https:'))
SELECT id, 'seed' AS origin FROM s UNION ALL SELECT DISTINCT {HOST_SQL}, 'new' FROM pages WHERE {HOST_SQL} NOT IN (SELECT id FROM s)""")
def _seed(spark, sf):
    hosts = table(spark, sf, "pages").select("url", F.regexp_extract("url", "^https?://([^/?#]*)", 1).alias("id"))
    have = hosts.where(F.startswith("url", F.lit("https:"))).select("id", F.lit("seed").alias("origin")).distinct()
    return insert_absent(have, hosts.select("id", F.lit("new").alias("origin")), "id")


# --- duplicates and history -----------------------------------------------------------------------------------------

ORDER_SQL = "first_seen_at, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate"


@query("dedup_l1", WITH_LISTINGS + f"SELECT {ID_SQL}, row_number() OVER (PARTITION BY source, source_id ORDER BY {ORDER_SQL}) = 1 AS is_insert FROM listings")
def _l1(spark, sf):
    return first_seen(listings(spark, sf), ["source", "source_id"], ORDER).select(*_ids("is_insert"))


@query("dedup_url", WITH_LISTINGS + f"SELECT {ID_SQL}, first_value(l_orderkey) OVER (PARTITION BY source, l_partkey, l_orderkey % 50 ORDER BY {ORDER_SQL}) AS first_order FROM listings")
def _by_url(spark, sf):
    at = listings(spark, sf).withColumn("canonical_url", canonical_url(F.lit("x"), F.col("url"))).withColumn("place", F.struct(*ORDER))
    return earliest(at, "canonical_url", "first").select(*_ids(), F.col("first.l_orderkey").alias("first_order"))


@query("dedup_content", WITH_LISTINGS + f"SELECT {ID_SQL}, first_value(l_orderkey) OVER (PARTITION BY {FINGERPRINT_SQL} ORDER BY {ORDER_SQL}) AS first_order FROM listings")
def _by_content(spark, sf):
    at = _fingerprinted(spark, sf).withColumn("place", F.struct(*ORDER))
    return earliest(at, "content_fingerprint", "first").select(*_ids(), F.col("first.l_orderkey").alias("first_order"))


def _dedup_rows(spark, sf) -> DataFrame:
    """Listings with the keys of duplicates; read many times, so the joins they come from are written down once."""
    base = written(listings(spark, sf), "listings")
    free_shuffles(spark)
    at = _fingerprinted(spark, sf, base).withColumn("canonical_url", canonical_url(F.lit("x"), F.col("url")))
    at = at.withColumn("content_fingerprint", F.sha2(F.concat_ws("|", "seller", "model", "generation", "year", "mileage"), 256))
    at._written_at = base._written_at  # for delete()
    return at


@query("dedup_root", WITH_LISTINGS + f""", f AS (SELECT *, row_number() OVER (PARTITION BY source, source_id ORDER BY {ORDER_SQL}) AS rn, row_number() OVER (ORDER BY {ORDER_SQL}) AS pos, concat_ws('|', seller, model, generation, year, mileage) AS fp, source || '|' || l_partkey || '|' || (l_orderkey % 50) AS cu FROM listings),
 i AS (SELECT *, min(pos) OVER (PARTITION BY cu) AS mu, min(pos) OVER (PARTITION BY fp) AS mf FROM f WHERE rn = 1),
 p AS (SELECT *, CASE WHEN mu < pos THEN 2 WHEN mf < pos THEN 3 ELSE 0 END AS level, CASE WHEN mu < pos THEN mu WHEN mf < pos THEN mf ELSE pos END AS parent FROM i),
 c AS (WITH RECURSIVE r AS (SELECT pos, parent AS root FROM p UNION ALL SELECT r.pos, p.parent FROM r JOIN p ON r.root = p.pos WHERE p.parent <> p.pos) SELECT pos, min(root) AS root FROM r GROUP BY pos)
SELECT f.l_orderkey, f.l_linenumber, f.l_partkey, f.l_suppkey, f.l_extendedprice, f.l_shipdate, f.rn = 1 AS is_insert, CASE WHEN f.rn > 1 THEN 1 ELSE p.level END AS dedup_level, o.l_orderkey AS root_order
FROM f JOIN p ON f.source = p.source AND f.source_id = p.source_id JOIN c ON c.pos = p.pos JOIN f o ON o.pos = c.root""")
def _root(spark, sf):
    return deduplicate(_dedup_rows(spark, sf), ORDER).select(*_ids("is_insert", "dedup_level"), F.col("root.l_orderkey").alias("root_order"))


PRICES_SQL = """WITH RECURSIVE e AS (SELECT user_id, event_type, event_id, CASE WHEN event_id % 17 <> 0 THEN value::DECIMAL(12,2) END AS v, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events),
 s AS (SELECT user_id, event_type, rn, event_id, v AS price, 0 AS version, 'INITIAL' AS change_type, 0::DECIMAL(12,2) AS diff, true AS hit FROM e WHERE rn = 1
  UNION ALL SELECT e.user_id, e.event_type, e.rn, e.event_id, CASE WHEN h THEN e.v ELSE s.price END, s.version + h::INT, CASE WHEN s.price IS NULL THEN 'PRICE_SET' WHEN e.v < s.price THEN 'PRICE_DROP' ELSE 'PRICE_INCREASE' END, CASE WHEN s.price IS NULL THEN 0 ELSE e.v - s.price END::DECIMAL(12,2), h
  FROM s JOIN (SELECT *, true AS h FROM e UNION ALL SELECT *, false FROM e) e ON e.user_id = s.user_id AND e.event_type = s.event_type AND e.rn = s.rn + 1 AND h = (e.v IS NOT NULL AND (s.price IS NULL OR abs(e.v - s.price) >= 5)))
"""


def _history(spark, sf) -> DataFrame:
    at = table(spark, sf, "events").withColumn("price", F.when(F.col("event_id") % 17 != 0, F.col("value").cast("decimal(12,2)")))
    return fold_prices(at, ["user_id", "event_type"], ["ts", "event_id"], threshold="5.0")


@query("price_history", PRICES_SQL + "SELECT user_id, event_type, version, event_id, change_type, coalesce(price, 0)::DOUBLE AS price, diff::DOUBLE AS price_diff, change_type = 'PRICE_DROP' AS is_price_drop FROM s WHERE hit")
def _price_history(spark, sf):
    rows = price_actions(version_rows(_history(spark, sf), ["user_id", "event_type"]))
    return rows.select("user_id", "event_type", "version", F.col("at.event_id").alias("event_id"), "change_type", F.col("price").cast("double").alias("price"), F.col("price_diff").cast("double").alias("price_diff"), "is_price_drop")


@query("current_prices", PRICES_SQL + "SELECT user_id, event_type, arg_max(price, rn)::DOUBLE AS current_price, max(rn) AS n_observations, arg_max(event_id, rn) AS last_event FROM (SELECT user_id, event_type, rn, event_id, price FROM s) GROUP BY ALL")
def _current(spark, sf):
    at = current_rows(_history(spark, sf), ["user_id", "event_type"])
    return at.select("user_id", "event_type", F.col("current_price").cast("double").alias("current_price"), F.col("n_observations").cast("long").alias("n_observations"), F.col("last_seen.event_id").alias("last_event"))


# --- alerts ---------------------------------------------------------------------------------------------------------


@query("below_market", WITH_LISTINGS + f""", y AS (SELECT model, generation, sum(price_usd) FILTER (WHERE price_usd > 500) AS s, count(*) FILTER (WHERE price_usd > 500) AS n FROM listings GROUP BY ALL),
 a AS (SELECT {ID_SQL}, price_usd, round(s::DECIMAL(30,6) / n, 2)::DECIMAL(18,2) AS avg FROM listings l JOIN y ON l.model = y.model AND l.generation = y.generation)
SELECT {ID_SQL}, (avg - price_usd)::DOUBLE AS amount FROM a WHERE avg > 0 AND (avg - price_usd) * 100 >= 15 * avg""")
def _below(spark, sf):
    at = listings(spark, sf).select(*_ids("price_usd", "brand", "model", "generation"), F.lit(None).cast("int").alias("year"), "status")
    badge = market_peers(at.withColumn("brand", F.lit("x"))).withColumn("b", A.market_badge(F.col("price_usd"), F.col("peer_avg")))
    return badge.where("b is not null").select(*_ids(), F.col("b.amount").cast("double").alias("amount"))


@query("seller_badge", """WITH s AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_orderkey, n, CASE WHEN n >= 3 THEN 'dealer' WHEN n = 1 THEN 'private' END AS badge FROM s""")
def _badge(spark, sf):
    at = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return at.withColumn("badge", A.seller_badge(F.col("n")))


@query("price_text", WITH_LISTINGS + f""", f AS (SELECT {ID_SQL}, mileage, currency, floor(l_extendedprice)::BIGINT AS p FROM listings)
SELECT {ID_SQL}, CASE currency WHEN 'USD' THEN '$' || replace(format('{{:,}}', p), ',', ' ') WHEN 'UAH' THEN replace(format('{{:,}}', p), ',', ' ') || ' грн' ELSE replace(format('{{:,}}', p), ',', ' ') || ' €' END AS label, replace(format('{{:,}}', mileage), ',', ' ') || ' км' AS mileage_label FROM f""")
def _price_text(spark, sf):
    whole = F.floor(F.col("l_extendedprice")).cast("decimal(12,2)")
    text = F.trim(F.regexp_replace(A.price_text(whole, F.col("currency"), F.lit(None)), " \\(~.*$", ""))
    return listings(spark, sf).select(*_ids(), text.alias("label"), A.mileage_text(F.col("mileage")).alias("mileage_label"))


def _observed(spark, sf) -> DataFrame:
    """Every observation with its action and price drop, written down: what follows reads it many times."""
    rows = _dedup_rows(spark, sf)
    found = written(deduplicate(rows, ORDER).drop("url", "canonical_url", "content_fingerprint", "root"), "deduplicated")
    delete(rows)
    free_shuffles(spark)
    out = written(with_price_drops(found, ["source", "source_id"], ORDER), "observed")
    delete(found)
    free_shuffles(spark)
    return out


@query("alert_feed")
def _alert_feed(spark, sf):
    none = F.lit(None).cast("string")
    at = _observed(spark, sf)
    at = at.withColumns({"images": F.lit(None).cast("array<string>"), "id": F.xxhash64(*_ids()), "engine": F.lit("1.8T 150"), "engine_code": F.lit("1.8T"), "description": none})
    # what an alert shows is computed once for each listing, and then goes to its users
    rows = A.alert_columns(A.alert_gate(seller_counts(market_peers(at)))).withColumn("drop_pct", A.price_drop_badge(F.col("price_usd"), F.col("price_diff"))["pct"])
    return match_users(rows, user_filters(spark, sf)).select("chat_id", *_ids("source_name", "price_label", "mileage_label", "place_label", "seller_kind", "delivery"), F.col("market.pct").alias("below_pct"), "is_price_drop", "price_diff", "drop_pct")


@query("send_once", "SELECT DISTINCT user_id, event_type FROM events WHERE (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM events WHERE event_type = 'error' OR value > 60)")
def _send_once(spark, sf):
    events = table(spark, sf, "events")
    sent = events.where("event_type = 'error' or value > 60").select("user_id", "event_type").distinct()
    return A.send_once(events.select("user_id", "event_type"), sent, ("user_id", "event_type"))


# --- users ----------------------------------------------------------------------------------------------------------


def _searchable(spark, sf) -> DataFrame:
    none = F.lit(None).cast("string")
    return listings(spark, sf).withColumns({"id": F.xxhash64(*_ids()), "engine": F.lit("1.8T 150"), "engine_code": F.lit("1.8T"), "transmission": none, "drive_type": none, "body_type": none, "description": none})


MATCH_SQL = f"""WITH {LISTINGS_SQL}, {FILTERS_SQL}, m AS (SELECT DISTINCT chat_id, {ID_SQL}, first_seen_at, price_usd FROM listings l JOIN filters f ON list_contains(models, model || ' ' || generation)
  AND (min_price IS NULL OR price_usd >= min_price) AND (max_price IS NULL OR price_usd <= max_price) AND year BETWEEN min_year AND max_year AND (max_mileage IS NULL OR mileage <= max_mileage)) """


@query("user_filter_match", MATCH_SQL + f"SELECT chat_id, {ID_SQL} FROM m")
def _match(spark, sf):
    return match_users(_searchable(spark, sf), user_filters(spark, sf)).select("chat_id", *_ids())


@query("top_n_per_user", MATCH_SQL + "SELECT chat_id, first_seen_at, rank FROM (SELECT chat_id, first_seen_at, row_number() OVER (PARTITION BY chat_id ORDER BY first_seen_at DESC) AS rank FROM m) WHERE rank <= 5")
def _top_n(spark, sf):
    return newest_matches(_searchable(spark, sf), user_filters(spark, sf)).select("chat_id", "first_seen_at", F.col("rank").cast("long").alias("rank"))


@query("search_fallback", MATCH_SQL + "SELECT chat_id, first_seen_at, rank, true AS exact FROM (SELECT chat_id, first_seen_at, row_number() OVER (PARTITION BY chat_id ORDER BY first_seen_at DESC) AS rank FROM m) WHERE rank <= 5")
def _search(spark, sf):
    return search(_searchable(spark, sf), user_filters(spark, sf)).select("chat_id", "first_seen_at", F.col("rank").cast("long").alias("rank"), "exact")


@query("search_damaged", f"""WITH {LISTINGS_SQL}, {FILTERS_SQL}, m AS (SELECT chat_id, first_seen_at, model, (l_orderkey * 10 + l_linenumber) * 100000 + l_partkey AS id FROM listings l JOIN filters f ON list_contains(models, model || ' ' || generation)
  AND (min_price IS NULL OR price_usd >= min_price) AND (max_price IS NULL OR price_usd <= max_price) AND year BETWEEN min_year AND max_year AND (max_mileage IS NULL OR mileage <= max_mileage)),
 s AS (SELECT *, model NOT IN ('ECONOMY', 'SMALL') AS exact FROM m QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY first_seen_at DESC, id DESC) <= 10), h AS (SELECT *, count(*) FILTER (WHERE exact) OVER (PARTITION BY chat_id) AS hits FROM s)
SELECT chat_id, first_seen_at, row_number() OVER (PARTITION BY chat_id ORDER BY first_seen_at DESC, id DESC) AS rank, exact FROM h WHERE exact OR hits = 0 QUALIFY rank <= 5""")
def _search_damaged(spark, sf):
    """Two models are damaged cars: who asks for these only gets them all the same, others get what passes the exact predicate."""
    number = (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100_000 + F.col("l_partkey")
    rows = _searchable(spark, sf).withColumns({"id": number, "description": F.when(F.col("model").isin("ECONOMY", "SMALL"), "битий")})
    wanted = user_filters(spark, sf).withColumn("exclude_damaged", F.lit(True))
    return search(rows, wanted).select("chat_id", "first_seen_at", F.col("rank").cast("long").alias("rank"), "exact")


@query("title_substrings", """WITH t AS (SELECT p_partkey, upper(replace(p_name, ' ', '') || p_brand) AS title FROM part),
 m AS (SELECT DISTINCT substr(title, 3, 4 + c_custkey % 3) AS m FROM customer JOIN t ON p_partkey = c_custkey // 2)
SELECT p_partkey, count(m) AS n, min(m) AS least FROM t LEFT JOIN m ON contains(title, m) GROUP BY ALL""")
def _title_substrings(spark, sf):
    """Selections that stand anywhere in a title without word breaks."""
    titles = table(spark, sf, "part").select("p_partkey", F.upper(F.concat(F.replace("p_name", F.lit(" "), F.lit("")), "p_brand")).alias("title"))
    part = F.substring("title", F.lit(3), (4 + F.col("c_custkey") % 3).cast("int"))
    asked = table(spark, sf, "customer").join(titles, F.col("p_partkey") == F.floor(F.col("c_custkey") / 2)).select("c_custkey", F.array(part).alias("selected_models"))
    none = {c: F.lit(None).cast("string") for c in ("generation", "transmission", "drive_type", "body_type", "description", "engine", "engine_code")}
    owned = selections_of(listing_facts(titles.withColumns(none | {"model": F.lit("?")})), asked)
    return owned.select("p_partkey", F.size("_owns").cast("long").alias("n"), F.array_min("_owns").alias("least"))


# --- extraction -----------------------------------------------------------------------------------------------------


@query("page_cards", """WITH c AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<li><a href="[^"]*">[^<]*')) AS card FROM pages) SELECT page_id, card AS raw, trim(regexp_extract(card, '>([^<>]*)$', 1)) AS text FROM c""")
def _cards(spark, sf):
    at = E.cards(table(spark, sf, "pages"), "html", '<li><a href="', "page_id").withColumn("raw", F.regexp_extract("card", '(?s)^<li><a href="[^"]*">[^<]*', 0))
    return at.where("raw <> ''").select("page_id", "raw", F.trim(F.regexp_extract("raw", ">([^<>]*)$", 1)).alias("text"))


@query("page_links", """SELECT page_id, len(list_distinct(regexp_extract_all(html, '<a href="([^"]*)"', 1))) AS n_links, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages""")
def _links(spark, sf):
    links = F.array_distinct(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1)))
    return table(spark, sf, "pages").select("page_id", F.size(links).cast("long").alias("n_links"), F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"))


@query("album_assembly", """WITH t AS (SELECT *, trim(text) AS tr FROM conversations) SELECT conv_id, min(turn) AS id, count(*) AS n_messages, md5(coalesce(arg_min(tr, turn) FILTER (WHERE tr <> ''), arg_min(tr, turn))) AS caption, array_to_string(list_slice(list_distinct_ordered, 1, 10), '|') AS images
FROM t JOIN (SELECT conv_id, list(role ORDER BY f) AS list_distinct_ordered FROM (SELECT conv_id, role, min(turn) AS f FROM conversations GROUP BY ALL) GROUP BY conv_id) USING (conv_id) GROUP BY conv_id, list_distinct_ordered""")
def _albums(spark, sf):
    from marketloom.sources.landing import albums

    turns = table(spark, sf, "conversations").select(
        F.lit("c").alias("channel"), F.col("conv_id").alias("grouped_id"), F.col("turn").alias("id"), F.col("turn").alias("seq"), F.col("text").alias("message"), F.lit(None).cast("timestamp").alias("date"),
        F.lit(False).alias("media_photo"), F.lit(None).cast("string").alias("photo_id"), F.array("role").alias("photo_urls"),
    )
    return albums(turns).select(F.col("grouped_id").alias("conv_id"), "id", "n_messages", F.md5("caption.text").alias("caption"), F.array_join("images", "|").alias("images"))


@query("json_flatten", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events WHERE props->>'$.k' IS NOT NULL")
def _json(spark, sf):
    at = table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint").alias("p"))
    return at.where("p.k is not null").select("event_id", F.col("p.k").alias("k"))


@query("message_specs", f"""WITH {ADS_SQL} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, nullif(regexp_extract(title, '\\b(199[7-9]|200[0-5])\\b', 1), '')::INT AS year, floor(l_extendedprice)::DOUBLE AS price, 'USD' AS currency, (l_quantity * 1000)::INT AS mileage,
  CASE WHEN title LIKE '% 1.8T%' THEN '1.8T' WHEN title LIKE '% 1.9 TDI%' THEN '1.9 TDI' WHEN title LIKE '% 1.8%' THEN '1.8' WHEN title LIKE '% 2.4%' THEN '2.4' END AS engine, CASE WHEN title LIKE '%TDI%' THEN 'дизель' END AS fuel_type FROM ads""")
def _specs(spark, sf):
    text = F.concat(F.col("title"), F.lit("; Ціна: "), F.floor("l_extendedprice").cast("string"), F.lit(" $; Пробіг "), F.col("l_quantity").cast("int").cast("string"), F.lit(" тис"))
    at = ads(spark, sf).withColumn("s", E.message_specs(text))
    return at.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "s.year", F.col("s.price").cast("double").alias("price"), "s.currency", "s.mileage", "s.engine", "s.fuel_type")


# --- telemetry ------------------------------------------------------------------------------------------------------


def _items(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    action = F.when(F.col("event_type") == "signup", "CREATED").otherwise("OBSERVED")
    return e.select((F.col("user_id") % 5).alias("source"), (F.col("event_type") == "error").alias("is_error"), F.when(F.col("event_id") % 9 == 0, "REJECT").otherwise("PASS").alias("status"), action.alias("action"), ((F.col("event_type") == "view") & (F.col("event_id") % 2 == 0)).alias("is_price_drop"), (F.col("event_type") == "signup").alias("is_notified"))


TELEMETRY_SQL = """WITH i AS (SELECT user_id % 5 AS source, event_type = 'error' AS err, event_id % 9 <> 0 AND event_type <> 'error' AS ok, event_type = 'signup' AS new, event_type = 'view' AND event_id % 2 = 0 AS dropped FROM events),
 c AS (SELECT source, count(*) AS scanned, count(*) FILTER (WHERE ok) AS matched_filter, count(*) FILTER (WHERE ok AND new) AS new, count(*) FILTER (WHERE ok AND dropped) AS updated, count(*) FILTER (WHERE ok AND NOT dropped AND NOT new) AS duplicates, count(*) FILTER (WHERE ok AND new) AS notified, count(*) FILTER (WHERE err) AS errors FROM i GROUP BY ALL) """


@query("run_telemetry", TELEMETRY_SQL + "SELECT *, CASE WHEN errors > 0 AND scanned - errors > 0 THEN 'PARTIAL' WHEN errors > 0 THEN 'FAILED' ELSE 'SUCCESS' END AS status FROM c")
def _telemetry(spark, sf):
    return run_counters(_items(spark, sf), "source")


@query("telemetry_rollup", TELEMETRY_SQL + "SELECT source, " + ", ".join(f"sum({c})::BIGINT AS {c}" for c in COUNTERS) + " FROM c GROUP BY ROLLUP (source)")
def _rollup(spark, sf):
    return totals(run_counters(_items(spark, sf), "source"))


@query("failure_islands", """WITH o AS (SELECT event_id, user_id, ts, event_type <> 'error' AS ok, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM events)
SELECT event_id, user_id, CASE WHEN ok THEN 0 ELSE sum((NOT ok)::INT) OVER (PARTITION BY user_id, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) END::BIGINT AS failures FROM o""")
def _islands(spark, sf):
    at = failure_islands(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") != "error")
    return at.select("event_id", "user_id", F.col("failures").cast("long").alias("failures"))


@query("stopped_scan", """WITH o AS (SELECT event_id, user_id, ts, event_type <> 'error' AS ok, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM events),
 f AS (SELECT *, CASE WHEN ok THEN 0 ELSE sum((NOT ok)::INT) OVER (PARTITION BY user_id, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) END AS failures FROM o),
 s AS (SELECT *, coalesce(max((failures >= 2)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM f)
SELECT event_id, user_id FROM s WHERE stopped = 0""")
def _stopped(spark, sf):
    return until_stopped(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") != "error", 2).select("event_id", "user_id")


# --- commands -------------------------------------------------------------------------------------------------------

PRICE_TEXTS = ["{a}-{b}", "до {a}", "від {a}", "{a}", "0", "{a} {b}", "{c}k", "hello", "> {a}", "{c}.5k - {d}k"]


@query("price_text_parse", """WITH n AS (SELECT o_orderkey, (o_orderkey % 10)::INT AS k, 1000 + o_orderkey % 700 AS a, 2000 + o_orderkey % 900 AS b, 1 + o_orderkey % 9 AS c, 11 + o_orderkey % 20 AS d FROM orders)
SELECT o_orderkey, k <> 7 AS recognised, CASE WHEN k IN (0, 2, 5, 8) THEN a WHEN k = 9 THEN c * 1000 + 500 END::INT AS min_price, CASE WHEN k IN (0, 5) THEN b WHEN k IN (1, 3) THEN a WHEN k = 6 THEN c * 1000 WHEN k = 9 THEN d * 1000 END::INT AS max_price FROM n""")
def _price_parse(spark, sf):
    k = F.col("o_orderkey")
    parts = {"{a}": 1000 + k % 700, "{b}": 2000 + k % 900, "{c}": 1 + k % 9, "{d}": 11 + k % 20}
    text = F.get(F.array(*[F.lit(t) for t in PRICE_TEXTS]), (k % 10).cast("int"))
    for mark, value in parts.items():
        text = F.replace(text, F.lit(mark), value.cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", price_bounds(text).alias("p")).select("o_orderkey", "p.*")


@query("mileage_text_parse", """WITH n AS (SELECT o_orderkey, (o_orderkey % 6)::INT AS k, 100 + o_orderkey % 300 AS a FROM orders) SELECT o_orderkey, k <> 5 AS recognised, CASE WHEN k IN (0, 1, 2, 3) THEN a * 1000 END::INT AS max_mileage FROM n""")
def _mileage_parse(spark, sf):
    k = F.col("o_orderkey")
    text = F.get(F.array(*[F.lit(t) for t in ("{a} тис", "до {a}000 км", "{a}", "{a}к", "скинути", "ok")]), (k % 6).cast("int"))
    text = F.replace(text, F.lit("{a}"), (100 + k % 300).cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", mileage_bound(text).alias("p")).select("o_orderkey", "p.*")


def command_log(spark, sf) -> DataFrame:
    """Commands from events: ``chat_id``, ``ts``, ``event_id``, ``kind``, ``arg``."""
    e = table(spark, sf, "events")
    kinds = F.array(*[F.lit(x) for x in ("toggle_model", "toggle_eng", "set_trans", "set_year", "text", "toggle_cond", "action_reset")])
    args = F.array(*[F.lit(x) for x in ("A6C6", "2.4", "manual", "rest", "3500-5500", "", "")])
    at = (F.col("event_id") % 7).cast("int")
    return e.select(F.col("user_id").cast("string").alias("chat_id"), "ts", "event_id", F.get(kinds, at).alias("kind"), F.get(args, at).alias("arg"))


@query("command_fold", """WITH o AS (SELECT user_id, event_id % 7 AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events), r AS (SELECT user_id, coalesce(max(rn) FILTER (WHERE k = 6), 0) AS since FROM o GROUP BY ALL),
 c AS (SELECT user_id, count(*) FILTER (WHERE rn > since AND k = 0) AS models, count(*) FILTER (WHERE rn > since AND k = 1) AS engines, count(*) FILTER (WHERE rn > since AND k = 2) AS trans, count(*) FILTER (WHERE rn > since AND k = 3) AS years, count(*) FILTER (WHERE rn > since AND k = 4) AS prices, count(*) FILTER (WHERE rn > since AND k = 5) AS conds FROM o JOIN r USING (user_id) GROUP BY ALL)
SELECT user_id::VARCHAR AS chat_id, CASE WHEN models % 2 = 1 THEN 'A6 C5,A6 C6' ELSE 'A6 C5' END AS selected_models, CASE WHEN engines = 0 THEN '1.8T,2.4,1.9 TDI' WHEN engines % 2 = 1 THEN '1.8T,1.9 TDI' ELSE '1.8T,1.9 TDI,2.4' END AS engines, CASE WHEN prices > 0 THEN 3500 END::INT AS min_price, CASE WHEN prices > 0 THEN 5500 END::INT AS max_price,
  CASE WHEN years > 0 THEN 2001 ELSE 1997 END::INT AS min_year, 2005::INT AS max_year, NULL::INT AS max_mileage, CASE WHEN trans > 0 THEN 'manual' ELSE 'any' END AS transmission, 'any' AS drive_type, 'any' AS body_type, conds % 2 = 0 AS exclude_damaged FROM c""")
def _fold(spark, sf):
    log = command_log(spark, sf).withColumn("seq", F.struct("ts", "event_id"))
    folded = fold_commands(log.select("chat_id", "seq", "kind", "arg"))
    return folded.withColumns({c: F.array_join(c, ",") for c in ("selected_models", "engines")})


# --- windows --------------------------------------------------------------------------------------------------------


@query("windowed_rollup", "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS window_end, event_type, count(*) AS n, sum(value::DECIMAL(18,4))::DOUBLE AS total, min(value) AS least, max(value) AS most FROM events GROUP BY ALL")
def _windows(spark, sf):
    return windowed_rollup(table(spark, sf, "events"), "ts", "value", ["event_type"]).withColumn("total", F.col("total").cast("double"))


@query("first_events", "SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def _first_events(spark, sf):
    order = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return table(spark, sf, "events").withColumn("r", F.row_number().over(order)).where("r = 1").select("event_id", "user_id", "event_type")
