"""The alerts of a run, a row for each listing that alerts, with everything that an alert shows."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.operators import alerts as A
from marketloom.operators.stats import market_peers, seller_counts
from marketloom.operators.user_filter import count_users
from marketloom.plans.demo import FILTERS_SQL, user_filters
from marketloom.plans.queries import ID_SQL, ORACLES, _ids, _observed, query


def _even(n: str, d: int) -> str:
    """n / d to the nearest whole number, ties to the even one, with thousands set off by spaces."""
    whole = f"({n}) // {d} + CASE WHEN 2 * (({n}) % {d}) > {d} OR 2 * (({n}) % {d}) = {d} AND (({n}) // {d}) % 2 = 1 THEN 1 ELSE 0 END"
    return f"replace(format('{{:,}}', ({whole})::BIGINT), ',', ' ')"


def _percent(part: str, of: str) -> str:
    """part / of in per cent, to four decimals and then to none, ties up."""
    return f"((((2 * ({part})::HUGEINT * 1000000 + {of}) // (2 * {of})) + 5000) // 10000)::INT"


#: The CTEs of `dedup_root` up to the root of each chain, and what comes after.
CHAINS = ORACLES["dedup_root"].split("\nSELECT f.l_orderkey")[0].replace("WITH ", "WITH RECURSIVE ", 1)
ALERTS_SQL = CHAINS + f""", {FILTERS_SQL},
 o AS (SELECT source, source_id, rn, (price_usd * 100)::BIGINT AS cents FROM f),
 h AS (SELECT source, source_id, rn, cents, 0::BIGINT AS diff FROM o WHERE rn = 1
  UNION ALL SELECT o.source, o.source_id, o.rn, CASE WHEN abs(o.cents - h.cents) >= 100 THEN o.cents ELSE h.cents END, CASE WHEN abs(o.cents - h.cents) >= 100 THEN o.cents - h.cents ELSE 0 END
  FROM h JOIN o ON o.source = h.source AND o.source_id = h.source_id AND o.rn = h.rn + 1),
 y AS (SELECT brand, model, generation, year, sum((price_usd * 100)::BIGINT) FILTER (WHERE price_usd > 500) AS s, count(*) FILTER (WHERE price_usd > 500) AS n FROM listings GROUP BY ALL),
 peers AS (SELECT a.brand, a.model, a.generation, a.year, ((2 * sum(b.s) + sum(b.n)) // (2 * sum(b.n)))::BIGINT AS average FROM y a JOIN y b ON a.brand = b.brand AND a.model = b.model AND a.generation = b.generation AND b.year BETWEEN a.year - 1 AND a.year + 1 GROUP BY ALL),
 sellers AS (SELECT seller, count(*) AS ads FROM listings GROUP BY ALL),
 rows AS (SELECT f.*, h.diff, peers.average, sellers.ads, (f.price * 100)::BIGINT AS own, (f.price_usd * 100)::BIGINT AS usd
  FROM f JOIN h ON h.source = f.source AND h.source_id = f.source_id AND h.rn = f.rn JOIN p ON p.source = f.source AND p.source_id = f.source_id
   LEFT JOIN peers ON peers.brand = f.brand AND peers.model = f.model AND peers.generation = f.generation AND peers.year = f.year JOIN sellers ON sellers.seller = f.seller
  WHERE f.rn = 1 AND p.level = 0 OR h.diff < 0),
 met AS (SELECT {', '.join('r.' + c for c in ID_SQL.split(', '))}, count(*) AS n_users FROM rows r JOIN filters ON list_contains(models, model || ' ' || generation)
  AND (min_price IS NULL OR price_usd >= min_price) AND (max_price IS NULL OR price_usd <= max_price) AND year BETWEEN min_year AND max_year AND (max_mileage IS NULL OR mileage <= max_mileage) GROUP BY ALL)
SELECT {', '.join('r.' + c for c in ID_SQL.split(', '))}, n_users,
 array_to_string(list_transform(string_split(source, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS source_name,
 CASE currency WHEN 'USD' THEN '$' || {_even('own', 100)} || ' (~' || {_even('own * 415', 1000)} || ' грн)' WHEN 'UAH' THEN {_even('own', 100)} || ' грн (~$' || {_even('own * 10', 41500)} || ')' ELSE {_even('own', 100)} || ' € (~$' || {_even('own * 108', 10000)} || ')' END AS price_label,
 replace(format('{{:,}}', mileage), ',', ' ') || ' км' AS mileage_label, location AS place_label, CASE WHEN ads >= 3 THEN 'dealer' WHEN ads = 1 THEN 'private' END AS seller_kind,
 CASE r.l_linenumber % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'photo' ELSE 'album' END AS delivery, CASE WHEN r.l_orderkey % 11 = 0 THEN 'YEAR, ENGINE' END AS review,
 CASE WHEN (average - usd) * 100 >= 15 * average THEN (average - usd)::DOUBLE / 100 END AS below, CASE WHEN (average - usd) * 100 >= 15 * average THEN {_percent('(average - usd)', 'average')} END AS below_pct,
 diff < 0 AS is_price_drop, diff::DOUBLE / 100 AS price_diff, CASE WHEN diff < 0 THEN (usd - diff)::DOUBLE / 100 END AS old_price, CASE WHEN diff < 0 THEN {_percent('-diff', '(usd - diff)')} END AS drop_pct
FROM rows r JOIN met ON {' AND '.join(f'met.{c} = r.{c}' for c in ID_SQL.split(', '))}"""


@query("alert_details", ALERTS_SQL)
def _alert_details(spark, sf):
    """New listings and price drops that some user's filter lets through, with all that an alert shows, and for how many users."""
    none = F.lit(None).cast("string")
    photos = F.slice(F.array(F.lit("http://a/1"), F.lit("https://a/2"), F.lit("data:3")), 1, (F.col("l_linenumber") % 3).cast("int"))
    review = F.col("l_orderkey") % 11 == 0
    at = _observed(spark, sf)
    at = at.withColumns({"images": photos, "id": F.xxhash64(*_ids()), "engine": F.lit("1.8T 150"), "engine_code": F.lit("1.8T"), "description": none, "status": F.when(review, "NEEDS_REVIEW").otherwise("NEW")})
    rows = A.alert_columns(A.alert_gate(seller_counts(market_peers(at))))
    rows = rows.withColumns({"drop": A.price_drop_badge(F.col("price_usd"), F.col("price_diff")), "review": A.review_badge(F.col("status"), F.array(F.lit("YEAR"), F.lit("ENGINE")))})
    shown = rows.select(
        *_ids("source_name", "price_label", "mileage_label", "place_label", "seller_kind", "delivery", "review", "is_price_drop"), F.col("market.amount").cast("double").alias("below"), F.col("market.pct").alias("below_pct"),
        F.col("price_diff").cast("double").alias("price_diff"), F.col("drop.old").cast("double").alias("old_price"), F.col("drop.pct").alias("drop_pct"),
    )
    return shown.join(count_users(rows, user_filters(spark, sf), _ids()), _ids())
