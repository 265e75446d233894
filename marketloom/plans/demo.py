"""The listings model over the generic tables: which columns stand for what."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions.fields import to_usd


#: Bytes of a table for each core below which its rows are dealt out: so small a file is often one row group, which one task reads.
SPREAD_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows get much work each: dealt over all cores if its files are too few to be; else as it is read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    size = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    cores = spark.sparkContext.defaultParallelism
    rows = table(spark, sf_dir, name)
    return rows.repartition(cores) if size < cores * SPREAD_BYTES else rows


#: The total order of demo listings.
ORDER = ["first_seen_at", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings from order lines: regions as sources, suppliers as sellers, parts as models."""
    line = spread(spark, sf_dir, "lineitem")
    orders, part, supplier, nation, region = (table(spark, sf_dir, t) for t in ("orders", "part", "supplier", "nation", "region"))
    at = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    at = at.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    source = F.lower("r_name")
    money = F.col("l_extendedprice").cast("decimal(12,2)")
    code = F.when(F.col("l_linenumber") % 3 == 0, "USD").when(F.col("l_linenumber") % 3 == 1, "EUR").otherwise("UAH")
    url = F.concat(F.lit("https://"), source, F.lit(".example.com/p/"), F.col("l_partkey").cast("string"), F.lit("/?utm_source=x&o="), (F.col("l_orderkey") % 50).cast("string"))
    return at.select(
        source.alias("source"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("source_id"), url.alias("url"), F.col("p_name").alias("title"),
        F.col("p_brand").alias("brand"), F.col("p_type").alias("model"), F.concat(F.lit("G"), (F.col("p_size") % 5).cast("string")).alias("generation"), F.year("l_shipdate").alias("year"),
        money.alias("price"), code.alias("currency"), to_usd(money, code).alias("price_usd"), (F.col("l_quantity") * 10_000).cast("int").alias("mileage"), F.col("n_name").alias("location"),
        F.col("s_name").alias("seller"), F.lit(None).cast("string").alias("seller_phone"), F.lit("NEW").alias("status"), F.col("o_orderdate").alias("first_seen_at"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate",
    )


#: The same as a DuckDB common table expression.
LISTINGS_SQL = """listings AS (
  SELECT lower(r_name) AS source, l_orderkey || '-' || l_linenumber AS source_id,
    'https://' || lower(r_name) || '.example.com/p/' || l_partkey || '/?utm_source=x&o=' || (l_orderkey % 50) AS url, p_name AS title,
    p_brand AS brand, p_type AS model, 'G' || (p_size % 5) AS generation, year(l_shipdate)::INT AS year,
    l_extendedprice::DECIMAL(12,2) AS price, CASE l_linenumber % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE 'UAH' END AS currency,
    round(l_extendedprice::DECIMAL(12,2) * CASE l_linenumber % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 1.08 ELSE 0.0241 END::DECIMAL(10,4), 2)::DECIMAL(12,2) AS price_usd,
    (l_quantity * 10000)::INT AS mileage, n_name AS location, s_name AS seller, o_orderdate AS first_seen_at,
    l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

#: Engines of demo ads, by part.
ENGINES = ["1.8T", "2.4", "1.9 TDI", "2.5 TDI", "2.7T", "1.8", "3.0", "2.8", "2.0"]


def ads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ad titles made from parts and order lines, for the classifier and the message rules."""
    line, part = spread(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    engine = F.get(F.array(*[F.lit(e) for e in ENGINES]), (F.col("p_partkey") % 9).cast("int"))
    title = F.concat_ws(
        " ", F.when(F.col("p_size") % 11 == 0, "bmw").otherwise("Audi"), F.concat(F.lit("A"), (F.col("p_size") % 3 * 2 + 4).cast("string")),
        F.when(F.col("p_partkey") % 4 < 2, "C5").when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("C"), (F.col("p_size") % 5 + 4).cast("string"))), engine, F.when(F.col("p_size") % 7 == 0, "avant"),
        F.year("l_shipdate").cast("string"),
    )
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate", title.alias("title"))


ADS_SQL = """ads AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate,
    concat_ws(' ', CASE WHEN p_size % 11 = 0 THEN 'bmw' ELSE 'Audi' END, 'A' || (p_size % 3 * 2 + 4), CASE WHEN p_partkey % 4 < 2 THEN 'C5' WHEN p_partkey % 4 = 2 THEN 'C' || (p_size % 5 + 4) END,
      ['1.8T','2.4','1.9 TDI','2.5 TDI','2.7T','1.8','3.0','2.8','2.0'][p_partkey % 9 + 1], CASE WHEN p_size % 7 = 0 THEN 'avant' END, year(l_shipdate)::VARCHAR) AS title
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def user_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved filters from customers of one segment: the models and bounds vary by key."""
    customers = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    k = F.col("c_custkey")
    kinds = F.array(*[F.lit(x) for x in ("ECONOMY", "SMALL", "LARGE", "MEDIUM", "PROMO", "STANDARD")])
    model = lambda i: F.concat(F.get(kinds, ((k + i) % 6).cast("int")), F.lit(" G"), ((k + i) % 5).cast("string"))
    none = F.lit(None).cast("int")
    return customers.select(
        k.cast("string").alias("chat_id"), F.array(model(0), model(1)).alias("selected_models"), F.array().cast("array<string>").alias("engines"),
        F.when(k % 3 == 0, 20_000).alias("min_price"), F.when(k % 2 == 0, 60_000).otherwise(none).alias("max_price"), F.lit(1997).alias("min_year"), (F.lit(1999) + k % 3).cast("int").alias("max_year"),
        F.when(k % 4 == 0, 250_000).alias("max_mileage"), F.lit("any").alias("transmission"), F.lit("any").alias("drive_type"), F.lit("any").alias("body_type"), F.lit(False).alias("exclude_damaged"),
    )


FILTERS_SQL = """filters AS (
  SELECT c_custkey::VARCHAR AS chat_id, [['ECONOMY','SMALL','LARGE','MEDIUM','PROMO','STANDARD'][c_custkey % 6 + 1] || ' G' || (c_custkey % 5), ['ECONOMY','SMALL','LARGE','MEDIUM','PROMO','STANDARD'][(c_custkey + 1) % 6 + 1] || ' G' || ((c_custkey + 1) % 5)] AS models,
    CASE WHEN c_custkey % 3 = 0 THEN 20000 END AS min_price, CASE WHEN c_custkey % 2 = 0 THEN 60000 END AS max_price, 1997 AS min_year, 1999 + c_custkey % 3 AS max_year, CASE WHEN c_custkey % 4 = 0 THEN 250000 END AS max_mileage
  FROM customer WHERE c_mktsegment = 'BUILDING')"""
