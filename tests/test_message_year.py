from pyspark.sql import functions as F

from marketloom.functions.extract import message_specs
from marketloom.plans import site_queries  # noqa: F401  (registers its queries)
from marketloom.plans.queries import QUERIES


def test_a_price_is_no_year(spark):
    texts = {"Audi A6 1996; Ціна: 2004 $; Пробіг 39 тис": None, "Audi A6 1998; Ціна: 2004 $": 1998, "Audi A6, 2001 грн, рік 1999": 1999, "A6 2001 $4500": 2001, "A6 2001USD": None, "A6 2003": 2003}
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", message_specs(F.col("text")).alias("s")).collect()
    assert {r.text: r.s.year for r in rows} == texts


def test_message_specs_of_a_cheap_line(spark, tmp_path):
    """A line of 1996 at 2 004.84: the year of its title is out of the range, and the price is none."""
    line = spark.createDataFrame([(1, 2, 3, 4, 2004.84, 33.0, "1996-05-06"), (1, 3, 3, 4, 1999.2, 5.0, "2000-05-06")], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double, l_shipdate string")
    line.withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp")).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(3, 5)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    rows = QUERIES["message_specs"](spark, f"file://{tmp_path}").collect()
    assert sorted((r.l_linenumber, r.year, r.price) for r in rows) == [(2, None, 2004.0), (3, 2000, 1999.0)]


def orders(spark, path, rows):
    kinds = "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate string"
    spark.createDataFrame(rows, kinds).withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp")).write.parquet(f"{path}/orders.parquet")
    return f"file://{path}"


def test_profile_feed_of_a_cheap_order(spark, tmp_path):
    sf = orders(spark, tmp_path, [(1, 7, 2001.9, "1996-05-06"), (2, 7, 2001.9, "1999-05-06")])
    assert sorted((r.source_id, r.year, r.price) for r in QUERIES["profile_feed"](spark, sf).collect()) == [("ig_1", None, 2001.0), ("ig_2", 1999, 2001.0)]


def test_channel_messages_of_a_cheap_order(spark, tmp_path):
    """A single ad and an album."""
    sf = orders(spark, tmp_path, [(1, 7, 2004.5, "1996-05-06"), (2, 9, 2004.5, "1995-05-06"), (3, 9, 9000.0, "1999-05-06")])
    assert sorted((r.source_id, r.year, r.price, r.is_album) for r in QUERIES["channel_messages"](spark, sf).collect()) == [("ch2_1", None, 2004.0, "false"), ("ch4_2", None, 2004.0, "true")]
