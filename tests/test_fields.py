from pyspark.sql import functions as F

from marketloom.functions.canonical import canonical_url, content_fingerprint, fingerprint_text
from marketloom.functions.fields import city_name, currency, image_list, mileage_bucket, phone, to_usd
from marketloom.functions.text import clean_text, fold_identifiers


def values(spark, column, rows, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_phone(spark):
    given = ["+38 (050) 111-22-33", "0501112233", "501112233", "+48 22 100", "", "abc", None]
    assert values(spark, phone, given) == ["+380501112233", "+380501112233", "+380501112233", "+4822100", None, None, None]


def test_currency_and_dollars(spark):
    assert values(spark, currency, ["$", "€", "грн", " uah ", "pln", "", None]) == ["USD", "EUR", "UAH", "UAH", "PLN", "USD", "USD"]
    df = spark.createDataFrame([("4000", "EUR"), ("3600", "EUR"), ("41500", "UAH"), ("10", "XYZ")], "p string, c string")
    assert [float(r[0]) for r in df.select(to_usd(F.col("p").cast("decimal(12,2)"), F.col("c"))).collect()] == [4320.0, 3888.0, 1000.15, 10.0]


def test_cities_buckets_images(spark):
    assert values(spark, city_name, ["м. Київ", "Львов", "Рівне", "г.Одесса"]) == ["kyiv", "lviv", "рівне", "odesa"]
    assert values(spark, mileage_bucket, [284_999, 0, None, 10_000], "int") == ["280000", "UNKNOWN_MILEAGE", "UNKNOWN_MILEAGE", "10000"]
    assert values(spark, image_list, [["  a ", "", "b", "a", None], None], "array<string>") == [["a", "b"], []]


def test_clean_text(spark):
    assert values(spark, clean_text, ["​ Ауді  А6  1,8 ", None, "ﬁ"]) == ["Ауді А6 1.8", "", "fi"]
    assert values(spark, fold_identifiers, ["Ауді А6 С5 1.8Т слово", "plain A6"]) == ["Ауді A6 C5 1.8T слово", "plain A6"]


def test_canonical_url(spark):
    rows = [
        ("x", "HTTP://Shop.Example.com:8080/a/b/?utm_source=t&b=2&a=1&ref=z&c=#top", "https://shop.example.com/a/b?a=1&b=2"),
        ("rst", "https://www.rst.ua/ukr/oldcars/1.html?x=1", "https://rst.ua/oldcars/1.html?x=1"),
        ("instagram", "https://instagram.com/p/AbC/?igsh=1&x=2", "https://www.instagram.com/p/AbC"),
        ("olx", "https://olx.ua/d/uk/obyavlenie/a b.html?reason=1", "https://www.olx.ua/d/obyavlenie/a b.html"),
        ("x", "", ""),
        ("x", "https://e.com/?q=a%20b~c*d", "https://e.com?q=a+b~c%2Ad"),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "s string, u string")
    got = [r[0] for r in df.select(canonical_url(F.col("s"), F.col("u"))).collect()]
    assert got == [r[2] for r in rows]
    again = spark.createDataFrame([(g,) for g in got if g], "u string").select("u", canonical_url(F.lit("x"), F.col("u")).alias("v"))
    assert all(r.u == r.v for r in again.collect())


def test_fingerprints(spark):
    schema = "year int, body_type string, engine_code string, engine string, fuel_type string, transmission string, drive_type string, mileage int, location_city string, location string, seller_phone string, seller string"
    df = spark.createDataFrame([(1999, None, "1.8T", None, None, None, None, 281_000, "Київ", None, None, " Ivan "), (None,) * 12], schema)
    text = [r[0] for r in df.select(fingerprint_text()).collect()]
    assert text == ["AUDI_A6_C5|1999|unknown|1.8T|other|unknown|unknown|280000|kyiv|ivan", "AUDI_A6_C5|UNKNOWN_YEAR|unknown|UNKNOWN_ENGINE|other|unknown|unknown|UNKNOWN_MILEAGE|unknown_loc"]
    assert len(df.select(content_fingerprint()).first()[0]) == 64


def test_every_number_with_k(spark):
    from marketloom.operators.commands import price_bounds

    given = ["1k 2k 3k 4k 5k-6k", "5k-6k", "3.5к до 4.25k", "до 4k", "10kg 7000", "k", "0.5k 900 1k", "k5k k", "5k"]
    want = [(5000, 6000), (5000, 6000), (3500, 4250), (None, 4000), (None, 7000), None, None, None, (None, 5000)]
    assert [(r.min_price, r.max_price) if r.recognised else None for r in values(spark, price_bounds, given)] == want
