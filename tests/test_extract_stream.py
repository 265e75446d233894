import datetime
import json

from pyspark.sql import functions as F

from marketloom.operators.user_filter import filter_condition, listing_facts
from marketloom.sources import landing
from marketloom.streaming.streams import track_prices, windowed_rollup

CARD_A = """<section class="ticket-item" data-auto-id="77" data-id="5"><div class="ticket-photo"><picture><img src="//cdn.x/1s.jpg" data-src="//cdn.x/2s.jpg"></picture></div>
<a class="address" href="/uk/auto_audi_a6_77.html?utm_source=q">Audi A6 quattro</a><span data-currency="USD">4 200 $</span>
<ul class="characteristic"><li class="item-char">280 тис. км</li><li class="item-char">Львів</li><li class="item-char">Бензин, 1.78 л.</li><li class="item-char">Ручна / Механіка</li></ul>1999</section>"""


def pages(spark, *html):
    return spark.createDataFrame([(f"u{i}", h) for i, h in enumerate(html)], "url string, html string")


def test_cards_a(spark):
    row = landing.extract_cards_a(pages(spark, "<div>" + CARD_A + '<section class="ticket-item"><a href="/x">no id</a></section>', None)).collect()
    assert len(row) == 1
    r = row[0]
    assert (r.source_id, r.url, r.title) == ("77", "https://auto.ria.com/uk/auto_audi_a6_77.html", "Audi A6 quattro 1999")
    assert (float(r.price), r.currency, r.mileage, r.engine, r.fuel_type, r.location) == (4200.0, "USD", 280_000, "1.8T Бензин, 1.78 л.", "бензин", "Львів")
    assert (r.generation, r.drive_type, r.year, r.images) == ("C5", "quattro", 1999, ["https://cdn.x/2f.jpg"])


def test_embedded_state_and_markup(spark):
    state = {"listing": {"listing": {"ads": [{"id": 9, "url": "/d/uk/obyavlenie/a-IDx.html?r=1", "title": "Audi A6 2001", "price": {"value": 4800, "currency": "USD"}, "params": [{"key": "year", "value": {"label": "2002"}}, {"key": "milage", "value": {"label": "310 000 км"}}], "photos": [{"link": "https://p/{width}x{height}"}], "location": {"city": {"name": "Львів"}}, "created_time": "2024-01-02T03:04:05+02:00"}, {"id": None}]}}}
    plain = f"<script>window.__PRERENDERED_STATE__ = {json.dumps(json.dumps(state))};</script>"
    card = '<div data-cy="l-card"><a href="/d/uk/obyavlenie/b-IDq1.html"><h6>Audi A6 1999</h6></a><p data-testid="ad-price">150 000 грн.</p><p data-testid="location-date">Київ, Дарниця - 10:00</p><img src="https://i/1.jpg"></div>'
    rows = {r.source_id: r for r in landing.extract_cards_b(pages(spark, plain, card, "<script>window.__PRERENDERED_STATE__ = {bad;</script>" + card.replace("q1", "q2"))).collect()}
    assert set(rows) == {"9", "q1", "q2"}
    ad = rows["9"]
    assert (ad.url, ad.year, ad.mileage, ad.images, ad.location) == ("https://www.olx.ua/d/uk/obyavlenie/a-IDx.html", 2002, 310_000, ["https://p/1000x700"], "Львів")
    assert ad.published_at == datetime.datetime(2024, 1, 2, 1, 4, 5)
    assert (float(rows["q1"].price), rows["q1"].currency, rows["q1"].location, rows["q1"].year) == (150_000.0, "UAH", "Київ, Дарниця", 1999)


def test_cards_c_and_bytes(spark):
    html = '<div class="rst-ocb-i rst-x"><a class="rst-ocb-i-a" href="/ukr/oldcars/audi/a6/audi_a6_123.html">x</a><h3 class="rst-ocb-i-h">Audi A6 2002</h3><span class="rst-ocb-i-d-s-p">$4 900</span><div class="rst-ocb-i-d-d">2.4 бензин, седан, 295 тис.км, КПП механіка, Рівне</div><img src="//i/5_1.jpg"></div>'
    r = landing.extract_cards_c(pages(spark, html)).first()
    assert (r.source_id, r.engine, r.mileage, r.transmission, r.location, r.year, r.images) == ("123", "2.4 бензин", 295_000, "механіка", "Рівне", 2002, ["https://i/5_0.jpg"])
    df = spark.createDataFrame([(bytearray("Київ".encode("cp1251")), "text/html; charset=utf-8"), (bytearray("Київ".encode()), None), (bytearray(b"a\x98\xff"), None)], "b binary, h string")
    assert [x[0] for x in df.select(landing.decode_bytes(F.col("b"), F.col("h"))).collect()] == ["Київ", "Київ", "a��"]


def test_messages_and_albums(spark):
    rows = [
        (10, "ch", "Audi A6 C5 1.8T\nРік: 1999 Ціна: 4 500 $ Пробіг 280 тис Механіка Київ +38 (050) 111-22-33", 7, ["p1"], 1), (11, "ch", "", 7, ["p1", "p2"], 2),
        (12, "ch", "Audi 2.4 автомат 4800$", None, [], 3), (13, "ch", "", None, [], 4),
    ]
    df = spark.createDataFrame(rows, "id long, channel string, message string, grouped_id long, photo_urls array<string>, seq long").withColumns({"date": F.lit("2024-01-01").cast("timestamp"), "media_photo": F.lit(False), "photo_id": F.lit(None).cast("string")})
    got = {r.source_id: r for r in landing.extract_messages(df).collect()}
    assert set(got) == {"ch_10", "ch_12"}
    a = got["ch_10"]
    assert (a.title, a.year, float(a.price), a.mileage, a.engine, a.transmission, a.location, a.seller_phone, a.images) == ("Audi A6 C5 1.8T", 1999, 4500.0, 280_000, "1.8T", "механіка", "Київ", "+380501112233", ["p1", "p2"])


def test_user_filter(spark):
    listing = spark.createDataFrame([("Audi A6 C5 1.8T", "після ДТП", "A6", "C5", 1999, 4500.0, "механіка"), ("Audi A6 C5 2.4 quattro", "", "A6", "C5", None, None, "")], "title string, description string, model string, generation string, year int, price_usd double, transmission string")
    none = {c: F.lit(None).cast("string") for c in ("engine", "engine_code", "drive_type", "body_type")}
    at = listing.withColumns(none | {"price": F.col("price_usd"), "mileage": F.lit(None).cast("int"), "selected_models": F.array(F.lit("A6 C5")), "engines": F.array(F.lit("1.8T"), F.lit("2.4")), "min_price": F.lit(1000), "max_price": F.lit(5000), "min_year": F.lit(1997), "max_year": F.lit(2005), "max_mileage": F.lit(None).cast("int"), "f_transmission": F.lit("manual"), "f_drive_type": F.lit("any"), "f_body_type": F.lit("any"), "exclude_damaged": F.lit(True)})
    assert [r.ok for r in listing_facts(at).select(filter_condition().alias("ok")).collect()] == [False, True]


def test_streams_equal_batch(spark, tmp_path):
    rows = [("a", 1, 100.0), ("a", 2, 99.5), ("b", 3, None), ("a", 4, 98.0), ("b", 5, 7.0)]
    spark.createDataFrame(rows, "listing string, at long, price double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("listing string, at long, price double").parquet(str(tmp_path / "in"))
    track_prices(stream).writeStream.format("memory").queryName("versions").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.listing, r.version, r.change_type, r.price_diff) for r in spark.table("versions").collect())
    assert got == [("a", 0, "INITIAL", 0.0), ("a", 1, "PRICE_DROP", -2.0), ("b", 0, "INITIAL", 0.0), ("b", 1, "PRICE_SET", 0.0)]
    events = spark.createDataFrame([("2024-01-01 00:10:00", "k", 1.0), ("2024-01-01 00:50:00", "k", 3.0), ("2024-01-01 01:10:00", "k", 5.0)], "t string, k string, v double").select(F.col("t").cast("timestamp").alias("t"), "k", "v")
    assert sorted((r.n, float(r.total)) for r in windowed_rollup(events, "t", "v", ["k"]).collect()) == [(1, 5.0), (2, 4.0)]


def test_stream_refreshes_known_listings(spark, tmp_path):
    """Two micro-batches: a known listing keeps its row and takes the latest price, a new one is added, a repost points to its root."""
    from marketloom.streaming.streams import newest_snapshot, snapshot_writer

    kinds = "seq long, source string, source_id string, canonical_url string, content_fingerprint string, price double"
    batches = [[(1, "a", "x", "u1", "f1", 10.0), (2, "a", "x", "u1", "f1", 9.0)], [(3, "a", "x", "u1", "f1", None), (4, "a", "x", "u1", "f1", 7.0), (5, "b", "y", "u1", "f2", 7.5), (6, "b", "z", "u9", None, 3.0)]]
    write = snapshot_writer(spark, f"file://{tmp_path}/snap", ["seq"])
    for i, rows in enumerate(batches):
        write(spark.createDataFrame(rows, kinds), i)
    write(spark.createDataFrame(batches[1], kinds), 1)  # run again
    got = {(r.source, r.source_id): r for r in newest_snapshot(spark, f"file://{tmp_path}/snap").collect()}
    assert {k: (r.seq, r.price, r.dedup_level) for k, r in got.items()} == {("a", "x"): (1, 7.0, 0), ("b", "y"): (5, 7.5, 2), ("b", "z"): (6, 3.0, 0)}
    assert got["b", "y"].duplicate_of_id == got["a", "x"].id and got["a", "x"].duplicate_of_id is None


def test_characteristics_without_their_class(spark):
    """Items of the characteristic list, or of the grid, where none has its own class."""
    listed = CARD_A.replace(' class="item-char"', "")
    grid = CARD_A.replace('<ul class="characteristic">', '<div class="grid-wrapper">').replace("</ul>", "</div>").replace('<li class="item-char">', "<span>").replace("</li>", "</span>")
    for html in (CARD_A, listed, grid):
        r = landing.extract_cards_a(pages(spark, html)).first()
        assert (r.mileage, r.engine, r.fuel_type, r.location, r.transmission) == (280_000, "1.8T Бензин, 1.78 л.", "бензин", "Львів", "Ручна / Механіка")


def test_a_source_that_fails_ends_no_other(spark):
    bad = spark.createDataFrame([("u", "x")], "url string, html string").withColumn("html", F.raise_error(F.lit("no such charset")).cast("string"))
    rows, failed = landing.extract_isolated({"olx": bad, "auto_ria": pages(spark, CARD_A), "rst": pages(spark, None)}, lambda x: spark.createDataFrame(x.collect(), x.schema))
    assert [r.source_id for r in rows.collect()] == ["77"] and list(failed) == ["olx"] and "no such charset" in failed["olx"]
