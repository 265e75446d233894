import random
from decimal import Decimal

from pyspark.sql import functions as F

from marketloom.operators.commands import fold_commands
from marketloom.operators.dedup import deduplicate
from marketloom.operators.history import fold_prices, version_rows
from marketloom.operators.quality import delete_listings, split_valid


def sequential(rows, store):
    """Row at a time: identity, then URL, then fingerprint; duplicates take the root of the earliest match."""
    seen, out = [], []
    for s in store:
        seen.append({"key": s[1:3], "url": s[3], "fp": s[4], "place": ("s", s[0]), "root": ("s", s[5] or s[0])})
    for r in rows:
        known = next((x for x in seen if x["key"] == r[1:3]), None)
        if known:
            out.append((r[0], 1, known["root"]))
            continue
        by_url = next((x for x in seen if x["url"] and x["url"] == r[3]), None)
        by_fp = next((x for x in seen if x["fp"] and x["fp"] == r[4]), None)
        level, hit = (2, by_url) if by_url else (3, by_fp) if by_fp else (0, None)
        me = {"key": r[1:3], "url": r[3], "fp": r[4], "place": ("b", r[0])}
        me["root"] = hit["root"] if hit else me["place"]
        seen.append(me)
        out.append((r[0], level, me["root"]))
    return out


def test_against_sequential_model(spark):
    rng = random.Random(4)
    for round_ in range(3):
        pick = lambda p, n: rng.choice([None, *[f"{p}{i}" for i in range(n)]])
        store = [] if round_ == 0 else [(100 + i, "a", f"s{i}", pick("u", 6), pick("f", 6), None) for i in range(6)]
        rows = [(i, rng.choice("ab"), f"{rng.choice('st')}{rng.randrange(12)}", pick("u", 14), pick("f", 14)) for i in range(60)]
        batch = spark.createDataFrame(rows, "seq long, source string, source_id string, canonical_url string, content_fingerprint string")
        known = spark.createDataFrame(store, "id long, source string, source_id string, canonical_url string, content_fingerprint string, duplicate_of_id long") if store else None
        got = {r.seq: (r.dedup_level, ("b", r.root.seq) if r.root.part else ("s", r.root.id)) for r in deduplicate(batch, ["seq"], known).collect()}
        assert got == {seq: (level, root) for seq, level, root in sequential(rows, store)}


def test_price_fold_drifts(spark):
    prices = [None, "100", "99.5", "99.0", None, "99.4", "150"]
    df = spark.createDataFrame([("x", i, p) for i, p in enumerate(prices)] + [("y", 0, "5"), ("y", 1, "5.5")], "k string, seq int, p string").withColumn("price", F.col("p").cast("decimal(12,2)"))
    folded = fold_prices(df, ["k"], ["seq"])
    rows = [(r.k, r.version, r.change_type, r.price, r.price_diff) for r in version_rows(folded, ["k"]).orderBy("k", "version").collect()]
    d = Decimal
    assert rows == [("x", 0, "INITIAL", d("0.00"), d("0.00")), ("x", 1, "PRICE_SET", d("100.00"), d("0.00")), ("x", 2, "PRICE_DROP", d("99.00"), d("-1.00")), ("x", 3, "PRICE_INCREASE", d("150.00"), d("51.00")), ("y", 0, "INITIAL", d("5.00"), d("0.00"))]


def test_command_fold(spark):
    log = [("1", 1, "toggle_eng", "2.4"), ("1", 2, "text", "3500-5500"), ("1", 3, "set_year", "rest"), ("1", 4, "toggle_model", "A6C5"), ("1", 5, "text", "до 250 тис км"), ("2", 1, "set_trans", "manual"), ("2", 2, "action_reset", "")]
    got = {r.chat_id: r for r in fold_commands(spark.createDataFrame(log, "chat_id string, seq int, kind string, arg string")).collect()}
    one = got["1"]
    assert (one.engines, one.min_price, one.max_price, one.min_year, one.max_year, one.selected_models, one.max_mileage) == (["1.8T", "1.9 TDI"], 3500, 5500, 2001, 2005, ["A6 C5"], 250_000)
    assert got["2"].transmission == "any"


def test_quality_and_delete(spark):
    df = spark.createDataFrame([("olx", "1", "u", "t", 2000, 5), ("olx", "", "u", "t", 1980, -1)], "source string, source_id string, url string, title string, year int, mileage int")
    good, bad = split_valid(df)
    assert good.count() == 1 and bad.first().violations == ["REQUIRED_SOURCE_ID", "YEAR_RANGE", "MILEAGE_RANGE"]
    own = spark.createDataFrame([(1, None), (2, 1), (3, 2)], "id long, duplicate_of_id long")
    kept, versions = delete_listings(own, spark.createDataFrame([(1,), (2,)], "listing_id long"), spark.createDataFrame([(1,)], "id long"))
    assert sorted(map(tuple, kept.collect())) == [(2, None), (3, 2)] and versions.count() == 1


def test_tables_written_between_steps_are_narrow(spark):
    """URLs and fingerprints go into no table that is written down, and a round of pointers has no row that is its own root."""
    from marketloom.tables import written

    batch = spark.createDataFrame([(i, "a", f"s{i}", f"u{i % 50}", f"f{i}") for i in range(60)], "seq long, source string, source_id string, canonical_url string, content_fingerprint string")
    seen = []

    def note(df):
        out = written(df)
        seen.append((set(out.columns), out.count()))
        return out

    got = deduplicate(batch, ["seq"], materialize=note)
    assert sorted((r.seq, r.dedup_level, r.root.seq) for r in got.collect()) == [(i, 2 if i >= 50 else 0, i % 50) for i in range(60)]
    assert not [c for c, _ in seen if c & {"canonical_url", "content_fingerprint"}]
    assert [n for c, n in seen if "moved" in c] == [10]
