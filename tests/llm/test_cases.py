"""Null and repeated ids, clashing names, empty tables, long texts and ties; more brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS = [f"w{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]


def prose(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


def table(spark, rows, **extra):
    clash = {c: F.lit(1) for c in ("row", "spans", "key", "log_weight", "node", "n", "row_key", "component")}
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns(clash | extra)


def test_multikey_order():
    from marketloom.llm.suffix_dedup import multikey_order

    rng = np.random.default_rng(1)
    tokens = rng.integers(0, 3, (500, 5)).astype(np.uint64)
    order, same = multikey_order(tokens)
    rows = [tuple(r) for r in tokens[order].tolist()]
    assert rows == sorted(map(tuple, tokens.tolist()))
    for i in range(1, 500):
        assert same[i] == next((d for d in range(5) if rows[i][d] != rows[i - 1][d]), 5)


def test_part_enum_loses_no_pair():
    """Sets at the threshold share a signature, for all sizes and ways to differ."""
    from marketloom.llm.jaccard_join import mix, signatures

    rng = np.random.default_rng(2)
    for pct in (80, 90):
        for n in (1, 4, 5, 9, 10, 11, 19, 40, 100, 333):
            for _ in range(12):
                pool = mix(rng.integers(1, 2**62, 3 * n + 9, dtype=np.uint64))
                gone = int(rng.integers(0, n - (pct * n + 99) // 100 + 1))
                a, b = pool[:n], pool[gone:n]
                while rng.random() < 0.8 and 100 * (n - gone) >= pct * (n + len(b) - (n - gone) + 1):
                    b = np.append(b, pool[n + len(b)])
                assert 100 * len(np.intersect1d(a, b)) >= pct * len(np.union1d(a, b))
                a, b = np.sort(a), np.sort(b)
                found, owner = signatures([a, b], pct)
                assert set(found[owner == 0].tolist()) & set(found[owner == 1].tolist()) or np.array_equal(a, b)


def test_near_duplicates_of_null_and_repeated_ids(spark):
    from marketloom.llm.jaccard_join import drop_near_duplicates, jaccard_components

    rng = random.Random(3)
    a, b, c, d = (prose(rng, 60) for _ in range(4))
    rows = [(None, a), (None, b), (3, c), (3, d), (5, a + " tail"), (7, c), (3, c), (8, ""), (9, None), (10, ""), (None, b)]
    kept = drop_near_duplicates(table(spark, rows)).collect()
    # a: id 5 before the one without; b: one of two equal rows; c: one of the rows of id 3; d under the same id stays; no words: all stay
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == sorted([(5, a + " tail"), (0, b), (3, c), (3, d), (8, ""), (9, ""), (10, "")])
    assert kept[0].asDict().keys() == table(spark, rows).first().asDict().keys()
    ids = sorted(((r.doc_id or 0), r.n_shingles, r.component_id or 0) for r in jaccard_components(table(spark, rows)).collect())
    assert ids == sorted([(0, 58, 5), (0, 58, 0), (0, 58, 0), (3, 58, 3), (3, 58, 3), (3, 58, 3), (5, 59, 5), (7, 58, 3), (8, 0, 8), (9, 0, 9), (10, 0, 10)])
    empty = table(spark, rows).limit(0)
    assert drop_near_duplicates(empty).count() == 0 and jaccard_components(empty).count() == 0


def test_common_signature_of_many_sets(spark):
    """A group of near copies far larger than a task lets share a signature, of which all are found."""
    from marketloom.llm import jaccard_join

    rng = random.Random(4)
    base = rng.choices(WORDS, k=200)
    rows = []
    for i in range(400):
        copy = list(base)
        copy[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    rows += [(1000 + i, prose(rng, 200)) for i in range(50)]
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(table(spark, rows).repartition(6), 3, 90).collect()}
    assert all(got[i] == 0 for i in range(400)) and all(got[1000 + i] == 1000 + i for i in range(50))


def test_suffix_rows(spark):
    from marketloom.llm.suffix_dedup import remove_spans, repeated_spans, repeats_of

    rng = random.Random(5)
    p, q = prose(rng, 120), prose(rng, 60)
    rows = [(1, "a " + p), (1, "other text " + prose(rng, 50)), (None, "b " + p), (2, q + " x"), (3, "y " + q), (4, None), (5, ""), (6, prose(rng, 40)), (6, None)]
    df = table(spark, rows)
    got = sorted(((r.doc_id or 0), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.repeated) for r in repeats_of(df, 400, 200).collect())
    want = []
    for i, t in rows:
        data, cut = (t or "").encode(), b""
        if t and p in t:
            cut = p.encode() if t[0] == "b" else b" " + p.encode()
            cut = b" " + p.encode()
        want.append((i or 0, len(data), len(cut), int(bool(cut)), hashlib.sha256(data.replace(cut, b"") if cut else data).hexdigest(), bool(t and (p in t or q in t))))
    assert got == sorted(want)
    cut = remove_spans(df, repeated_spans(df, 200))
    assert cut.columns == df.columns and sorted(r.text or "" for r in cut.collect()) == sorted((t or "").replace(" " + p, "").replace(q, "") for _, t in rows)
    assert repeats_of(df.limit(0), 400, 200).count() == 0


def test_passages_inside_lines(spark):
    """Passages of over 50 words inside longer lines or across lines are found in all their documents, and clean ones are left alone."""
    from marketloom.llm.paragraph_dedup import paragraph_dedup

    rng = random.Random(6)
    vocabulary = [f"{a}{b}{c}" for a in "bcdfghklmnprst" for b in "aeiou" for c in ("ln", "rt", "st", "m", "nd", "x", "z")]
    words = lambda n: rng.choices(vocabulary, k=n)
    rows, planted = [], set()
    for i in range(60):
        p = words(rng.randrange(51, 80))
        for j in range(rng.choice([2, 2, 3])):
            cut = rng.randrange(len(p))
            text = " ".join(words(rng.randrange(20, 90))) + " " + " ".join(p[:cut]) + rng.choice([" ", "\n"]) + " ".join(p[cut:]) + " " + " ".join(words(rng.randrange(20, 90)))
            planted.add(len(rows))
            rows.append((len(rows), text.upper() if j == 1 and i % 9 == 0 else text))
    rows += [(len(rows) + i, "\n".join(" ".join(words(rng.randrange(8, 60))) for _ in range(5))) for i in range(100)]
    got = {r.doc_id: r for r in paragraph_dedup(table(spark, rows)).collect()}
    caught = sum(got[i].repeated for i in planted)
    assert caught >= 0.95 * len(planted) and not any(got[i].repeated or got[i].n_removed for i, _ in rows if i not in planted)
    # what is removed in one document is kept in another
    texts = dict(rows)
    for i in planted:
        data = texts[i].encode()
        for a, b in got[i].removed_spans:
            piece = data[a:b].decode().lower().split()
            assert sum(" ".join(piece) in " ".join(t.lower().split()) for t in texts.values()) >= 2
    empty = paragraph_dedup(table(spark, rows).limit(0))
    assert empty.count() == 0
    odd = paragraph_dedup(table(spark, [(None, "x " * 60), (1, None), (2, ""), (2, "a b c d e f\na b c d e f"), (3, "go " * 5000)])).collect()
    assert len(odd) == 5 and not any(r.repeated for r in odd)


def test_base_signals(spark):
    from marketloom.llm.quality_rules import quality_rules

    rng = random.Random(7)
    texts = [None, "", "\n \n", "one two", "a b c d e " * 10, "x\ny\nx\n\nx", "#*$%&|<>] é ü"]
    for _ in range(60):
        lines = [" ".join(rng.choices(["a", "b", "c#", "d", "É|"], k=rng.randrange(0, 14))) for _ in range(rng.randrange(1, 6))]
        texts.append(rng.choice(["\n", "\n\n", " \x0b"]).join(lines))
    df = table(spark, list(enumerate(texts)), lang=F.lit("en"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_rules(df, labels).collect()}
    import re

    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = [tuple(w[j : j + 5]) for j in range(len(w) - 4)]
        covered = {k for j, x in enumerate(windows) if windows.count(x) > 1 for k in range(j, j + 5)}
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        assert r.base_failed == failed and r.kept == (not failed)
    assert quality_rules(df.limit(0), labels).count() == 0


def test_rules_are_certified(spark):
    """A stratum with enough good documents gets a rule, one with fewer does not; no rule rejects more than it may in the holdout."""
    from math import comb

    from marketloom.llm.quality_rules import certify, label_rows

    rng = random.Random(8)
    rows, labels = [], []
    for stratum, n in (("en", 400), ("de", 300), ("fr", 60)):
        for i in range(n):
            bad = i % 3 == 0
            symbols = rng.randrange(30, 60) if bad else rng.choice([0, 0, 0, 1, 2])
            rows.append((len(rows), stratum, 100, 100, symbols, 0, 10, 0, 5, 0))
            labels.append((rows[-1][0], int(not bad), 0))
    counts = spark.createDataFrame(rows, "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_lines long, n_repeat_words long, n_upper long, n_listed long")
    got = {r.stratum: r for r in certify(counts, label_rows(spark.createDataFrame(labels, "doc_id long, quality int, toxic int")), 0.05, 0.1, 10.0).collect()}
    assert set(got) == {"en", "de"}
    for stratum, r in got.items():
        good = [x for x, (_, q, _) in zip(rows, labels) if x[1] == stratum and q and hashlib.md5(str(x[0]).encode()).hexdigest() >= "8"]
        k = sum(x[4] / 100 > r.cut_symbol_ratio for x in good)
        p = sum(comb(len(good), i) * 0.05**i * 0.95 ** (len(good) - i) for i in range(k + 1))
        assert (r.holdout, r.false_rejections) == (len(good), k) and abs(r.p_value - p) < 1e-9 and p <= 0.1 / 3


def test_classifier_cases(spark):
    from marketloom.llm.quality_classifier import keep_good

    rng = random.Random(9)
    good, bad = [prose(rng, 80) for _ in range(60)], ["#$% " * 60 + str(i) for i in range(30)]
    rows = [(i, t) for i, t in enumerate(good + bad)] + [(None, good[0]), (None, None), (3, good[3]), (200, ""), (201, good[1] + " " + prose(rng, 30_000))]
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(90)] + [(5, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    df = table(spark, rows)
    kept = keep_good(df, labels)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert {*range(60)} <= set(ids) and not {*range(60, 90)} & set(ids) and 201 in ids and ids.count(3) == 2
    assert keep_good(df.limit(0), labels).count() == 0 and keep_good(df, labels.limit(0)).count() == len(rows)


def test_many_ties_at_the_last_place(spark):
    """Of very many equal weights exactly the smallest ids stay."""
    from marketloom.llm.quality_classifier import top_k

    keys = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 5, 2.0).otherwise(1.0).alias("key"))
    for k in (3, 5, 12_345, 29_999):
        kept = keys.where(top_k(keys, k)).agg(F.count("*"), F.max("doc_id")).first()
        assert tuple(kept) == (k, k - 1)


def test_stages_of_the_pipeline(spark, tmp_path):
    """Each stage on nulls, empty texts, repeated rows, other columns and an empty table."""
    from corpus_pipeline import STAGES

    rng = random.Random(10)
    rows = [(1, prose(rng, 60), "en"), (1, prose(rng, 60), None), (None, prose(rng, 60), "en"), (None, None, None), (2, "", "en"), (3, prose(rng, 60), "en"), (3, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"spans": F.lit(1), "row": F.lit("x"), "log_weight": F.lit(2.0), "key": F.lit(None).cast("int"), "n_chars": F.lit(3)})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, prose(rng, 30)), (None, "x"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == len(rows)
        assert i == len(STAGES) - 1 or out.columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_short_items_and_budgets(spark):
    from marketloom.llm.decontaminate import find_items

    rng = random.Random(11)
    text = "Start " + prose(rng, 30) + " short one " + prose(rng, 20)
    bench = spark.createDataFrame([(1, "short one"), (2, "Short  ONE"), (3, "absent"), (4, "t"), (5, "abcdefghijklmnopqrst"), (6, ""), (7, None)], "item_id long, text string")
    df = table(spark, [(1, text), (2, None), (3, ""), (4, "x abcdefghijXlmnopqrst y"), (5, "shortx one")])
    got = sorted((r.doc_id, r.item_id, r.edits) for r in find_items(df, bench).collect())
    assert [x for x in got if x[1] not in (4,)] == [(1, 1, 0), (1, 2, 0), (4, 5, 1)]
