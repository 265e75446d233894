"""Each operator on small tables: brute force, and nulls, empty texts, repeats, empty tables, clashing names."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS = [f"w{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]


def texts(seed=1, n=40, words=120):
    rng = random.Random(seed)
    out = [" ".join(rng.choices(WORDS, k=rng.randrange(5, words))) for _ in range(n)]
    return out + [None, "", " \n ", out[0], out[1] + " tail", "é\x0b１ <|endoftext|> x" * 3]


def docs(spark, rows, **extra):
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string").withColumns({"n": F.lit(1), "node": F.lit("x"), "key": F.lit(2)} | extra)


def test_token_counts(spark):
    import sentencepiece

    from marketloom.llm.token_counts import count_tokens

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(2)
    rows = texts() + ["".join(rng.choices("ab T\n  .é▁①<s>\t0'", k=rng.randrange(20))) for _ in range(300)]
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in count_tokens(docs(spark, rows), path).collect()}
    assert got == {i: (len((t or "").encode()), len(model.encode(t or ""))) for i, t in enumerate(rows)}
    assert count_tokens(docs(spark, rows).limit(0), path).count() == 0


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    from marketloom.llm import simple8b
    from marketloom.llm.token_files import read_token_files, write_token_files

    rng = np.random.default_rng(1)
    for high in (1, 300, 2**20, 2**63):
        x = rng.integers(0, high, 5000, dtype=np.uint64, endpoint=True)
        assert (simple8b.decode(*simple8b.encode(x)) == x).all()
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, rows = Tokenizer.from_file(path), texts()
    write_token_files(docs(spark, rows), f"file://{tmp_path}/t", path)
    start = 0
    for r in sorted(read_token_files(spark, f"file://{tmp_path}/t", with_ids=True).collect()):
        ids = tokenizer.encode(rows[r.doc_id] or "", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids, r.ids_crc32) == (start, len(ids), ids, zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    write_token_files(docs(spark, rows).limit(0), f"file://{tmp_path}/e", path)
    assert read_token_files(spark, f"file://{tmp_path}/e").count() == 0


def test_suffix_dedup(spark):
    from marketloom.llm.suffix_dedup import removal_digest, repeated_spans

    rng = random.Random(3)
    common = " ".join(rng.choices(WORDS, k=60))
    rows = texts(4) + [common + " a b c", "x " + common, "é" * 300, common[:120] + "Z" + common[121:], "ab" * 200]
    length = 100
    data = [(t or "").encode() for t in rows]
    seen: dict = {}
    for b in data:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    want = {}
    for d, b in enumerate(data):
        gone = set()
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone.update(range(i, i + length))
        want[d] = (len(b), len(gone), sum(i - 1 not in gone for i in gone))
    df = docs(spark, rows)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in removal_digest(df, repeated_spans(df, length)).collect()}
    assert got == want
    empty = df.limit(0)
    assert removal_digest(empty, repeated_spans(empty, length)).count() == 0


def components(sets, linked):
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and linked(sets[i], sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(sets))]


def test_jaccard_join(spark):
    from marketloom.llm.jaccard_join import jaccard_components

    rng = random.Random(5)
    rows = texts(6, 20)
    base = rng.choices(WORDS, k=150)
    for k in (1, 2, 3, 4, 5, 8) * 3:
        copy = list(base)
        for _ in range(k):
            copy[rng.randrange(len(copy))] = rng.choice(WORDS)
        rows.append(" ".join(copy).upper() if k == 3 else " ".join(copy))
    rows += ["a b", "A b", "c"]
    words = [(t or "").lower().split() for t in rows]
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else ({tuple(w)} if w else set()) for w in words]
    want = components(sets, lambda a, b: 100 * len(a & b) >= 90 * len(a | b))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs(spark, rows)).collect()}
    assert got == {i: (len(s), c) for i, (s, c) in enumerate(zip(sets, want))}


def test_paragraph_dedup(spark):
    from marketloom.llm.paragraph_dedup import paragraph_dedup, tune_bands

    bands, rows_of = tune_bands(80)
    assert (1 - 0.8**rows_of) ** bands <= 1e-3
    rng = random.Random(7)
    p = [" ".join(rng.choices(WORDS, k=40)) for _ in range(4)]
    near = p[1].split()
    near[3] = "changed"
    rows = [p[0] + "\nshort line\n" + p[1], None, "", p[0], " ".join(near) + "\nshort line\n" + p[2], p[2] + "\n" + p[2]]
    got = {r.doc_id: (r.n_removed, r.removed_lines, r.kept_in) for r in paragraph_dedup(docs(spark, rows)).collect()}
    assert got == {0: (0, [], []), 1: (0, [], []), 2: (0, [], []), 3: (1, [0], [0]), 4: (1, [0], [0]), 5: (2, [0, 1], [4])}


def test_paragraphs_of_few_words(spark):
    from marketloom.llm.paragraph_dedup import paragraph_dedup

    eight, five = "please read our privacy policy before you continue", "all rights reserved by us"
    nine = eight + " today"
    rows = [eight, "four words are kept\n" + five, "four words are kept\n" + eight.upper(), five + "\n  " + eight, nine, five[:-2] + "them\nall rights reserved"]
    got = {r.doc_id: (r.removed_lines, r.n_removed_chars, r.kept_in) for r in paragraph_dedup(docs(spark, rows)).collect()}
    assert got == {0: ([], 0, []), 1: ([], 0, []), 2: ([1], len(eight), [0]), 3: ([0, 1], len(five) + 2 + len(eight), [0, 1]), 4: ([0], len(nine), [0]), 5: ([], 0, [])}


def test_decontaminate(spark):
    from marketloom.llm.decontaminate import drop_contaminated, find_items

    rng = random.Random(8)
    items = [" ".join(rng.choices(WORDS, k=30)) for _ in range(5)]
    edited = items[1][:40] + "#" + items[1][41:]
    far = "".join(c if i % 6 else "#" for i, c in enumerate(items[2]))
    rows = texts(9) + ["pre " + items[0].upper().replace(" ", "\n ") + " post", edited, far, items[3]]
    bench = spark.createDataFrame([*enumerate(items), (7, None), (8, "tiny")], "item_id long, text string")
    df = docs(spark, rows)
    n = len(texts(9))
    assert sorted((r.doc_id, r.item_id, r.edits) for r in find_items(df, bench).collect()) == [(n, 0, 0), (n + 1, 1, 1), (n + 3, 3, 0)]
    assert drop_contaminated(df, bench).count() == len(rows) - 3
    assert find_items(df, bench.limit(0)).count() == 0


def test_packing_is_optimal(spark):
    from itertools import combinations

    from marketloom.llm.packing import best_bounds, pack

    lengths = [3, 3, 4, 9, 10, 10, 30, 31, 90]
    cells = [(lengths.count(x), x * lengths.count(x), x) for x in sorted(set(lengths))]
    cost = lambda bounds: sum(min(b for b in bounds if b >= x) - x for x in lengths)
    best = min(cost((*c, 90)) for c in combinations(sorted(set(lengths))[:-1], 2))
    assert cost(best_bounds(cells, 3)) == best
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lengths * 30)] + [(None, 0)], "doc_id long, n_tokens long")
    rows = pack(df, buckets=3, token_budget=100).collect()
    assert len(rows) == len(lengths) * 30 + 1
    room = {}
    for r in rows:
        room.setdefault((r.bucket, r.batch), []).append(r.slot)
        assert r.n_tokens <= r.padded_to
    assert all(sorted(s) == list(range(len(s))) for s in room.values())
    assert pack(df.limit(0)).count() == 0


def test_html(spark):
    from marketloom.llm.html_extraction import extract, extract_pages

    page = (
        '<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><a>menu</a></nav><div class="cookie-notice">We use cookies</div><article><h1>Head &amp; line</h1>'
        "<p>One  two\n three.<br>Four &lt;b&gt; <i>five</i> a < b</p><div class='ad'>buy now</div><p>Six seven eight</p><div id=comments><p>nice</p></div></article><aside>side bar words</aside><footer>foot</footer>"
    )
    assert extract(page, {}) == "Head & line\nOne two three.\nFour <b> five a < b\nSix seven eight"
    df = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "v", ""), (4, "w", "<p>cut <a href='x")], "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in extract_pages(df, {}).collect()}
    assert got[2] == ("", 0) and got[3] == ("", 0) and got[4][0] == "cut"


def test_binomial_tail(spark):
    from math import comb

    from marketloom.llm.quality_rules import binomial_tail

    df = spark.createDataFrame([(0, 50), (1, 200), (3, 400), (9, 100)], "k long, n long")
    for r in df.select("k", "n", binomial_tail(F.col("k"), F.col("n"), 0.02).alias("p")).collect():
        want = sum(comb(r.n, i) * 0.02**i * 0.98 ** (r.n - i) for i in range(r.k + 1)) if r.k < r.n * 0.02 else 1.0
        assert abs(r.p - want) < 1e-9


def test_quality(spark):
    from marketloom.llm.quality_classifier import classify
    from marketloom.llm.quality_rules import quality_rules

    rng = random.Random(10)
    clean = [" ".join(rng.choices(WORDS, k=60)) for _ in range(400)]
    junk = [" ".join(w + "###" for w in rng.choices(WORDS, k=60)) for _ in range(100)]
    rows = clean + junk + [None, "", "one two", "a b c d e " * 10]
    df = docs(spark, rows, lang=F.lit("en"))
    labels = spark.createDataFrame([(i, int(i < 400), 0) for i in range(500)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_rules(df, labels, alpha=0.5).collect()}
    assert all(got[i].kept for i in range(400)) and not any(got[i].kept for i in range(400, 504))
    assert (got[503].n_words, got[503].n_repeat_words, got[503].base_failed) == (50, 50, True)
    assert (got[400].n_symbols, got[500].n_words) == (180, 0)
    kept = {r.doc_id: r.kept for r in classify(df, labels).collect()}
    assert sum(kept[i] for i in range(400)) >= 396 and sum(kept[i] for i in range(400, 500)) <= 1
    assert all(r.kept for r in classify(df.limit(5), labels.limit(0)).collect())
