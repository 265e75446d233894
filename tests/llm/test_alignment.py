"""Alignment of two tokenizers against both libraries, with counts by brute force; perfect hashing."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from marketloom.llm import alignment, perfect_hash  # noqa: E402

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def brute():
    import sentencepiece
    from tokenizers import Tokenizer

    a, b, words = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), alignment.words_of(A, B)
    a.encode_special_tokens = True

    def groups(text):
        """[(ids of A, ids of B)], None where there are no tokens."""
        ids = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        parts = [[t.token[i] for i in x] for t, x in zip((words.a, words.b), ids)]
        if not text or any(b"".join(p) != (" " + text).encode() for p in parts):
            return []
        ends = [np.cumsum([*map(len, p)]).tolist() for p in parts]
        both, out, at = sorted({*ends[0]} & {*ends[1]}), [], [0, 0]
        for e in both:
            to = [x.index(e, k) + 1 for x, k in zip(ends, at)]
            out.append(tuple(x[k:n] for x, k, n in zip(ids, at, to)))
            at = to
        return out

    return groups


def written(groups):
    return ";".join("|".join(",".join(map(str, x)) for x in g) for g in groups)


def test_groups(brute):
    words = alignment.words_of(A, B)
    rng = random.Random(1)
    texts = [f"x{chr(c)}x 1{chr(c)}1 {chr(c)} .{chr(c)}.\n{chr(c)}{chr(c)}" for c in [*range(0, 0x3000), *range(0xFE00, 0x10400)] if not 0xD800 <= c < 0xE000]
    texts += ["".join(rng.choices("ab T\n  .é▁①<s>\t0'|e世", k=rng.randrange(40))) for _ in range(4000)]
    texts += [None, "", " ", "  ", "\n", " \n\n a", "<|endoftext|> <s></s><0x41>", "▁", "a▁b", "x" * 5000, " -" * 3000]
    assert alignment.Aligned(words, pa.array(texts)).groups() == [written(brute(t)) for t in texts]


def rows():
    rng = random.Random(3)
    texts = ["".join(rng.choices(["the ", "tokens", " merge", "d.", "\n", "é", "ing ", "unbe", "liev"], k=rng.randrange(30))) for _ in range(60)]
    return [(None if i % 9 == 4 else i // 2, t) for i, t in enumerate(texts + [None, "", "a▁b", texts[0], " ", "word " * 2000])]


def expected(brute, table):
    groups = [brute(t) for _, t in table]
    count = Counter((a[-1], b[-1]) for g in groups for a, b in g)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    for (i, _), g in zip(table, groups):
        n = [(count[a[-1], b[-1]], b[-1]) for a, b in g]
        text = written(g)
        yield i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(g), sum(x == best[b] for x, b in n), sum(x for x, _ in n), text and hashlib.sha256(text.encode()).hexdigest()


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_query(spark, brute, tmp_path):
    from marketloom.llm.queries import op11_token_alignment

    table = rows()
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in table], "doc_id long, text string, pair int, groups string, task int")
    docs.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = op11_token_alignment(spark, str(tmp_path)).select(COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == sorted(expected(brute, table), key=str)


def test_joined_and_tree(spark, brute, monkeypatch):
    """The way beyond what is broadcast, several shards and levels of the tree; an empty table."""
    from pyspark.sql import functions as F

    table = rows()
    docs = spark.createDataFrame(table, "doc_id long, text string")
    monkeypatch.setattr(alignment, "SHARD_KEYS", 7)
    monkeypatch.setattr(alignment, "FAN", 2)
    monkeypatch.setattr(alignment, "HOT_PAIRS", 30)
    want = sorted(expected(brute, table), key=str)
    for few in (0, 10**6):
        got = alignment.align(docs.repartition(9), A, B, few_pairs=few)
        got = got.withColumn("groups_sha256", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))).select(COLUMNS).collect()
        assert sorted(map(tuple, got), key=str) == want
        assert alignment.align(docs.limit(0), A, B, few_pairs=few).count() == 0
        assert alignment.align(docs.where("text is null or text = ''"), A, B, few_pairs=few).selectExpr("sum(n_a + count_sum)").first()[0] == 0


def test_words_are_forgotten(brute, monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 20)
    words = alignment.Words(alignment.ByteLevel(A), alignment.Pieces(B))
    for texts in ([t for _, t in rows()[:30]], [t for _, t in rows()[20:]]):
        assert alignment.Aligned(words, pa.array(texts)).groups() == [written(brute(t)) for t in texts]


def test_perfect_hash():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**62, 30_000))
    inside, others = keys[::2], keys[1::2]
    shard = perfect_hash.shard_hash(inside) % 5
    table = perfect_hash.Table([perfect_hash.build(inside[shard == i]) for i in range(5)])
    at = table(inside)
    assert sorted(at.tolist()) == [*range(len(inside))] and (table.keys[at] == inside).all()
    assert (table(others) == -1).all()
    none = perfect_hash.Table([perfect_hash.build(inside[:0])])
    assert (none(others) == -1).all() and len(none(inside[:0])) == 0
    with pytest.raises(ValueError):
        perfect_hash.build(np.array([5, 5]))
