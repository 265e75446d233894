"""Byte-level BPE against the tiktoken library, and the decoded bytes against the texts."""

import base64
import hashlib
import random

import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from marketloom.llm import bpe  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    import tiktoken

    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def same(library, ranks, texts):
    ids, ends = ranks.encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [library.encode_ordinary(t or "") for t in texts]


def test_every_code_point(library):
    ranks = bpe.Ranks(PATH)
    same(library, ranks, [f"x{chr(c)}x 1{chr(c)}1 {chr(c)} .{chr(c)}.\n{chr(c)}{chr(c)}" for c in range(0, 0x30000) if not 0xD800 <= c < 0xE000])


def test_texts(library, monkeypatch):
    ranks, rng = bpe.Ranks(PATH), random.Random(1)
    same(library, ranks, ["".join(rng.choices("ab stmdrevl'\n\t  '' .12é世　 界-", k=rng.randrange(60))) for _ in range(5000)] + [None, "", " ", "<|endoftext|>"])
    same(library, ranks, [])
    wide = ["a" * 5000, "-" * 3001, " " * 4000 + "x", "\n" * 700, "ab" * 1000 + "x", *("".join(rng.choices(s, k=rng.randrange(200, 900))) for s in ("ing", "etaoin", "世人民") for _ in range(40))]
    same(library, ranks, wide)
    monkeypatch.setattr(bpe, "CELLS", 64)
    same(library, bpe.Ranks(PATH), ["".join(rng.choices("abcdefgh", k=rng.randrange(40))) for _ in range(300)])


def test_long_text_in_pieces(library, monkeypatch):
    rng, calls = random.Random(2), []
    text = " ".join("".join(rng.choices("abc'é\n", k=rng.randrange(9))) for _ in range(4000))
    monkeypatch.setattr(bpe, "pieces", lambda data, offsets, f=bpe.pieces: [calls.append(x) or x for x in f(data, offsets, 500)])
    same(library, bpe.Ranks(PATH), ["x y", text, None, "é" * 2000, text[:900], ""])
    assert len(calls) > 20


def test_other_pattern(library):
    pattern = r"\s+|\S+"
    ranks = bpe.Ranks(PATH, pattern)
    ids, ends = ranks.encode(pa.array(["don't stop", "a  b"]))
    assert bytes(ranks.decode(ids)[0]) == b"don't stopa  b"
    with pytest.raises(ValueError):
        bpe.Ranks(PATH, r"\S+").encode(pa.array(["a b"]))
    with pytest.raises(ValueError):
        ranks.decode(pa.array([50256]).to_numpy())


def test_query(spark, library, tmp_path):
    from marketloom.llm.queries import op13_bpe

    texts = ["It's 12 o'clock\n\n  now", None, "", "x" * 3000 + " é世界", "It's 12 o'clock\n\n  now"]
    rows = [(1, texts[0]), (2, texts[1]), (None, texts[2]), (4, texts[3]), (1, texts[4])]
    spark.createDataFrame([(i, t, 1, "n", 2) for i, t in rows], "doc_id long, text string, id int, ids string, decoded int").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(i, len(ids := library.encode_ordinary(t or "")), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())) for i, t in rows]
    got = op13_bpe(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    from marketloom.llm.bpe import encode

    assert encode(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
