"""Null and repeated ids: rows of their own, never dropped, never a failure."""

import zlib
from collections import Counter

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    from marketloom.llm.token_files import read_token_files, write_token_files

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = [(None, "no id"), (3, "three"), (None, None), (1, "one and one"), (1, "one and one"), (-5, ""), (None, "no id")] + [(None, f"text {i}") for i in range(40)]
    write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), f"file://{tmp_path}/t", path, partitions=6)
    got = read_token_files(spark, f"file://{tmp_path}/t", with_ids=True).collect()
    ids = lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((i, tuple(ids(t))) for i, t in rows)
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.n_tokens == len(r.ids) for r in got)
    at = 0
    got.sort(key=lambda r: r.start)
    for r in got:
        assert r.start == at
        at += r.n_tokens
    seen = [r.doc_id for r in got]
    assert seen == [None] * 43 + [-5, 1, 1, 3]


def test_benchmark_items(spark):
    from marketloom.llm.decontaminate import drop_contaminated, find_items

    item = "the quick brown fox jumps over the lazy dog and runs away from all of them"
    docs = spark.createDataFrame([(1, f"before {item} after"), (None, item), (2, "nothing of the kind"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(None, item), (None, None), (4, "")], "item_id long, text string")
    assert sorted((str(r.doc_id), r.item_id, r.edits) for r in find_items(docs, items).collect()) == [("1", None, 0), ("None", None, 0)]
    assert sorted(r.text or "" for r in drop_contaminated(docs, items).collect()) == ["", "nothing of the kind"]
