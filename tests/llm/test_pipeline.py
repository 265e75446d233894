import random

import pytest

pytest.importorskip("public_tokenizers")


def test_pipeline_keeps_what_brute_force_keeps(spark, tmp_path):
    """Planted junk, near copies, shared passages and benchmark items; clean documents stay whole."""
    from corpus_pipeline import STAGES, run
    from marketloom.llm.common import table

    rng = random.Random(12)
    vocabulary = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in ("ln", "rt", "st", "m", "nd")]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [prose(40) for _ in range(3)]
    clean = [prose(80) for _ in range(60)]
    near = clean[0].split()
    near[40] = "bum"
    passage = prose(60)
    rows = clean + [" ".join(near), prose(50) + " " + items[1] + " " + prose(20), prose(30) + "\n" + passage, prose(40) + "\n" + passage] + ["#$% " * 60 + str(i) for i in range(20)]
    documents = [(i, t, "en", "s", len(t)) for i, t in enumerate(rows)]
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(i < 60), 0) for i in [*range(60), *range(64, 84)]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    packed = {r.doc_id for r in run(spark, str(tmp_path)).collect()}
    # junk goes, of the near copies the smaller id stays, the leak goes, the shared passage is cut out
    assert packed == {*range(60), 62, 63}
    docs = table(spark, str(tmp_path), "documents")
    cut = {r.doc_id: r.text for r in dict(STAGES)["suffix_dedup"](spark, docs.where("doc_id in (1, 62, 63)"), str(tmp_path)).collect()}
    assert cut[1] == clean[1] and passage not in cut[62] and passage not in cut[63]
    assert [name for name, _ in STAGES] == ["quality_classifier", "jaccard_join", "suffix_dedup", "decontaminate", "packing"]
