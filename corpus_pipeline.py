"""The corpus pipeline: documents through five of the training-data operators.

Each stage is a function of (spark, docs, sf_dir) that works on all that the stage before kept; all but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm import common
from marketloom.llm.decontaminate import drop_contaminated
from marketloom.llm.jaccard_join import drop_near_duplicates
from marketloom.llm.packing import pack
from marketloom.llm.quality_classifier import keep_good
from marketloom.llm.suffix_dedup import remove_spans, repeated_spans
from marketloom.llm.token_counts import count_tokens


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws; those it rejects go."""
    return keep_good(docs, common.table(spark, sf_dir, "labels"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, 0.8): that of the smallest id.

    Documents without words are no duplicates and stay; documents without an id are compared like others. Rows equal in
    id and text count as copies; different texts under one id are judged each on its own.
    """
    return drop_near_duplicates(docs, words=5, threshold_pct=80)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 240 bytes or more that stand elsewhere too."""
    cut = remove_spans(docs, repeated_spans(docs, 240))
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batches of the documents' token counts."""
    import public_tokenizers

    counts = count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return pack(common.materialize(counts.select("doc_id", "n_tokens"), "lengths"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("jaccard_join", jaccard_join),
    ("suffix_dedup", suffix_dedup),
    ("decontaminate", decontaminate),
    ("packing", packing),
]

#: The classifier's draw, suffix order and alignment have no SQL form; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.materialize(docs, f"stage-{name}")
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
