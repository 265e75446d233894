"""The registered queries of this package: one ``opN_<name>`` for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm import common


HARD_NEGATIVES = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT a.vec_id AS anchor_id, a.label AS anchor_label, r.vec_id AS row_id, r.label AS row_label, CAST(list_dot_product(a.q, r.q) AS BIGINT) AS score
    FROM v a JOIN v r ON r.vec_id <> a.vec_id WHERE a.vec_id % 50 = 0),
p AS (
    SELECT anchor_id, row_id AS positive_id, score AS positive_score FROM s WHERE row_label = anchor_label
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, row_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, row_id) AS INTEGER) AS rank,
    row_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE row_label <> anchor_label AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketloom.llm.quality_rules import quality_rules

    return quality_rules(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketloom.llm.html_extraction import extract_pages, learn

    pages = common.table(spark, sf_dir, "pages")
    return extract_pages(pages, learn(pages))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketloom.llm.packing import pack
    from marketloom.llm.token_counts import count_tokens

    counts = count_tokens(common.table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))
    return pack(common.materialize(counts.select("doc_id", "n_tokens"), "lengths"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketloom.llm.quality_classifier import classify

    return classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketloom.llm.suffix_dedup import repeats_of

    # 240 bytes are fewer than any passage of 50 words has
    return repeats_of(common.table(spark, sf_dir, "documents"), 400, passage=240)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketloom.llm.decontaminate import find_items

    return find_items(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketloom.llm.jaccard_join import jaccard_components

    return jaccard_components(common.table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketloom.llm.token_counts import count_tokens

    counts = count_tokens(common.table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


def op9_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketloom.llm.paragraph_dedup import paragraph_dedup

    return paragraph_dedup(common.table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketloom.llm.token_files import read_token_files, write_token_files

    path = common.new_path(spark, "token-files")
    write_token_files(common.table(spark, sf_dir, "documents"), path, _tokenizer("word_bpe_49k.json"), end_id=2)
    return read_token_files(spark, path)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketloom.llm.alignment import align

    out = align(common.table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), _tokenizer("piece_bpe_32k.model"))
    return out.withColumn("groups_sha256", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))).drop("groups")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketloom.llm.hard_negatives import mine

    return mine(common.table(spark, sf_dir, "embeddings"), relabel=(7, 10))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketloom.llm.bpe import decode, encode

    ranks = _tokenizer("byte_bpe_50k.tiktoken")
    ids = decode(encode(common.table(spark, sf_dir, "documents"), ranks), ranks)
    return ids.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op12_hard_negatives": HARD_NEGATIVES}
