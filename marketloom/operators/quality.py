"""Row validation with a quarantine, reference and uniqueness checks, deletes and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.schema import MAX_LENGTHS, SOURCES


def violations(columns: list[str], year: tuple[int, int] = (1990, 2015), mileage: int = 2_000_000, sources: list[str] | None = None) -> Column:
    """Codes of all rules that a row breaks, as an array; rules of missing columns are left out."""
    tests = []
    for c in ("source", "source_id", "url", "title"):
        if c in columns:
            tests.append(F.when(F.coalesce(F.trim(F.col(c)), F.lit("")) == "", F.lit(f"REQUIRED_{c.upper()}")))
    for c, most in MAX_LENGTHS.items():
        if c in columns:
            tests.append(F.when(F.length(c) > most, F.lit(f"TOO_LONG_{c.upper()}")))
    if "year" in columns:
        tests.append(F.when(~F.col("year").between(*year), F.lit("YEAR_RANGE")))
    if "mileage" in columns:
        tests.append(F.when(~F.col("mileage").between(0, mileage), F.lit("MILEAGE_RANGE")))
    for c in ("price", "price_usd"):
        if c in columns:
            tests.append(F.when(F.col(c) < 0, F.lit(f"NEGATIVE_{c.upper()}")))
    if sources is not None and "source" in columns:
        tests.append(F.when(~F.col("source").isin(sources), F.lit("UNKNOWN_SOURCE")))
    return F.array_compact(F.array(*tests))


def split_valid(df: DataFrame, known_sources: bool = False, **limits) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with their ``violations``)."""
    tested = df.withColumn("violations", violations(df.columns, sources=SOURCES if known_sources else None, **limits))
    return tested.where(F.size("violations") == 0).drop("violations"), tested.where(F.size("violations") > 0)


def orphans(df: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows whose reference is not in ``parent``; rows without a reference are no orphans."""
    return df.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def referenced(df: DataFrame, children: DataFrame, key: str, child_key: str) -> DataFrame:
    """Rows that some child refers to."""
    return df.join(children.select(F.col(child_key).alias(key)), key, "left_semi")


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their counts; keys with a null are left out."""
    whole = df
    for k in keys:
        whole = whole.where(F.col(k).isNotNull())
    return whole.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def delete_listings(listings: DataFrame, versions: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(listings, versions) without the ids in ``gone``: versions go along, references to them become null."""
    ids = gone.select("id").distinct()
    kept = listings.join(ids, "id", "left_anti")
    marked = kept.join(ids.select(F.col("id").alias("duplicate_of_id"), F.lit(True).alias("_gone")), "duplicate_of_id", "left")
    kept = marked.withColumn("duplicate_of_id", F.when(F.col("_gone").isNull(), F.col("duplicate_of_id"))).select(*listings.columns)
    return kept, versions.join(ids.select(F.col("id").alias("listing_id")), "listing_id", "left_anti")


def delete_sources(sources: DataFrame, listings: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sources that stay, ids refused because listings refer to them)."""
    refused = gone.select("id").distinct().join(listings.select(F.col("source").alias("id")), "id", "left_semi")
    allowed = gone.select("id").distinct().join(refused, "id", "left_anti")
    return sources.join(allowed, "id", "left_anti"), refused


def upsert(store: DataFrame, changes: DataFrame, *keys: str) -> DataFrame:
    """The snapshot with ``changes`` applied: a row of the same key is replaced, others are added."""
    same = store.join(changes.select(*keys), list(keys), "left_anti")
    return same.unionByName(changes, allowMissingColumns=True)


def insert_absent(store: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """``store`` and those ``rows`` whose key it lacks; the first of repeated new keys."""
    new = rows.dropDuplicates(list(keys)).join(store.select(*keys), list(keys), "left_anti")
    return store.unionByName(new, allowMissingColumns=True)


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
