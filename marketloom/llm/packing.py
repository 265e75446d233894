"""Packing by optimal length buckets.

The global histogram of token counts gives the bucket boundaries by dynamic programming: of all ways to
cut it into at most ``buckets`` intervals, the one with the least padding when every document is padded
to its bucket's longest. Inside a bucket, documents in a random order fill batches whose padded size stays
within the token budget.

The histogram has a cell for each length below 2**MANTISSA and 2**MANTISSA cells for each power of two
above, so it stays a few thousand rows for any corpus; boundaries are lengths that occur, and the result is
the optimum over cuts between cells (over all cuts, when no cell holds two lengths).

Ranks inside a bucket are two-level: rows are ranked inside shards of bounded size, and the shards' counts
are summed up, so a bucket with most of the rows is no larger task than others.

Cases: documents without tokens have length 0 and are batched like others. A document longer than the
budget has a batch of its own. Null ids and repeated rows are batched as they come. An empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MANTISSA = 8
#: Rows in a shard, about.
SHARD_ROWS = 50_000


def cell(length: Column) -> Column:
    """The histogram cell of a length: its leading bits and how many are cut off."""
    shift = F.greatest(F.length(F.bin(length)) - MANTISSA - 1, F.lit(0))
    return F.struct(shift.alias("shift"), F.floor(length / F.pow(F.lit(2.0), shift)).alias("lead"))


def histogram(lengths: DataFrame) -> DataFrame:
    """``n``, ``total`` and ``longest`` of each cell of ``n_tokens``."""
    length = F.col("n_tokens").cast("long")
    return lengths.groupBy(cell(length).alias("cell")).agg(F.count("*").alias("n"), F.sum(length).alias("total"), F.max(length).alias("longest")).drop("cell")


def best_bounds(cells: list[tuple[int, int, int]], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` intervals with the least padding; ``cells``: (n, total, longest) by rising length."""
    import numpy as np

    if not cells:
        return []
    n, total, longest = (np.array(x, np.float64) for x in zip(*cells))
    count, size = np.concatenate(([0.0], np.cumsum(n))), np.concatenate(([0.0], np.cumsum(total)))
    g = len(cells)
    best = np.full(g + 1, np.inf)
    best[0] = 0.0
    back: list = []
    for _ in range(min(buckets, g)):
        # the last bucket spans cells i .. j - 1
        now, via = np.full(g + 1, np.inf), np.zeros(g + 1, np.int64)
        now[0] = 0.0
        for j in range(1, g + 1):
            cost = best[:j] + (count[j] - count[:j]) * longest[j - 1] - (size[j] - size[:j])
            via[j] = int(np.argmin(cost))
            now[j] = cost[via[j]]
        back.append(via)
        best = now
    bounds, j = [], g
    for via in reversed(back):
        if j == 0:
            break
        bounds.append(int(longest[j - 1]))
        j = int(via[j])
    return bounds[::-1]


def pack(lengths: DataFrame, buckets: int = 16, token_budget: int = 65_536, seed: int = 1) -> DataFrame:
    """Batches of ``lengths`` (``doc_id``, ``n_tokens``): adds ``bucket``, ``padded_to``, ``batch`` and ``slot``.

    ``lengths`` is read three times, so hand in a table that is written down.
    """
    lengths = lengths.select("doc_id", F.coalesce(F.col("n_tokens"), F.lit(0)).cast("long").alias("n_tokens"))
    cells = sorted((tuple(r) for r in histogram(lengths).collect()), key=lambda c: c[2])  # a few thousand rows
    bounds = best_bounds(cells, buckets)
    if not bounds:
        kinds = {"bucket": "int", "padded_to": "long", "batch": "long", "slot": "int"}
        return lengths.select("*", *[F.lit(None).cast(k).alias(c) for c, k in kinds.items()]).where("false")
    inside = [sum(n for n, _, longest in cells if (i == 0 or longest > bounds[i - 1]) and longest <= b) for i, b in enumerate(bounds)]
    shards = [max(1, -(-n // SHARD_ROWS)) for n in inside]
    room = [max(1, token_budget // max(b, 1)) for b in bounds]
    bucket = F.lit(0)
    for b in bounds[:-1]:
        bucket = bucket + (F.col("n_tokens") > b).cast("int")

    def of(values: list[int]) -> Column:
        return F.get(F.array(*[F.lit(v).cast("long") for v in values]), F.col("bucket"))

    rows = lengths.withColumn("bucket", bucket).withColumn("mix", F.xxhash64("doc_id", F.lit(seed)))
    rows = rows.withColumn("shard", F.pmod("mix", of(shards)))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("mix", "doc_id")))
    counts = rows.groupBy("bucket", "shard").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("bucket").orderBy("shard")) - F.col("n")
    offsets = counts.select("bucket", "shard", before.alias("before"))
    place = F.col("before") + F.col("rank") - 1
    out = ranked.join(offsets, ["bucket", "shard"]).withColumn("place", place)
    return out.select("doc_id", "n_tokens", "bucket", of(bounds).alias("padded_to"), F.floor(F.col("place") / of(room)).alias("batch"), F.pmod("place", of(room)).cast("int").alias("slot"))
