"""Quality classifier by importance resampling.

Two generative models over hashed byte n-grams, one of target text (documents labelled good and not
toxic) and one of the raw corpus (every whole text), give each n-gram a log ratio of probabilities.
A gram that already stands within the last ``LAG`` bytes counts as one shared "said again" feature, so
that repetition has a probability of its own. The log importance weight of a document is that of its
least target-like passage: the smallest sum of log ratios over ``WINDOWS`` of successive grams (longer
windows are scaled down), because one bad passage spoils a long document and length must not decide.

Documents are drawn without replacement by Gumbel top-k: the k largest log weights, each with Gumbel
noise from a hash of the document id. k is the number of documents whose weight reaches a cutoff, and
the cutoff is the one that best parts good from bad among labelled documents that no model has seen.
Selecting the k largest is exact and distributed: histograms of ever narrower ranges, of which only
``BINS`` counts at a time reach the driver.

Cases: null and empty texts, and texts shorter than a gram, have no grams and weight 0 before noise.
Documents without labels are scored like others. Labels repeated for a document count once, as bad if
any says so. Without labels of both kinds nothing is rejected. Ties at the k-th place go to the smaller id, those
without an id last; repeated rows share their key and stay or go together. Other columns stay as they are, whatever their names.
Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.llm.common import discard, materialize, slices, text_bytes, tidy

GRAM = 5
BITS = 18
#: One more feature than hashed grams: the gram said again.
FEATURES = (1 << BITS) + 1
LAG = 32
#: Grams in a passage -> what the sum of its log ratios is divided by.
WINDOWS = {8: 1.0, 64: 3.0}
SMOOTHING = 3.0
BINS = 1024
#: Text handled at once; scoring holds several 64-bit numbers for each byte.
SCORE_BYTES = 1 << 19


def gram_features(data, offsets) -> tuple:
    """(feature of the gram at each byte, which bytes begin a gram of their own text)."""
    import numpy as np

    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int32), np.zeros(0, bool)
    four = np.ndarray((n,), "<u4", np.ascontiguousarray(data), strides=(1,))
    code = four.astype(np.uint64) | data[GRAM - 1 :].astype(np.uint64) << np.uint64(32)
    code *= np.uint64(0x9E3779B97F4A7C15)
    feature = (code >> np.uint64(64 - BITS)).astype(np.int32)
    again = np.zeros(n, bool)
    for lag in range(2, min(LAG, n - 1) + 1):
        again[lag:] |= feature[lag:] == feature[:-lag]
    ends = np.repeat(offsets[1:], np.diff(offsets))[:n]
    begins = np.repeat(offsets[:-1], np.diff(offsets))[:n]
    # at the start of a text, look back only as far as the text goes
    for at in offsets[1:-1]:
        lo, hi = int(at), min(int(at) + LAG, n)
        for i in range(lo, hi):
            if again[i]:
                again[i] = (feature[max(int(begins[i]), i - LAG) : i - 1] == feature[i]).any()
    feature[again] = FEATURES - 1
    return feature, np.arange(n) + GRAM <= ends


def count_grams(df: DataFrame) -> DataFrame:
    """``feature``, ``raw`` and ``target`` counts over texts; rows with ``target`` true count in both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        raw, target = np.zeros(FEATURES, np.int64), np.zeros(FEATURES, np.int64)
        for batch in batches:
            for part in slices(batch, "text", SCORE_BYTES):
                data, offsets = text_bytes(part.column("text"))
                feature, valid = gram_features(data, offsets)
                raw += np.bincount(feature[valid], minlength=FEATURES)
                mine = np.repeat(part.column("target").to_numpy(zero_copy_only=False).astype(bool), np.diff(offsets))[: len(feature)]
                target += np.bincount(feature[valid & mine], minlength=FEATURES)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(raw[used]), pa.array(target[used])], ["feature", "raw", "target"])

    each = df.mapInArrow(tidy(run), "feature int, raw long, target long")
    return each.groupBy("feature").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame):
    """The log ratio of every feature as one array; at most ``FEATURES`` rows reach the driver."""
    import numpy as np

    rows = counts.toArrow()
    raw, target = np.zeros(FEATURES), np.zeros(FEATURES)
    raw[rows["feature"].to_numpy()] = rows["raw"].to_numpy()
    target[rows["feature"].to_numpy()] = rows["target"].to_numpy()
    if not target.sum():
        return np.zeros(FEATURES, np.float32)
    expected = raw * (target.sum() / raw.sum())
    return np.log((target + SMOOTHING) / (expected + SMOOTHING)).astype(np.float32)


def score(df: DataFrame, ratios) -> DataFrame:
    """``df``, with a ``doc_id`` and a ``text``, and the ``log_weight`` of every row."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for part in slices(batch, "text", SCORE_BYTES):
                data, offsets = text_bytes(part.column("text"))
                feature, valid = gram_features(data, offsets)
                sums = np.concatenate(([0.0], np.cumsum(np.where(valid, ratios[feature], 0.0), dtype=np.float64)))
                grams = np.maximum(np.diff(offsets) - GRAM + 1, 0)
                out = np.full(len(grams), np.inf)
                for wide, scale in WINDOWS.items():
                    # all windows that lie in one text; a text with fewer grams is one window
                    size = np.minimum(wide, grams)
                    long = grams >= wide
                    passage = sums[wide:] - sums[:-wide] if len(sums) > wide else np.zeros(0)
                    if long.any():
                        inside = np.full(len(passage) + 1, np.inf)
                        inside[:-1] = passage
                        edges = np.stack([offsets[:-1][long], offsets[:-1][long] + grams[long] - wide + 1], 1).ravel()
                        out[long] = np.minimum(out[long], np.minimum.reduceat(inside, edges)[::2] / scale)
                    short = ~long & (grams > 0)
                    out[short] = np.minimum(out[short], (sums[offsets[:-1][short] + size[short]] - sums[offsets[:-1][short]]) / scale)
                out[grams == 0] = 0.0
                given = [x for c, x in zip(part.schema.names, part.columns) if c in names]
                yield pa.RecordBatch.from_arrays([*given, pa.array(out)], [*names, "log_weight"])

    kinds = T.StructType([*df.schema.fields, T.StructField("log_weight", T.DoubleType())])
    return df.mapInArrow(tidy(run), kinds)


def label_rows(labels: DataFrame) -> DataFrame:
    """One row for each labelled document: ``doc_id``, ``good`` and ``digest``."""
    rows = labels.where("doc_id is not null and quality is not null and toxic is not null")
    rows = rows.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"), F.md5(F.col("doc_id").cast("string")).alias("digest"))


def best_cutoff(scores: DataFrame, held_out: DataFrame, loss: float) -> float:
    """The weight that best parts good from bad: the share of bad below, less ``loss`` times that of good below."""
    import numpy as np

    # as many rows as the bounded sample has
    rows = scores.join(F.broadcast(held_out), "doc_id").select("log_weight", "good").toArrow()
    weight, good = rows["log_weight"].to_numpy(), rows["good"].to_numpy(zero_copy_only=False).astype(bool)
    if not good.any() or good.all():
        return float("-inf")
    order = np.argsort(weight, kind="stable")
    weight, good = weight[order], good[order]
    gain = np.cumsum(~good) / (~good).sum() - loss * np.cumsum(good) / good.sum()
    gain[:-1][weight[:-1] == weight[1:]] = -np.inf  # no cut between equal weights
    best = int(np.argmax(gain))
    if gain[best] <= 0:
        return float("-inf")
    return float((weight[best] + weight[min(best + 1, len(weight) - 1)]) / 2)


def top_k(keys: DataFrame, k: int) -> Column:
    """The condition on ``key`` and ``doc_id`` that holds for the ``k`` first rows by falling key, then rising id."""
    if k <= 0:
        return F.lit(False)
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    above = 0  # rows above high
    if low is None:
        return F.lit(True)
    while True:
        inside = keys.where((F.col("key") >= low) & (F.col("key") <= high))
        width = (high - low) / BINS
        if not width > 0 or low + width == low:
            break
        at = F.least(F.floor((F.col("key") - low) / width), F.lit(BINS - 1)).cast("int")
        bins = {r[0]: r[1:] for r in inside.groupBy(at.alias("bin")).agg(F.count("*"), F.min("key"), F.max("key")).collect()}
        if above + sum(n for n, *_ in bins.values()) <= k:
            return F.col("key") >= low
        for b in sorted(bins, reverse=True):
            n, least, most = bins[b]
            if above + n >= k:
                low, high = least, most
                break
            above += n
        if n <= 10_000:
            break
    need = k - above
    if low == high:
        ids = kth_id(keys.where(F.col("key") == low).select("doc_id"), need)
        return (F.col("key") > low) | (F.col("key") == low) & (F.lit(True) if ids is None else F.col("doc_id") <= ids)
    # few rows, of which the last one that stays tells where to cut
    rest = keys.where((F.col("key") >= low) & (F.col("key") <= high)).select("key", "doc_id").orderBy(F.desc("key"), F.asc_nulls_last("doc_id")).limit(need).collect()
    key, doc_id = rest[-1]
    return (F.col("key") > key) | (F.col("key") == key) & (F.lit(True) if doc_id is None else F.col("doc_id") <= doc_id)


def kth_id(ids: DataFrame, k: int) -> int | None:
    """The k-th smallest ``doc_id``, by counts over ever narrower ranges; None if it is among those without an id, which come last."""
    low, high, n = ids.agg(F.min("doc_id"), F.max("doc_id"), F.count("doc_id")).first()
    if k > n:
        return None
    while low < high:
        width = (high - low) // BINS + 1
        inside = ids.where((F.col("doc_id") >= low) & (F.col("doc_id") <= high))
        bins = dict(map(tuple, inside.groupBy(F.floor((F.col("doc_id") - low) / width).alias("bin")).count().collect()))
        for b in sorted(bins):
            if k <= bins[b]:
                low, high = low + b * width, min(low + (b + 1) * width - 1, high)
                break
            k -= bins[b]
    return low


class Classifier:
    """Log ratios, and which ``key`` is among the k largest."""

    def __init__(self, ratios, seed: int):
        self.ratios, self.seed, self.condition = ratios, seed, F.lit(True)

    def keys(self, scores: DataFrame) -> DataFrame:
        uniform = (F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(self.seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
        return scores.withColumn("key", F.col("log_weight") - F.log(-F.log(uniform)))

    def kept(self) -> Column:
        return F.coalesce(self.condition, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000, holdout_rows: int = 20_000, loss: float = 4.0, seed: int = 1) -> tuple[Classifier, DataFrame]:
    """The classifier, and ``doc_id``, ``log_weight`` and ``key`` of every row of ``docs`` (``doc_id``, ``text``).

    The target model is fitted on at most ``fit_rows`` labelled documents, the first by a digest of the id,
    and the cutoff on the next ``holdout_rows``; both samples are small enough to broadcast. The raw model
    counts every text.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    labelled = label_rows(labels).orderBy("digest", "doc_id").limit(fit_rows + holdout_rows)
    labelled = materialize(labelled, "classifier-labels")
    n = min(fit_rows, (labelled.count() + 1) // 2)
    fit_ids = labelled.orderBy("digest", "doc_id").limit(n).select("doc_id", F.col("good").alias("target"))
    held_out = labelled.join(F.broadcast(fit_ids), "doc_id", "left_anti").select("doc_id", "good")
    marked = docs.join(F.broadcast(fit_ids), "doc_id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))
    model = Classifier(log_ratios(count_grams(marked)), seed)
    scores = materialize(score(docs, model.ratios).drop("text"), "classifier-scores")
    cutoff = best_cutoff(scores, held_out, loss)
    keys = model.keys(scores)
    model.condition = top_k(keys, scores.where(F.col("log_weight") >= cutoff).count())
    discard(labelled)
    return model, keys


def classify(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """``doc_id``, ``log_weight``, ``key`` and ``kept`` of every row of ``docs``; parameters as of :func:`fit`."""
    model, keys = fit(docs, labels, **parameters)
    return keys.withColumn("kept", model.kept())


def keep_good(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` that are drawn, with all their columns; a second scan instead of a join on texts."""
    model, keys = fit(docs, labels, **parameters)
    # other columns travel as one, so that they may have any names
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    named = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *([F.struct(*others).alias("others")] if others else []))
    drawn = model.keys(score(named, model.ratios)).where(model.kept())
    return drawn.select(*[F.col(c) if c in ("doc_id", "text") else F.col("others")[c].alias(c) for c in docs.columns])
