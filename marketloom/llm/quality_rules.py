"""Quality rules whose cutoffs come with a guarantee on false rejections.

Signals are columns computed by built-in functions from every whole text. Each signal may reject
a document when it exceeds a cutoff. Cutoffs are chosen for each stratum from labelled documents,
split in two halves by a digest of their id:

* the fitting half proposes a sequence of rules, from lenient to strict: for each of ``SHARES`` every signal takes the
  strictest cutoff that rejects at most that share of the half's good documents, and none where it catches too few bad
  ones, less ``penalty`` for each good one rejected. A rule is the union of its cutoffs;
* the holdout half disposes: a rule counts only if the exact binomial test of "the rule rejects ``alpha`` or more of the good
  documents" rejects at level ``delta / strata``. Rules are tested from the most lenient on and the first that fails ends
  the sequence (fixed-sequence testing), so the correction counts strata only. Of the rules that hold, the one with the
  greatest gain on the fitting half is taken.

With probability ``1 - delta`` no stratum loses more than ``alpha`` of its good documents to the
signals. A stratum with too few labelled documents for any guarantee (72 good ones in the holdout, with four strata)
gets no cutoff.

One signal counts words of a list mined from the fitting half: words that toxic documents use and good
ones do not. The list only proposes; its cutoff is certified like the others.

Cases: null text is empty: no words, ``base_failed``. Documents without a stratum share the stratum "".
Labels repeated for a document count once, as bad if any of them says so; labels with nulls are left out.
Empty tables give empty results; without labels nothing but the base rule rejects. Repeated documents stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.common import SPACE, materialize, small_enough

#: signal -> cutoffs that may be chosen, lenient to strict (the document is rejected above the cutoff).
GRID = {
    "symbol_ratio": [0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.04, 0.03, 0.02],
    "dup_line_ratio": [0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1],
    "repeat_ratio": [0.19, 0.17, 0.15, 0.13, 0.11, 0.09, 0.07, 0.05],
    "upper_ratio": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1],
    "listed_words": [12.0, 8.0, 5.0, 3.0, 2.0, 1.0, 0.0],
}
#: Shares of the fitting half's good documents that a signal may reject in each of the rules that are tested in turn.
SHARES = [0.0, 0.001, 0.0025, 0.005, 0.01, 0.02, 0.04]


def base_signals(df: DataFrame, id_col: str, text_col: str, stratum: Column, words_listed: list[str]) -> DataFrame:
    """Counts of every text, by built-in functions in one scan."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    at = df.select(F.col(id_col).alias("doc_id"), F.coalesce(stratum.cast("string"), F.lit("")).alias("stratum"), text.alias("text"))
    at = at.withColumn("words", F.filter(F.split("text", SPACE), lambda w: w != ""))
    at = at.withColumn("lines", F.filter(F.split("text", "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]")))
    at = at.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    listed = F.size(F.filter("words", lambda w: w.isin(words_listed))) if words_listed else F.lit(0)
    at = at.select(
        "doc_id", "stratum",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("text", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        listed.cast("long").alias("n_listed"),
        "hashes",
        F.transform("hashes", lambda h, i: F.xxhash64(h, F.get("hashes", i + 1), F.get("hashes", i + 2), F.get("hashes", i + 3), F.get("hashes", i + 4))).alias("tails"),
    )
    # five-word windows; only a text with a window found twice is looked at more closely
    at = at.withColumn("windows", F.when(F.col("n_words") >= 5, F.slice("tails", F.lit(1), F.greatest(F.col("n_words") - 4, F.lit(1)).cast("int"))))
    at = at.withColumn("ranked", F.when(F.size("windows") > F.size(F.array_distinct("windows")), F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.transform("ranked", lambda x, i: F.when((F.get("ranked", i - 1)["h"] == x["h"]) | (F.get("ranked", i + 1)["h"] == x["h"]), x["i"]))
    at = at.withColumn("starts", F.sort_array(F.filter(twice, lambda p: p.isNotNull())))
    covered = F.aggregate(
        "starts",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, p: F.struct((acc["n"] + p + 5 - F.greatest(p, acc["end"])).alias("n"), (p + 5).alias("end")),
    )["n"]
    at = at.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    return at.drop("hashes", "tails", "windows", "ranked", "starts")


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


def signals() -> dict[str, Column]:
    """The rejecting signals as functions of the counts."""
    return {
        "symbol_ratio": _ratio("n_symbols", "word_chars"),
        "dup_line_ratio": _ratio("n_dup_lines", "n_lines"),
        "repeat_ratio": _ratio("n_repeat_words", "n_words"),
        "upper_ratio": _ratio("n_upper", "word_chars"),
        "listed_words": F.col("n_listed").cast("double"),
    }


def label_rows(labels: DataFrame, most: int = 1_000_000) -> DataFrame:
    """One row for each labelled document: ``doc_id``, ``good``, ``toxic``, ``fit`` (the half) and ``digest``; of more than ``most`` the first by digest."""
    rows = labels.where("doc_id is not null and quality is not null and toxic is not null")
    rows = rows.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    digest = F.md5(F.col("doc_id").cast("string"))
    rows = rows.orderBy(digest, "doc_id").limit(most)
    return rows.select("doc_id", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"), (F.col("toxic") == 1).alias("toxic"), (digest < "8").alias("fit"), digest.alias("digest"))


def mine_words(df: DataFrame, labelled: DataFrame, id_col: str, text_col: str, sample: int = 20_000, least: int = 6, ratio: float = 25.0, most: int = 4_000) -> DataFrame:
    """Words of toxic documents that good ones hardly use: ``word``, most telling first, at most ``most``.

    Fitted on at most ``sample`` labelled documents of the fitting half, the first by digest.
    """
    chosen = labelled.where("fit and (good or toxic)").orderBy("digest", "doc_id").limit(sample).select("doc_id", "toxic")
    texts = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(chosen, "doc_id")
    words = texts.select("toxic", F.explode(F.array_distinct(F.split("text", SPACE))).alias("word")).where("word <> ''")
    counts = words.groupBy("word").agg(F.count_if("toxic").alias("bad"), F.count_if(~F.col("toxic")).alias("fine"))
    n = chosen.agg(F.count_if("toxic").alias("n_bad"), F.count_if(~F.col("toxic")).alias("n_fine"))
    told = counts.crossJoin(F.broadcast(n)).where(F.col("bad") >= least)
    told = told.where(F.col("bad") * F.col("n_fine") >= ratio * F.col("fine") * F.col("n_bad"))
    return told.orderBy(F.desc("bad"), "word").limit(most).select("word")


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X of n draws at rate p, exactly; 1 where k is at or above the mean, which is never significant."""
    import math

    odds = math.log(p) - math.log1p(-p)
    start = F.struct((n * math.log1p(-p)).alias("log"), F.exp(n * math.log1p(-p)).alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        log = acc["log"] + F.log(n - i + 1) - F.log(i) + odds
        return F.struct(log.alias("log"), (acc["sum"] + F.exp(log)).alias("sum"))

    counted = F.when(k > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1)).cast("long")), start, step)["sum"]).otherwise(F.exp(n * math.log1p(-p)))
    return F.when(k < n * p, F.least(counted, F.lit(1.0))).otherwise(F.lit(1.0))


def certify(counts: DataFrame, labelled: DataFrame, alpha: float, delta: float, penalty: float) -> DataFrame:
    """The rule of each stratum that has a guarantee: ``stratum``, a ``cut_<signal>`` each (or null), ``p_value``, ``holdout`` and ``false_rejections``."""
    given = [F.col("good"), F.col("fit"), *[value.alias(name) for name, value in signals().items()]]
    rows = materialize(counts.join(labelled, "doc_id").where(F.col("n_words") >= 10).select("stratum", *given), "labelled-counts")
    # how many of a signal's cutoffs a document exceeds; as they fall, those are the last ones of the grid
    level = {name: sum((F.col(name) > c).cast("int") for c in cuts) for name, cuts in GRID.items()}
    each = rows.where("fit").select("stratum", "good", F.explode(F.array(*[F.struct(F.lit(name).alias("signal"), x.alias("level")) for name, x in level.items()])).alias("s"))
    bins = each.groupBy("stratum", F.col("s.signal").alias("signal"), F.col("s.level").alias("level")).agg(F.count_if("good").alias("good_fit"), F.count_if(~F.col("good")).alias("bad_fit"))
    grid = F.create_map(*[x for name, cuts in GRID.items() for x in (F.lit(name), F.lit(cuts).cast("array<double>"))])
    every = bins.groupBy("stratum", "signal").agg(
        F.sum("good_fit").alias("n_fit"),
        F.collect_list(F.struct("level", "good_fit", "bad_fit")).alias("bins"),  # as many as the grid has cutoffs
    )
    cuts = every.select("stratum", "signal", "n_fit", "bins", F.posexplode(F.element_at(grid, F.col("signal"))).alias("rank", "cutoff"))

    def above(what: str) -> Column:  # a document exceeds cutoff number rank when it exceeds len - rank or more of them
        least = F.size(F.element_at(grid, F.col("signal"))) - F.col("rank")
        return F.aggregate("bins", F.lit(0).cast("long"), lambda acc, b: acc + F.when(b["level"] >= least, b[what]).otherwise(F.lit(0)))

    cuts = cuts.select("stratum", "signal", "n_fit", "rank", "cutoff", above("good_fit").alias("k_fit"), above("bad_fit").alias("caught")).where(F.col("caught") > penalty * F.col("k_fit"))
    allowed = cuts.select("*", F.posexplode(F.lit(SHARES).cast("array<double>")).alias("rule", "share")).where(F.col("k_fit") <= F.col("share") * F.col("n_fit"))
    strictest = allowed.groupBy("stratum", "rule", "signal").agg(F.max_by("cutoff", "rank").alias("cutoff"))
    rules = strictest.groupBy("stratum", "rule").pivot("signal", list(GRID)).agg(F.first("cutoff"))
    rules = materialize(rules.select("stratum", "rule", *[F.col(name).alias(f"cut_{name}") for name in GRID]), "rules")

    rejected = F.lit(False)
    for name in GRID:
        rejected = rejected | F.coalesce(F.col(name) > F.col(f"cut_{name}"), F.lit(False))
    judged = rows.join(rules, "stratum").withColumn("rejected", rejected)
    good, fit, out = F.col("good"), F.col("fit"), F.col("rejected")
    tests = judged.groupBy("stratum", "rule").agg(
        F.count_if(good & ~fit).alias("n_hold"), F.count_if(good & ~fit & out).alias("k_hold"), (F.count_if(~good & fit & out) - penalty * F.count_if(good & fit & out)).alias("gain"),
    )
    strata = rows.agg(F.greatest(F.count_distinct("stratum"), F.lit(1)).alias("strata"))
    tests = tests.crossJoin(F.broadcast(strata)).withColumn("p_value", binomial_tail(F.col("k_hold"), F.col("n_hold"), alpha))
    order = Window.partitionBy("stratum").orderBy("rule")
    tests = tests.withColumn("held", F.min((F.col("p_value") <= F.lit(delta) / F.col("strata")).cast("int")).over(order) == 1)
    best = tests.where("held").where("gain > 0").groupBy("stratum").agg(F.max_by(F.struct("rule", "p_value", "n_hold", "k_hold"), F.struct("gain", -F.col("rule"))).alias("b"))
    best = best.select("stratum", F.col("b.rule").alias("rule"), F.col("b.p_value").alias("p_value"), F.col("b.n_hold").alias("holdout"), F.col("b.k_hold").alias("false_rejections"))
    return rules.join(best, ["stratum", "rule"]).drop("rule")


def quality_rules(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang", alpha: float = 0.05, delta: float = 0.1, penalty: float = 10.0) -> DataFrame:
    """Counts and verdict of every document: ``kept`` unless the base rule or a certified cutoff rejects it."""
    labelled = label_rows(labels)
    words = [r[0] for r in mine_words(df, labelled, id_col, text_col).collect()]  # at most ``most`` words
    counts = materialize(base_signals(df, id_col, text_col, F.col(stratum_col) if stratum_col else F.lit(""), words), "quality-counts")
    cutoffs = materialize(certify(counts, labelled, alpha, delta, penalty), "quality-cutoffs")
    wide = cutoffs.select("stratum", *[f"cut_{name}" for name in GRID])  # fixed-size rows, one for each stratum
    wide = F.broadcast(wide) if small_enough(cutoffs, 50_000) else wide
    base_failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    rejected = None
    for name, value in signals().items():
        one = F.coalesce(value > F.col(f"cut_{name}"), F.lit(False))
        rejected = one if rejected is None else rejected | one
    out = counts.join(wide, "stratum", "left").withColumn("base_failed", base_failed)
    return out.select(
        F.col("doc_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~rejected).alias("kept"), "n_upper", "n_lines", "n_listed", "stratum",
    )
