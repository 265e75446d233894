"""The classifier: an ordered ladder of rules, first match wins, as one CASE expression.

Rules read text in lower case, so their patterns need no case folding.

The texts and flags that several rules need are projected once; the ladder itself is a single
``when().when()...otherwise()`` that gives the ``decision`` struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions.text import clean_text, contains_any, fold_identifiers, pattern
from marketloom.functions.text import matches_lower as matches
from marketloom.operators import rules as R

DECISION = "struct<status:string,confidence:double,reasons:array<string>,normalized_engine:string,normalized_generation:string>"


def extract_year(structured: Column, text: Column) -> Column:
    """The structured year if plausible (1980-2030), else the first year in the text."""
    found = F.regexp_extract(text, pattern(R.YEAR), 1).try_cast("int")
    return F.when(structured.between(1980, 2030), structured.cast("int")).otherwise(found)


def negative_reason(title: Column, full: Column, ruleset: R.RuleSet) -> Column:
    """The first negative rule that holds, or null; texts in lower case."""
    tests = []
    for reason, scope, text in ruleset.negative:
        hit = matches(title, text) if scope != "full" else F.lit(False)
        if scope != "title":
            hit = hit | matches(full, text)
        tests.append(F.when(hit, F.lit(reason)))
    return F.coalesce(*tests)


def first_match(text: Column, rules: list[tuple[str, str]]) -> Column:
    return F.coalesce(*[F.when(matches(text, p), F.lit(reason)) for reason, p in rules])


def brand_model_reason(title: Column, full: Column, brand: Column, model: Column, ruleset: R.RuleSet) -> Column:
    """Why the vehicle is not the target make and model, or null."""
    brand, model = F.nullif(brand, F.lit("")), F.nullif(model, F.lit(""))
    b, m = F.lower(F.trim(brand)), F.upper(F.trim(model))
    a6_title, c5_title = matches(title, R.MODEL_A6), matches(title, R.GENERATION_C5)
    known = F.lit(None).cast("string")
    steps = [F.when(brand.isNotNull() & ~b.isin(ruleset.brands), F.lit("WRONG_BRAND"))]
    steps += [F.when(m.isin(names), F.lit(reason)) for reason, names in R.WRONG_STRUCTURED]
    steps.append(F.when(model.isNotNull() & ~m.isin(R.KNOWN_MODELS), F.concat(F.lit("WRONG_MODEL_"), m)))
    steps.append(F.when(matches(title, R.OTHER_MAKE_TITLE) & ~(a6_title & ~title.contains("на")), F.lit("NOT_AUDI_A6")))
    neither = ~a6_title & ~c5_title
    for reason, p in (("WRONG_MODEL_A4", R.MODEL_A4), ("WRONG_MODEL_A8", R.MODEL_A8), ("WRONG_MODEL", R.MODEL_OTHER)):
        steps.append(F.when(neither & matches(title, p), F.lit(reason)))
    nothing = ~matches(full, R.MODEL_A6) & ~matches(full, R.GENERATION_C5)
    steps.append(F.when(nothing & ~F.coalesce(m.isin(R.TARGET_MODELS), F.lit(False)), F.lit("NOT_AUDI_A6")))
    for reason, p in (("WRONG_MODEL_A4", R.MODEL_A4), ("WRONG_MODEL_A8", R.MODEL_A8)):
        steps.append(F.when(~a6_title & matches(title, p), F.lit(reason)))
    return F.coalesce(*steps, known)


def target_engines(full: Column, engine: Column, ruleset: R.RuleSet) -> Column:
    """The target engines that text or structured engine name, as an array."""
    lower = F.lower(F.coalesce(engine, F.lit("")))
    found = []
    for name, text, part, words in ruleset.target_engines:
        named = F.coalesce(engine, F.lit("")).contains(part)
        if words:
            named = named & contains_any(lower, words)
        found.append(F.when(matches(full, text) | named, F.lit(name)))
    return F.array_compact(F.array(*found))


def is_avant(body: Column, full: Column) -> Column:
    return contains_any(F.lower(F.coalesce(body, F.lit(""))), R.AVANT_WORDS) | matches(full, R.BODY_AVANT)


def is_sedan(body: Column, full: Column) -> Column:
    return contains_any(F.lower(F.coalesce(body, F.lit(""))), R.SEDAN_WORDS) | matches(full, R.BODY_SEDAN)


def _decision(status: str, confidence: float, reasons: Column, engine: Column | None = None, generation: Column | None = None) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(F.lit(status).alias("status"), F.lit(confidence).alias("confidence"), reasons.alias("reasons"), (null if engine is None else engine).alias("normalized_engine"), (null if generation is None else generation).alias("normalized_generation")).cast(DECISION)


def _reject(*reasons: Column) -> Column:
    return _decision("REJECT", 1.0, F.array(*reasons))


def _review(confidence: float, reason: str, engine: Column | None = None, generation: Column | None = None) -> Column:
    return _decision("NEEDS_REVIEW", confidence, F.array(F.lit(reason)), engine, generation)


#: Text columns the classifier reads; missing ones count as null.
INPUTS = {"title": "string", "description": "string", "year": "int", "brand": "string", "model": "string", "engine": "string", "body_type": "string"}


def classify(df: DataFrame, ruleset: R.RuleSet | None = None, compatibility: bool = True) -> DataFrame:
    """Add ``decision`` to listings. ``compatibility`` applies NFKC to texts outside ASCII."""
    ruleset = ruleset or R.RuleSet()
    names = df.columns
    given = {c: (F.col(c) if c in names else F.lit(None)).cast(kind) for c, kind in INPUTS.items()}
    texts = {f"_{c}": clean_text(given[c], compatibility) for c in ("title", "description", "engine")}
    at = df.withColumns(texts)
    at = at.withColumns({f"_i{c}": F.lower(fold_identifiers(F.col(f"_{c}"))) for c in ("title", "description", "engine")})
    at = at.withColumns({"_t": F.col("_ititle"), "_full": F.trim(F.concat_ws(" ", "_ititle", "_idescription", "_iengine"))})
    t, full = F.col("_t"), F.col("_full")
    low_title, low_full = F.lower("_title"), F.trim(F.concat(F.lower("_title"), F.lit(" "), F.lower("_description")))
    # one step after the other: what an earlier rule has rejected is not read again
    at = at.withColumn("_negative", negative_reason(low_title, low_full, ruleset))
    at = at.withColumn("_wrong", F.when(F.col("_negative").isNull(), brand_model_reason(t, full, given["brand"], given["model"], ruleset)))
    still = F.col("_negative").isNull() & F.col("_wrong").isNull()
    later = {
        "_year": extract_year(given["year"], full),
        "_other": first_match(full, ruleset.other_generations),
        "_bad_engine": first_match(full, ruleset.rejected_engines),
        "_engines": target_engines(full, given["engine"], ruleset),
        "_c5": matches(full, R.GENERATION_C5),
        "_avant": is_avant(given["body_type"], full),
        "_18": matches(full, R.GENERIC_18) | F.coalesce(given["engine"].contains("1.8"), F.lit(False)),
    }
    at = at.withColumns({name: F.when(still, value) for name, value in later.items()})
    year, c5 = F.col("_year"), F.col("_c5")
    engine = F.when(F.size("_engines") == 1, F.get("_engines", F.lit(0)))
    early, late = F.concat(F.lit("YEAR_TOO_EARLY_"), year.cast("string")), F.concat(F.lit("YEAR_TOO_LATE_"), year.cast("string"))
    too_early, too_late = F.coalesce(year < ruleset.first_year, F.lit(False)), F.coalesce(year > ruleset.last_year, F.lit(False))
    in_year = lambda y: F.coalesce(year == y, F.lit(False))
    is_engine = lambda *names: F.coalesce(engine.isin(*names), F.lit(False))
    sure = c5 | F.coalesce(year.between(1998, 2003), F.lit(False))
    confirmed = sure | in_year(1997) & is_engine("1.8T", "2.4") | in_year(2004) & (is_engine("1.8T", "1.9_TDI") | is_engine("2.4") & F.col("_avant"))
    generation = F.when(confirmed, F.lit(ruleset.generation))
    ladder = (
        F.when(F.col("_negative").isNotNull(), _reject(F.col("_negative")))
        .when(F.col("_wrong").isNotNull(), _reject(F.col("_wrong")))
        .when(F.col("_other").isNotNull() & too_early, _reject(early, F.col("_other")))
        .when(F.col("_other").isNotNull() & too_late, _reject(F.col("_other"), late))
        .when(F.col("_other").isNotNull(), _reject(F.col("_other")))
        .when(too_early, _reject(early))
        .when(too_late, _reject(late))
        .when(F.col("_bad_engine").isNotNull(), _reject(F.col("_bad_engine")))
        .when(in_year(1997) & is_engine("1.9_TDI") & ~sure, _review(0.7, "YEAR_1997_1.9TDI_CHECK_C4_OR_C5", F.lit("1.9_TDI")))
        .when(in_year(2004) & is_engine("2.4") & ~F.col("_avant") & ~sure, _review(0.7, "YEAR_2004_2.4_CHECK_C5_OR_C6", F.lit("2.4")))
        .when(in_year(2005) & ~sure, _reject(F.lit("YEAR_2005_CHECK_C5_OR_C6")))
        .when((F.size("_engines") == 0) & F.col("_18"), _review(0.6, "AMBIGUOUS_1.8_CHECK_TURBO", None, generation))
        .when(F.size("_engines") > 1, _review(0.5, "AMBIGUOUS_MULTIPLE_ENGINES", None, generation))
        .when(engine.isNull(), _review(0.7, "ENGINE_NOT_IDENTIFIED", None, generation))
        .when(~confirmed, _review(0.7, "AMBIGUOUS_GENERATION_CHECK_C5", engine))
        .otherwise(_decision("PASS", 1.0, F.array(F.concat(F.lit(ruleset.label + "_"), engine)), engine, F.lit(ruleset.generation)))
    )
    return at.withColumn("decision", ladder).select(*names, "decision")


def route(df: DataFrame, ruleset: R.RuleSet | None = None) -> DataFrame:
    """``decision`` by the full ladder for the target model, by the negative rules alone for any other."""
    ruleset = ruleset or R.RuleSet()
    names = df.columns
    model, gen = (F.upper(F.trim(F.coalesce(F.col(c), F.lit("")))) for c in ("model", "generation"))
    target = model.isin("", "A6") & gen.isin("", ruleset.generation)
    title, text = F.lower(F.coalesce("title", F.lit(""))), F.lower(F.coalesce("description", F.lit("")))
    reason = negative_reason(title, F.trim(F.concat(title, F.lit(" "), text)), ruleset)
    passed = _decision("PASS", 1.0, F.array(F.concat_ws("_", F.upper(F.coalesce("brand", F.lit("AUDI"))), model, gen)), F.coalesce("engine", F.lit(None).cast("string")), F.nullif(gen, F.lit("")))
    only_negative = F.when(reason.isNotNull(), _reject(reason)).otherwise(passed)
    return classify(df, ruleset).withColumn("decision", F.when(target, F.col("decision")).otherwise(only_negative)).select(*names, "decision")


def apply_decision(df: DataFrame) -> DataFrame:
    """Overwrite status, engine code and generation from the decision."""
    status = F.when(F.col("decision.status") == "REJECT", "REJECTED").when(F.col("decision.status") == "NEEDS_REVIEW", "NEEDS_REVIEW").otherwise("NEW")
    return df.withColumns({"status": status, "engine_code": F.col("decision.normalized_engine"), "generation": F.coalesce("decision.normalized_generation", "generation")})
