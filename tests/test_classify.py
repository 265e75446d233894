import pytest

from marketloom.operators.classify import classify, route

CASES = [
    # title, description, year, status, reason, engine
    ("Audi A6 C5 1.8T", "стан хороший", 1999, "PASS", "AUDI_A6_C5_1.8T", "1.8T"),
    ("Ауді А6 С5 2,4 газ", "", 2001, "PASS", "AUDI_A6_C5_2.4", "2.4"),
    ("Продам фари Audi A6 C5", "", None, "REJECT", "NEGATIVE_PARTS_TITLE", None),
    ("Куплю Audi A6", "", None, "REJECT", "NEGATIVE_BUYER_INQUIRY", None),
    ("Passat B5", "обмін на Audi A6", 2000, "REJECT", "NEGATIVE_TRADE_IN_TARGET", None),
    ("Audi A6 C5 розбірка", "", None, "REJECT", "NEGATIVE_DISMANTLING", None),
    ("Audi A6 C5 2.4", "пригон авто з Європи", None, "REJECT", "NEGATIVE_COMMERCIAL_SERVICE", None),
    ("Audi A4 B5 1.8T", "", 1999, "REJECT", "WRONG_MODEL_A4", None),
    ("BMW 520", "", 1999, "REJECT", "NOT_AUDI_A6", None),
    ("Audi A6 C4 2.4", "", 1996, "REJECT", "YEAR_TOO_EARLY_1996,GENERATION_C4", None),
    ("Audi A6 C6 2.4", "", 2006, "REJECT", "GENERATION_C6,YEAR_TOO_LATE_2006", None),
    ("Audi A6 2.4", "", 1996, "REJECT", "YEAR_TOO_EARLY_1996", None),
    ("Audi A6 2.4", "", 2006, "REJECT", "YEAR_TOO_LATE_2006", None),
    ("Audi A6 C5 2.5 TDI", "", 2001, "REJECT", "REJECTED_ENGINE_2.5_TDI", None),
    ("Audi A6 C5 1.8 без турбо", "", 2001, "REJECT", "REJECTED_ENGINE_1.8_NON_TURBO", None),
    ("Audi A6 1.9 TDI", "", 1997, "NEEDS_REVIEW", "YEAR_1997_1.9TDI_CHECK_C4_OR_C5", "1.9_TDI"),
    ("Audi A6 1.8T", "", 1997, "PASS", "AUDI_A6_C5_1.8T", "1.8T"),
    ("Audi A6 2.4", "", 2004, "NEEDS_REVIEW", "YEAR_2004_2.4_CHECK_C5_OR_C6", "2.4"),
    ("Audi A6 2.4 avant", "", 2004, "PASS", "AUDI_A6_C5_2.4", "2.4"),
    ("Audi A6 2.4", "", 2005, "REJECT", "YEAR_2005_CHECK_C5_OR_C6", None),
    ("Audi A6 C5 2.4", "", 2005, "PASS", "AUDI_A6_C5_2.4", "2.4"),
    ("Audi A6 C5 1.8", "", 2000, "NEEDS_REVIEW", "AMBIGUOUS_1.8_CHECK_TURBO", None),
    ("Audi A6 C5 1.8T або 2.4", "", 2000, "NEEDS_REVIEW", "AMBIGUOUS_MULTIPLE_ENGINES", None),
    ("Audi A6 C5", "гарна", 2000, "NEEDS_REVIEW", "ENGINE_NOT_IDENTIFIED", None),
    ("Audi A6 2.4", "", None, "NEEDS_REVIEW", "AMBIGUOUS_GENERATION_CHECK_C5", "2.4"),
    ("Ауді Горбатая 2.4", "", None, "PASS", "AUDI_A6_C5_2.4", "2.4"),
    (None, None, None, "REJECT", "NOT_AUDI_A6", None),
]


def test_ladder(spark):
    rows = [(i, *c[:3]) for i, c in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, title string, description string, year int")
    got = {r.i: r.decision for r in classify(df).collect()}
    wrong = [(c, got[i]) for i, c in enumerate(CASES) if (got[i].status, ",".join(got[i].reasons), got[i].normalized_engine) != c[3:]]
    assert not wrong


@pytest.mark.parametrize("brand,model,reason", [("BMW", None, "WRONG_BRAND"), ("Audi", "A8", "WRONG_MODEL_A8"), ("Audi", "Q7", "WRONG_MODEL_Q7")])
def test_structured(spark, brand, model, reason):
    df = spark.createDataFrame([("Audi A6 C5 2.4", brand, model)], "title string, brand string, model string")
    assert classify(df).first().decision.reasons == [reason]


def test_route_other_models(spark):
    df = spark.createDataFrame([("Audi A4 B6 2.0", "", "Audi", "A4", "B6", None), ("Куплю Audi A4", "", "Audi", "A4", "B6", None)], "title string, description string, brand string, model string, generation string, engine string")
    assert [r.decision.status for r in route(df).collect()] == ["PASS", "REJECT"]
