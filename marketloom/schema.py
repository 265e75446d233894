"""Schemas, enumerations and constant tables of the listings data model."""

from __future__ import annotations

from pyspark.sql import types as T

#: Accepted values of enumerated columns.
SOURCES = ["auto_ria", "olx", "rst", "telegram", "instagram"]
FUELS = ["petrol", "gas_petrol", "diesel", "other"]
TRANSMISSIONS = ["manual", "automatic", "tiptronic", "unknown"]
DRIVES = ["front", "quattro", "unknown"]
BODIES = ["sedan", "avant", "allroad", "unknown"]
STATUSES = ["NEW", "SENT", "DUPLICATE", "NEEDS_REVIEW", "REJECTED", "INACTIVE"]

#: US dollars for one unit of a currency; unknown currencies count as dollars.
FX_RATES = {"USD": "1.0", "EUR": "1.08", "UAH": "0.0241"}
#: Rates used only to show a price in a second currency.
DISPLAY_UAH_PER_USD, DISPLAY_USD_PER_EUR = "41.5", "1.08"

MONEY = T.DecimalType(12, 2)


def _struct(required: dict, optional: dict) -> T.StructType:
    return T.StructType([*(T.StructField(k, v, False) for k, v in required.items()), *(T.StructField(k, v, True) for k, v in optional.items())])


_S, _STRINGS = T.StringType(), T.ArrayType(T.StringType())

#: What an extractor returns.
RAW_SCHEMA = _struct(
    {"source": _S, "source_id": _S, "url": _S, "title": _S},
    {c: _S for c in "description raw_text raw_price currency raw_year raw_mileage raw_engine engine raw_fuel fuel_type raw_transmission transmission raw_location location seller seller_name seller_phone".split()}
    | {"price": MONEY, "year": T.IntegerType(), "mileage": T.IntegerType(), "images": _STRINGS, "image_urls": _STRINGS, "published_at": T.TimestampType()}
    | {c: _S for c in "brand model generation body_type drive_type".split()}
    | {"extra_attributes": T.MapType(_S, _S)},
)

#: Columns added when a raw row becomes a listing.
LISTING_COLUMNS = {
    "canonical_url": _S, "price_usd": MONEY, "engine_code": _S, "location_city": _S, "location_region": _S, "content_fingerprint": _S, "fuzzy_fingerprint": _S,
    "status": _S, "duplicate_of_id": T.LongType(), "dedup_level": T.IntegerType(), "is_sent": T.BooleanType(), "sent_at": T.TimestampType(),
    "first_seen_at": T.TimestampType(), "last_checked_at": T.TimestampType(),
}
LISTING_SCHEMA = T.StructType([T.StructField("id", T.LongType()), *RAW_SCHEMA.fields, *(T.StructField(k, v) for k, v in LISTING_COLUMNS.items())])

DECISION_SCHEMA = "status string, confidence double, reasons array<string>, normalized_engine string, normalized_generation string"

VERSION_SCHEMA = "listing_id bigint, price decimal(12,2), price_usd decimal(12,2), price_diff_usd decimal(12,2), currency string, mileage int, title string, description string, change_type string, change_summary map<string,double>, detected_at timestamp"

FILTER_SCHEMA = "chat_id string, selected_models array<string>, engines array<string>, min_price int, max_price int, min_year int, max_year int, max_mileage int, transmission string, drive_type string, body_type string, exclude_damaged boolean"
#: A user's filter before any command.
FILTER_DEFAULTS = {
    "selected_models": ["A6 C5"], "engines": ["1.8T", "2.4", "1.9 TDI"], "min_price": None, "max_price": None, "min_year": 1997, "max_year": 2005, "max_mileage": None,
    "transmission": "any", "drive_type": "any", "body_type": "any", "exclude_damaged": True,
}

#: Upper lengths of text columns.
MAX_LENGTHS = {
    "source_id": 128, "title": 500, "brand": 50, "model": 50, "generation": 20, "body_type": 32, "currency": 8, "engine": 100, "engine_code": 32, "fuel_type": 32,
    "transmission": 32, "drive_type": 32, "location": 128, "location_city": 64, "location_region": 64, "seller": 128, "seller_phone": 32, "content_fingerprint": 64,
    "fuzzy_fingerprint": 64, "status": 32,
}
