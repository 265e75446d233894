"""Canonical URLs and content fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketloom.functions.fields import city_name, first_filled, mileage_bucket

#: Query keys that only track; so does every key that begins with utm_.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "fbclid", "gclid", "yclid", "_ga", "from", "hash", "session_id", "reason", "tab", "search_id", "ad_index", "igsh", "igshid", "_gl"]

#: Fixed values, first match wins: part of the source name, part of the host, canonical host, prefixes cut from the path (pattern, replacement), paths that lose their query.
SITES = [
    ("auto_ria", "auto.ria", "auto.ria.com", [("^/(uk|ru)/", "/")], None),
    ("olx", "olx", "www.olx.ua", [("^/d/(uk|ru)/", "/d/"), ("^/(uk|ru)/", "/")], None),
    ("rst", "rst", "rst.ua", [("^/ukr/", "/")], None),
    ("telegram", "t.me", "t.me", [], None),
    ("instagram", "instagram", "www.instagram.com", [], "^/(p|reel|tv)/"),
]

PARTS = r"^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _reencode(col: Column) -> Column:
    plain = F.coalesce(F.try_url_decode(col), col)
    coded = F.regexp_replace(F.regexp_replace(F.url_encode(plain), "%7E", "~"), "\\*", "%2A")
    return F.when(col.rlike("^[A-Za-z0-9_.-]*$"), col).otherwise(coded)


def canonical_url(source: Column, url: Column) -> Column:
    """A URL without tracking, port, fragment, language prefix and trailing slash, with its query sorted; empty for nothing."""
    url = F.coalesce(url, F.lit(""))
    host = F.get(F.split(F.lower(F.regexp_extract(url, PARTS, 2)), ":"), F.lit(0))
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(url, PARTS, 3), ";[^/]*$", ""), "/+$", "")
    split = F.transform(F.split(F.regexp_extract(url, PARTS, 4), "&"), lambda p, i: F.struct(_reencode(F.regexp_extract(p, "^([^=]*)=(.*)$", 1)).alias("k"), i.alias("i"), _reencode(F.regexp_extract(p, "^([^=]*)=(.*)$", 2)).alias("v")))
    kept = F.filter(split, lambda x: (x["v"] != "") & ~F.lower(x["k"]).isin(TRACKING) & ~F.lower(x["k"]).startswith("utm_"))
    query = F.array_join(F.transform(F.sort_array(kept), lambda x: F.concat(x["k"], F.lit("="), x["v"])), "&")
    name = F.lower(F.coalesce(source, F.lit("")))

    def rules(x: Column) -> Column:
        host, path, query = x["host"], x["path"], x["query"]
        for part, mark, to, cuts, bare in reversed(SITES):
            here = x["name"].contains(part) | x["host"].contains(mark)
            cut = x["path"]
            for old, new in cuts:
                cut = F.regexp_replace(cut, old, new)
            host, path = F.when(here, F.lit(to)).otherwise(host), F.when(here, cut).otherwise(path)
            query = F.when(here, F.when(x["path"].rlike(bare), F.lit("")).otherwise(x["query"]) if bare else x["query"]).otherwise(query)
        return F.struct(host.alias("host"), path.alias("path"), query.alias("query"))

    def whole(x: Column) -> Column:
        slash = F.when((x["path"] != "") & ~x["path"].startswith("/"), F.lit("/")).otherwise(F.lit(""))
        return F.concat(F.lit("https://"), x["host"], slash, x["path"], F.when(x["query"] != "", F.concat(F.lit("?"), x["query"])).otherwise(F.lit("")))

    parts = F.struct(name.alias("name"), host.alias("host"), path.alias("path"), query.alias("query"))
    return F.when(F.trim(url) == "", F.lit("")).otherwise(let(let(parts, rules), whole))


def fingerprint_text(strict: bool = True, prefix: str = "AUDI_A6_C5", include_model: bool = False) -> Column:
    """What a fingerprint hashes: the attributes that stay the same when an ad is posted again."""
    c = F.col

    def lowered(name: str, missing: str) -> Column:
        return F.trim(F.lower(F.coalesce(first_filled(c(name)), F.lit(missing))))

    parts = [
        F.lit(prefix),
        F.when(F.coalesce(c("year"), F.lit(0)) != 0, c("year").cast("string")).otherwise(F.lit("UNKNOWN_YEAR")),
        lowered("body_type", "unknown"),
        F.trim(F.upper(F.coalesce(first_filled(c("engine_code"), c("engine")), F.lit("UNKNOWN_ENGINE")))),
        lowered("fuel_type", "other"),
        lowered("transmission", "unknown"),
        lowered("drive_type", "unknown"),
        mileage_bucket(c("mileage")),
        city_name(F.coalesce(first_filled(c("location_city"), c("location")), F.lit("UNKNOWN_LOC"))),
    ]
    if include_model:
        parts[1:1] = [lowered("model", "unknown"), lowered("generation", "unknown")]
    if strict:  # no part at all without a seller; concat_ws skips nulls
        parts.append(F.coalesce(first_filled(c("seller_phone")), F.trim(F.lower(first_filled(c("seller"))))))
    return F.concat_ws("|", *parts)


def content_fingerprint(strict: bool = True, prefix: str = "AUDI_A6_C5", include_model: bool = False) -> Column:
    return F.sha2(fingerprint_text(strict, prefix, include_model), 256)
