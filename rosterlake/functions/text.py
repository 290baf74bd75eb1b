"""Names, person keys, credentials and small string forms, all as built-in expressions."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Leading words of facility names, longest first, and leading titles of persons.
FACILITY_PREFIXES = (
    "rumah sakit umum daerah", "rumah sakit umum pusat", "rumah sakit umum", "rumah sakit khusus",
    "rumah sakit ibu dan anak", "rumah sakit", "rsud", "rsup", "rsia", "rsu", "rs",
)
TITLES = ("prof", "dr", "rd")

_SPECIALIST = (
    r"(?i)(?<![a-z])sp\.?\s*(?:k\.?\s*k|d\.?\s*v(?:\.?\s*e)?)(?:\s*\(k\))?(?![a-z])"
    r"|dermatologi dan venereologi|dermatovenereologi|kulit dan kelamin|dermatology"
)


def collapse(x: Column) -> Column:
    """Runs of white space, of any script, as one space; trimmed."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


@F.pandas_udf(StringType())
def nfkc(x: pd.Series) -> pd.Series:
    """Compatibility form of Unicode text. Names pass here once, at the load, so that the keys below stay expressions."""
    return x.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def slug(x: Column) -> Column:
    """Lower-case words joined by hyphens, the form of names in addresses."""
    return F.trim(F.regexp_replace(F.lower(x), r"[^a-z0-9]+", "-"), F.lit("-"))


def facility_name(x: Column) -> Column:
    """Comparable form of a facility name: no leading kind, no word 'hospital', letters and digits only."""
    low = F.lower(F.trim(x))
    bare = F.regexp_replace(low, rf"^(?:{'|'.join(FACILITY_PREFIXES)})\b\.?\s*", "")
    return collapse(F.regexp_replace(F.regexp_replace(bare, r"\bhospitals?\b", " "), r"(?U)[^\w\s]", " "))


def person_key(x: Column) -> Column:
    """Identity of a person across facilities: the part before a comma, without leading titles.

    Titles need no word end, so a name that begins with their letters loses them too.
    """
    head = F.trim(F.substring_index(F.trim(x), ",", 1))
    bare = F.regexp_replace(head, rf"(?i)^(?:(?:{'|'.join(TITLES)})\.?\s*)+", "")
    return F.lower(collapse(F.regexp_replace(bare, r"(?U)[^\w\s]", " ")))


def name_tokens(x: Column) -> Column:
    return F.filter(F.split(x, " "), lambda t: t != "")


def same_person(a: Column, b: Column) -> Column:
    """struct(is_match, confidence, reason) of two person keys."""
    ta, tb = name_tokens(F.coalesce(a, F.lit(""))), name_tokens(F.coalesce(b, F.lit("")))
    long_shared = F.size(F.filter(F.array_intersect(ta, tb), lambda t: F.length(t) >= 3))

    def verdict(match: bool, confidence: str | None, reason: str) -> Column:
        return F.struct(F.lit(match).alias("is_match"), F.lit(confidence).cast("string").alias("confidence"), F.lit(reason).alias("reason"))

    return (
        F.when((F.size(ta) == 0) | (F.size(tb) == 0), verdict(False, None, "empty"))
        .when(a == b, verdict(True, "high", "equal"))
        .when((F.size(ta) < 2) | (F.size(tb) < 2), verdict(False, None, "one token"))
        .when(long_shared >= 2, verdict(True, "medium", "shared tokens"))
        .when(long_shared == 1, verdict(False, "low", "one shared token"))
        .otherwise(verdict(False, None, "different"))
    )


def is_specialist(x: Column) -> Column:
    """Whether credential text names the specialty; false for null."""
    return F.coalesce(x.rlike(_SPECIALIST), F.lit(False))


def not_empty(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def split_trimmed(x: Column, by: str = ",") -> Column:
    return F.filter(F.transform(F.split(x, by), lambda t: F.trim(t)), lambda t: t != "")


def address(full: Column, street: Column, number: Column, city: Column) -> Column:
    """The full text, else street and number, then the city; null if nothing is there."""
    line = F.concat_ws(" ", not_empty(street), not_empty(number))
    return not_empty(F.concat_ws(", ", F.coalesce(not_empty(full), not_empty(line)), not_empty(city)))


def shown_name(name: Column, alias: Column) -> Column:
    return F.when(alias.isNotNull() & (alias != ""), F.concat(name, F.lit(" (a.k.a. "), alias, F.lit(")"))).otherwise(name)


def composite_key(x: Column) -> Column:
    """struct(name, lat, lon) of 'name|lat|lon'; null where malformed."""
    p = F.split(x, r"\|")
    lat, lon = F.get(p, 1).try_cast("double"), F.get(p, 2).try_cast("double")
    sound = (F.size(p) == 3) & lat.isNotNull() & lon.isNotNull()
    return F.when(sound, F.struct(F.trim(F.get(p, 0)).alias("name"), lat.alias("lat"), lon.alias("lon")))


#: Fixed value: address types too coarse to place a facility.
COARSE = ("city", "suburb", "administrative", "county", "state", "region", "postcode", "town", "village", "municipality")


def geocode_key(addr: Column) -> Column:
    """Cache key of an address: 24 hex digits of its trimmed text's sha256; null for an empty one."""
    return F.substring(F.sha2(not_empty(F.trim(addr)), 256), 1, 24)


def geocode_confidence(addr: Column, kind: Column, lat: Column, lon: Column) -> Column:
    """unknown without address or point, low for coarse types, else medium."""
    ok = not_empty(F.trim(addr)).isNotNull() & lat.try_cast("double").isNotNull() & lon.try_cast("double").isNotNull()
    return F.when(~F.coalesce(ok, F.lit(False)), "unknown").when(F.lower(kind).isin(*COARSE), "low").otherwise("medium")


def rupiah(x: Column) -> Column:
    """'Rp 1.234.567'; null stays null."""
    return F.concat(F.lit("Rp "), F.translate(F.format_number(x, 0), ",", "."))


def embedded_json(html: Column) -> Column:
    """JSON texts inside script push blocks, without their leading number; others are skipped."""
    blocks = F.regexp_extract_all(html, F.lit(r'push\(\[1,"((?:[^"\\]|\\.)*)"\]\)'), 1)
    plain = F.transform(blocks, lambda b: F.regexp_replace(F.replace(F.replace(b, F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\")), r"^[0-9a-f]+:", ""))
    return F.filter(plain, lambda b: F.try_parse_json(b).isNotNull() & b.rlike(r"^\s*[\[{]"))


def specialist_ids(ids: Column, names: Column) -> Column:
    """Ids whose speciality name speaks of the skin; the two arrays go together."""
    return F.transform(F.filter(F.arrays_zip(ids.alias("i"), names.alias("n")), lambda z: F.lower(z["n"]).rlike("dermat|kulit")), lambda z: z["i"])


def _first_array(text: str | None, key: str) -> str | None:
    """JSON of the first array under a key of a document, depth first, in the document's order; null if there is none."""
    try:
        open_ = [json.loads(text)] if text else []
    except (ValueError, RecursionError):
        return None
    while open_:
        x = open_.pop()
        if isinstance(x, dict):
            if isinstance(x.get(key), list):
                return json.dumps(x[key], separators=(",", ":"))
            open_ += reversed(x.values())
        elif isinstance(x, list):
            open_ += reversed(x)
    return None


def array_under(x: Column, key: str) -> Column:
    """The first array that stands under a key anywhere in a JSON text, as JSON in ASCII; an object's own key goes before what
    is inside it. Null for null, for documents that are broken or nested too deeply for a parser (about a thousand levels), and for
    documents without such an array. Arrow batches: a path's depth is not known."""

    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _first_array(t, key))

    return run(x)


def array_under_in_blocks(blocks: Column, key: str) -> Column:
    """array_under of the first of several JSON texts (array<string>) that has one. Objects are read before
    arrays of them, in the blocks' order."""
    sound = F.filter(blocks, lambda b: F.try_parse_json(b).isNotNull())
    return array_under(F.concat(F.lit("["), F.array_join(sound, ","), F.lit("]")), key)
