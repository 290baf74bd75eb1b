"""Days, clock times and the time-range grammar, all as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of days, Monday is 0.
DAYS = {
    "senin": 0, "selasa": 1, "rabu": 2, "kamis": 3, "jumat": 4, "jum'at": 4, "sabtu": 5, "minggu": 6,
    "monday": 0, "tuesday": 1, "wednesday": 2, "thursday": 3, "friday": 4, "saturday": 5, "sunday": 6,
    "sen": 0, "sel": 1, "rab": 2, "kam": 3, "jum": 4, "sab": 5, "min": 6,
}
#: Last number a source uses for a day; 1 is Monday.
NUMBERED = {"siloam": 7, "emc": 6, "brawijaya": 6}

_RANGE = r"(\d{1,2})[:.](\d{2})(?:[:.]\d{2})?\s*-\s*(\d{1,2})[:.](\d{2})(?:[:.]\d{2})?"
_OPEN = r"(?i)(\d{1,2})[:.](\d{2})(?:[:.]\d{2})?\s*-\s*selesai"


def day_name(x: Column) -> Column:
    """0 to 6 from a day's name or abbreviation in either language; null if unknown."""
    pairs = [F.lit(v) for kv in DAYS.items() for v in kv]
    return F.try_element_at(F.create_map(*pairs), F.lower(F.trim(x)))


def day_number(source: Column, n: Column) -> Column:
    """0 to 6 from a source's own numbering; null for unknown sources and numbers out of range."""
    out = F.lit(None).cast("int")
    for name, most in NUMBERED.items():
        out = F.when((source == name) & n.between(1, most), n - 1).otherwise(out)
    return out


def day_of(source: Column, x: Column) -> Column:
    return F.coalesce(day_name(x), day_number(source, F.trim(x).try_cast("int")))


def minutes(x: Column) -> Column:
    """'HH:MM' as minutes since midnight; null where it is no two numbers. Hours are not bounded."""
    p = F.split(x, ":")
    return F.when(F.size(p) == 2, F.get(p, 0).try_cast("int") * 60 + F.get(p, 1).try_cast("int"))


def clock(total: Column) -> Column:
    """Minutes since midnight as 'HH:MM'."""
    return F.concat(F.lpad(F.floor(total / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((total % 60).cast("string"), 2, "0"))


def prefix_clock(x: Column) -> Column:
    """'H:MM[:SS]' at the start of a text as 'HH:MM', else null."""
    m = F.regexp_extract(x, r"^(\d{1,2}):(\d{2})", 1)
    return F.when(m != "", F.concat(F.lpad(m, 2, "0"), F.lit(":"), F.regexp_extract(x, r"^(\d{1,2}):(\d{2})", 2)))


def split_clock(hour: Column, minute: Column) -> Column:
    return F.when(hour.isNotNull(), F.format_string("%02d:%02d", hour.cast("int"), F.coalesce(minute, F.lit(0)).cast("int")))


def _token(text: Column, which: int) -> Column:
    return F.concat(F.lpad(F.regexp_extract(text, _RANGE, which), 2, "0"), F.lit(":"), F.regexp_extract(text, _RANGE, which + 1))


def _session(start: Column, end: Column, confidence: str) -> Column:
    return F.struct(start.cast("string").alias("start_time"), end.cast("string").alias("end_time"), F.lit(confidence).alias("confidence"))


def time_ranges(x: Column) -> Column:
    """array<struct<start_time, end_time, confidence>> of free text, by ordered rules.

    Blank: low. By appointment: medium without times. Segments joined by 'dan' or 'and' each hold
    exactly one range: high each, else low once. A range open to 'selesai': high without end. One
    range: high. None or several run together: low. Nothing is guessed.
    """
    t = F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "))
    none = F.lit(None)
    low = F.array(_session(none, none, "low"))
    parts = F.filter(F.transform(F.split(t, r"(?i)\b(?:dan|and)\b"), lambda p: F.trim(p)), lambda p: p != "")
    ranges = F.regexp_extract_all(t, F.lit(_RANGE), 0)
    each_one = F.forall(parts, lambda p: F.size(F.regexp_extract_all(p, F.lit(_RANGE), 0)) == 1)
    start = F.concat(F.lpad(F.regexp_extract(t, _OPEN, 1), 2, "0"), F.lit(":"), F.regexp_extract(t, _OPEN, 2))
    return (
        F.when(t == "", low)
        .when(t.rlike(r"(?i)dengan\s+perjanjian"), F.array(_session(none, none, "medium")))
        .when(F.size(parts) > 1, F.when(each_one, F.transform(parts, lambda p: _session(_token(p, 1), _token(p, 3), "high"))).otherwise(low))
        .when(t.rlike(_OPEN), F.array(_session(start, none, "high")))
        .when(F.size(ranges) == 1, F.array(_session(_token(t, 1), _token(t, 3), "high")))
        .otherwise(low)
    )


def capped(confidence: Column, most: str = "medium") -> Column:
    """Confidence of sources whose times are derived is never above most."""
    return F.when(confidence == "high", most).otherwise(confidence)


def local_day(ts: Column) -> Column:
    """A UTC time's date at UTC+7 as DD-MM-YYYY."""
    return F.date_format(ts + F.expr("INTERVAL 7 HOURS"), "dd-MM-yyyy")


def week_time(monday: Column, day: Column, minute: Column) -> Column:
    """The local time of (day, minute) in the week of a Monday."""
    return F.to_timestamp_ntz(F.date_add(monday, day.cast("int")).cast("string")) + F.make_dt_interval(F.lit(0), F.lit(0), minute.cast("int"))


def next_monday(day: Column) -> Column:
    """The first Monday after a date."""
    return F.next_day(day, "Mon")


def strict_minutes(x: Column) -> Column:
    """'HH:MM' within a day as minutes since midnight; anything else fails the job."""
    m = minutes(x)
    sound = x.rlike(r"^([01]?\d|2[0-3]):[0-5]\d$")
    return F.when(x.isNull() | ~sound, F.raise_error(F.concat(F.lit("no time of day: "), F.coalesce(x, F.lit("null")))).cast("int")).otherwise(m)
