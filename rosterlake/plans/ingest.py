"""From raw records to the practitioner and session tables, with the load's counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from rosterlake.functions import timeparse
from rosterlake.functions.text import is_specialist, nfkc, person_key
from rosterlake.operators.matching import fuzzy_best, weekly_pattern
from rosterlake.sources.adapters import SOURCES
from rosterlake.sources.staging import stored

NOT_SPECIALIST, UNMATCHED, LOADED = "not specialist", "unmatched", "loaded"


def sessions(raw: DataFrame) -> DataFrame:
    """raw with day, start_time, end_time, confidence: structured times if given, else the grammar."""
    day = timeparse.day_of(F.col("source"), F.col("day_text"))
    free = raw.filter("start_text IS NULL AND time_text IS NOT NULL").withColumn("t", F.explode(timeparse.time_ranges(F.col("time_text"))))
    free = free.select(*raw.columns, day.alias("day"), "t.start_time", "t.end_time", F.when(day.isNull(), "low").otherwise(F.col("t.confidence")).alias("confidence"))
    start, end = timeparse.prefix_clock(F.col("start_text")), timeparse.prefix_clock(F.col("end_text"))
    sure = F.when(day.isNull() | start.isNull() | end.isNull(), "low").otherwise("high")
    fixed = raw.filter("start_text IS NOT NULL OR (time_text IS NULL AND day_text IS NOT NULL)").select(*raw.columns, day.alias("day"), F.when(day.isNotNull(), start).alias("start_time"), F.when(day.isNotNull(), end).alias("end_time"), sure.alias("confidence"))
    all_ = free.unionByName(fixed)
    medium = [n for n, s in SOURCES.items() if s.most == "medium"]
    return all_.withColumn("confidence", F.when(F.col("source").isin(*medium), timeparse.capped(F.col("confidence"))).otherwise(F.col("confidence")))


def resolve(raw: DataFrame, facilities: DataFrame) -> DataFrame:
    """Specialists' records with the facility their branch resolves to; unresolved ones keep a null."""
    plain = raw.withColumns({"branch": nfkc("branch"), "raw_name": nfkc("raw_name")})
    ok = plain.filter(is_specialist(F.concat_ws(", ", "raw_name", "credentials")))
    names = ok.filter("branch IS NOT NULL").select(F.col("branch").alias("key"), F.col("branch").alias("raw"), F.lit(None).cast("string").alias("grp")).distinct()
    found = fuzzy_best(names, facilities.withColumn("name", nfkc("name"))).select(F.col("key").alias("branch"), F.col("id").alias("facility"))
    return ok.join(found, "branch", "left")


def first_seen(resolved: DataFrame) -> DataFrame:
    """resolved without the rows of a record's later branch names for a facility that an earlier one has
    taken. What is earlier: position, the rows' order in the load, where given, else the branch's name."""
    at = F.col("position") if "position" in resolved.columns else F.col("branch")
    known = resolved.filter("facility IS NOT NULL")
    first = known.groupBy("source", "record", "facility").agg(F.min_by("branch", F.struct(at, "branch")).alias("branch"))
    return known.join(first, ["source", "record", "facility", "branch"])


def practitioners(resolved: DataFrame) -> DataFrame:
    """One row per record and facility, by the first branch name of the facility."""
    kept = first_seen(resolved).groupBy("source", "record", "facility").agg(F.min("raw_name").alias("raw_name"))
    return kept.select("source", "record", "facility", "raw_name", person_key(F.col("raw_name")).alias("person"), F.initcap(person_key(F.col("raw_name"))).alias("clean_name"), F.concat_ws("|", "source", "record", F.col("facility").cast("string")).alias("practitioner"))


def load(raw: DataFrame, facilities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(practitioners, sessions): branch by branch; dated sources collapse to weekly sessions."""
    return _tables(resolve(raw, facilities))


def _tables(resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    people = practitioners(resolved)
    times = sessions(first_seen(resolved)).withColumns({"record": F.concat_ws("|", "source", "record", F.col("facility").cast("string"))})
    times = times.withColumn("position", F.xxhash64(*times.columns))
    dated = [n for n, s in SOURCES.items() if s.most == "medium"]
    weekly = weekly_pattern(times.filter(F.col("source").isin(*dated)))
    return people, times.filter(~F.col("source").isin(*dated)).unionByName(weekly).select("source", F.col("record").alias("practitioner"), "facility", "day", "start_time", "end_time", "confidence")


def outcomes(raw: DataFrame, resolved: DataFrame) -> DataFrame:
    """What became of every record: source, record, outcome (not specialist, unmatched or loaded), unmatched_names.

    A record with several branches is loaded if any of them resolves; the names of the others are told all the same. A
    record that names no branch is told by its person's name. Null records of a source count as one.
    """
    per = resolved.groupBy("source", "record").agg(
        F.bool_or(F.col("facility").isNotNull()).alias("hit"),
        F.array_sort(F.collect_set(F.when(F.col("facility").isNull(), F.coalesce(F.col("branch"), F.concat(F.coalesce("raw_name", F.lit("?")), F.lit(" (no branch named)")))))).alias("unmatched_names"),
    )
    per = per.withColumnsRenamed({"source": "__source", "record": "__record"})
    every = raw.select("source", "record").distinct()
    joined = every.join(per, F.col("source").eqNullSafe(F.col("__source")) & F.col("record").eqNullSafe(F.col("__record")), "left")
    outcome = F.when(F.col("hit").isNull(), NOT_SPECIALIST).when(F.col("hit"), LOADED).otherwise(UNMATCHED)
    return joined.select("source", "record", outcome.alias("outcome"), F.coalesce("unmatched_names", F.array().cast("array<string>")).alias("unmatched_names"))


def _of(outcome: str) -> Column:
    return F.count_if(F.col("outcome") == outcome)


def summary(raw: DataFrame, resolved: DataFrame) -> DataFrame:
    """source, records, not specialist, unmatched records, names of every unmatched branch (null: none)."""
    told = outcomes(raw, resolved).groupBy("source").agg(F.count("*").alias("records"), _of(NOT_SPECIALIST).alias("not_specialist"), _of(UNMATCHED).alias("unmatched"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("unmatched_names")))).alias("names"))
    return told.select("source", "records", "not_specialist", "unmatched", F.when(F.size("names") > 0, F.col("names")).alias("unmatched_names"))


def write(raw: DataFrame, facilities: DataFrame, path: str) -> dict[str, int]:
    """Write records (outcomes), practitioners and sessions as Parquet below path, and return the load's counters.

    The counters are observed in the jobs that write, so nothing is scanned again for them. Names are resolved once, into a
    stored table that all three read. An empty load gives empty tables and zeros.
    """
    resolved = stored(resolve(raw, facilities))
    people, times = _tables(resolved)
    counts = {
        "records": (outcomes(raw, resolved), {"records": F.count("*"), "not_specialist": _of(NOT_SPECIALIST), "unmatched": _of(UNMATCHED)}),
        "practitioners": (people, {"practitioners": F.count("*")}),
        "sessions": (times, {"sessions": F.count("*")}),
    }
    seen: dict[str, int] = {}
    for name, (df, asked) in counts.items():
        watch = Observation(name)
        df.observe(watch, *[c.cast("long").alias(k) for k, c in asked.items()]).write.mode("overwrite").parquet(f"{path}/{name}")
        seen.update(watch.get)
    return seen
