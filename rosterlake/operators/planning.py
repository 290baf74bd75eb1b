"""Free-gap suggestions and constrained weekly plans.

A plan is a set of sessions (all locked ones and some optional ones) with a school. Sets are
bit masks; filters give the first reason that applies; days, with the runs to and from school, are
routed over a travel table with lag(); the score is a weighted mean of up to five shares. The tables
of sessions and schools are small by contract (16 and 5 at most), which bounds the plans to 25 000;
those limits are checked.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import isfinite

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.functions.rounding import rounded
from rosterlake.operators.coverage import usable
from rosterlake.sources.staging import stored

MOST_SESSIONS, MOST_SCHOOLS, MOST_PLANS = 16, 5, 25_000
#: Places and schools that stand for home and for none.
HOME, NO_SCHOOL = -1, -1
#: Runs to and from school: (brought, fetched).
MODES = {"both": (True, True), "drop-off": (True, False), "pick-up": (False, True), "other": (False, False)}
SCHOOL_REASONS = ("level", "budget unknown", "over budget", "too far")


@dataclass(frozen=True)
class Limits:
    """Fixed defaults of a week."""

    sessions: int = 4
    days: int = 5
    hours: float = 40.0
    leg_minutes: int = 120
    earliest: int = 360
    latest: int = 1320
    buffer: int = 15
    school_km: float = 20.0
    budget: float | None = None
    weights: tuple[float, float, float, float, float] = (40, 40, 20, 0, 0)
    mode: str = "both"
    service: int = 10
    prefers_curriculum: bool = False

    def __post_init__(self) -> None:
        if not all(isfinite(w) and w >= 0 for w in self.weights) or not sum(self.weights):
            raise ValueError("weights must be finite, not negative, nor all zero")
        if not 0 <= self.earliest < self.latest <= 1439:
            raise ValueError("a day begins before it ends")
        if not 1 <= self.sessions <= 8 or not 1 <= self.days <= 7 or self.hours <= 0:
            raise ValueError("1 to 8 sessions on 1 to 7 days, and some hours")
        if not 0 <= self.buffer <= 120 or not 0 <= self.service <= 60 or self.leg_minutes <= 0 or self.school_km <= 0:
            raise ValueError("buffer, school service, longest leg or distance out of range")
        if self.budget is not None and not (isfinite(self.budget) and self.budget >= 0):
            raise ValueError("a budget is finite and not negative")
        if self.mode not in MODES:
            raise ValueError(f"mode is one of {', '.join(MODES)}")


def free_gaps(sessions: DataFrame, facilities: DataFrame, completeness: DataFrame, minutes: int = 240, limit: int = 16, days: int = 6, least: float = 0.8) -> DataFrame:
    """Suggested new sessions: per facility and day the first start from 08:00 in steps of the length that overlaps no usable
    session. Only facilities whose schedule is known well enough are asked: completeness (facility, completeness)
    of least or more, and a usable session at all. Days with an open-ended session are left out. Facilities take turns.

    facilities: id, position (their order).
    """
    known = usable(sessions)
    sure = completeness.filter(F.col("completeness") >= least).select(F.col("facility").alias("id")).distinct().join(known.select(F.col("facility").alias("id")).distinct(), "id")
    starts = F.sequence(F.lit(480), F.lit(1260 - minutes), F.lit(minutes))
    asked = facilities.join(sure, "id", "left_semi").select(F.col("id").alias("facility"), "position", F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("day"))
    open_days = known.filter("end_min IS NULL").select("facility", "day").distinct()
    wanted = asked.join(open_days, ["facility", "day"], "left_anti").withColumn("start", F.explode(starts))
    taken = known.filter("end_min IS NOT NULL").select("facility", "day", "start_min", "end_min")
    clash = (wanted.facility == taken.facility) & (wanted.day == taken.day) & (wanted.start < taken.end_min) & (taken.start_min < wanted.start + minutes)
    free = wanted.join(taken, clash, "left_anti").groupBy("facility", "position", "day").agg(F.min("start").alias("start"))
    turn = F.row_number().over(Window.partitionBy("facility").orderBy("day"))
    return free.withColumn("turn", turn).orderBy("turn", "position").limit(limit).select("facility", "day", "start", (F.col("start") + minutes).alias("end"), "turn")


def school_costs(schools: DataFrame) -> DataFrame:
    """First year and recurring cost; null as soon as a part is unknown."""
    return schools.withColumns({
        "first_year": F.col("admission") + 12 * F.col("monthly") + F.col("annual") + F.col("other"),
        "recurring": 12 * F.col("monthly") + F.col("annual"),
    })


def masks(sessions: DataFrame, count: int) -> DataFrame:
    """mask: every choice of optional sessions that makes up count with all locked ones.

    sessions: slot (0 upward, unique), locked.
    """
    rows = sessions.select("slot", "locked").collect()
    if len(rows) > MOST_SESSIONS or len({r["slot"] for r in rows}) < len(rows):
        raise ValueError(f"at most {MOST_SESSIONS} sessions, each slot once")
    locked = sum(1 << r["slot"] for r in rows if r["locked"])
    every = sum(1 << r["slot"] for r in rows)
    if not bin(locked).count("1") <= count <= len(rows):
        raise ValueError("the number of sessions takes in all locked ones and no more than there are")
    spark = sessions.sparkSession
    all_ = spark.range(every + 1).select(F.col("id").alias("mask"))
    inside = (F.col("mask").bitwiseAND(F.lit(every)) == F.col("mask")) & (F.col("mask").bitwiseAND(F.lit(locked)) == locked)
    return all_.filter(inside & (F.bit_count(F.col("mask")) == count))


def _taken(plans: DataFrame, sessions: DataFrame) -> DataFrame:
    """plans by the sessions in their mask."""
    return plans.join(F.broadcast(sessions), F.expr("shiftright(mask, cast(slot AS int)) & 1 = 1"))


def _keys(plans: DataFrame) -> list[str]:
    return [c for c in ("mask", "school") if c in plans.columns]


def week_events(plans: DataFrame, sessions: DataFrame, schools: DataFrame | None, limits: Limits) -> DataFrame:
    """The plans' keys with day, start, end, place, practice, seq: sessions, and the runs to and from school.

    Schools with place, days (array), start and end give runs as limits.mode says; others give none.
    """
    chosen = plans.select(*_keys(plans)).distinct()
    practice = _taken(chosen, sessions).select(
        *_keys(plans), F.col("day").cast("int").alias("day"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"),
        F.col("facility").cast("long").alias("place"), F.lit(True).alias("practice"), F.col("slot").cast("long").alias("seq"),
    )
    if schools is None or "place" not in schools.columns:
        return practice
    brought, fetched = MODES[limits.mode]
    run = lambda start, end, seq: F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(seq).cast("long").alias("seq"))
    wanted = [run(F.col("start") - limits.service, F.col("start"), MOST_SESSIONS)] * brought + [run(F.col("end"), F.col("end") + limits.service, MOST_SESSIONS + 1)] * fetched
    if not wanted:
        return practice
    runs = schools.withColumn("run", F.explode(F.array(*wanted))).withColumn("day", F.explode("days"))
    runs = runs.select("school", F.col("day").cast("int").alias("day"), "run.start", "run.end", F.col("place").cast("long").alias("place"), F.lit(False).alias("practice"), "run.seq")
    return practice.unionByName(chosen.join(F.broadcast(runs), "school"))


def enumerate_plans(sessions: DataFrame, schools: DataFrame, limits: Limits) -> DataFrame:
    """mask, school, reason: the first rule a plan breaks, or null; with no school at all, plans of NO_SCHOOL.

    sessions: slot, facility, day, start, end, locked, priority, optionally id (text) for the order of
    ties. schools: school, level_ok, km (see school_distances), first_year (null: unknown), curriculum_ok
    (null: unknown), optionally place, days, start, end (see week_events). Two more columns are for notes only:
    sessions' suggested (not confirmed by the facility), and schools' documented (school year and source of the costs given).
    """
    n_schools = schools.count()
    if n_schools > MOST_SCHOOLS:
        raise ValueError(f"at most {MOST_SCHOOLS} schools")
    if not n_schools:
        none = schools.sparkSession.range(1).select(F.lit(NO_SCHOOL).cast("long").alias("school"), F.lit(True).alias("level_ok"))
        schools = schools.withColumn("school", F.col("school").cast("long")).unionByName(none, allowMissingColumns=True)
    chosen = masks(sessions, limits.sessions)
    if chosen.count() * max(n_schools, 1) > MOST_PLANS:
        raise ValueError(f"more than {MOST_PLANS} plans")
    length = F.col("end") - F.col("start")
    named = F.struct((~F.col("locked")).alias("free"), "slot", (F.col("id") if "id" in sessions.columns else F.col("slot")).cast("string").alias("id"))
    facts = _taken(chosen, sessions).groupBy("mask").agg(
        F.countDistinct("day").alias("n_days"), (F.sum(length) / F.lit(60.0)).alias("hours"), (F.sum(length * F.col("priority")) / F.sum(length) / F.lit(5.0)).alias("priority"),
        F.transform(F.array_sort(F.collect_list(named)), lambda s: s["id"]).alias("slots"), *([F.bool_or("suggested").alias("suggested")] if "suggested" in sessions.columns else []),
    )
    plans = facts.crossJoin(F.broadcast(schools))
    after = F.lead("start").over(Window.partitionBy("mask", "school", "day").orderBy("start", "end", "seq"))
    clash = week_events(plans, sessions, schools, limits).withColumn("clash", F.col("end") > after).filter("clash").select("mask", "school", "clash").distinct()
    asks_cost = F.lit(limits.budget is not None) & (F.col("school") != NO_SCHOOL)
    reason = (
        F.when(~F.col("level_ok"), "level").when(asks_cost & F.col("first_year").isNull(), "budget unknown").when(asks_cost & (F.col("first_year") > F.lit(limits.budget)), "over budget")
        .when(F.col("km") > limits.school_km, "too far").when((F.col("n_days") > limits.days) | (F.col("hours") > limits.hours), "days or hours").when(F.col("clash"), "overlap")
    )
    return plans.join(clash, ["mask", "school"], "left").withColumn("reason", reason).drop("clash")


def rejections(plans: DataFrame) -> DataFrame:
    """How many plans each reason refuses; a reason that refuses a school as such counts once a school."""
    by_school = F.coalesce(F.col("reason"), F.lit("")).isin(*SCHOOL_REASONS)
    return plans.select(F.coalesce("reason", F.lit("kept")).alias("reason"), "school", F.when(~by_school, F.col("mask")).alias("mask")).distinct().groupBy("reason").agg(F.count("*").alias("n"))


def same_points(travel: DataFrame, places: DataFrame) -> DataFrame:
    """travel with nothing to go between places of equal coordinates, at any time. places: place, lat, lon."""
    a, b = places.select(F.col("place").alias("origin"), "lat", "lon"), places.select(F.col("place").alias("destination"), "lat", "lon")
    still = a.join(b, ["lat", "lon"]).select("origin", "destination", F.lit(True).alias("still"))
    zero = [(F.when(F.col("still"), F.lit(0)).otherwise(F.col(c)) if c in ("minutes", "km") else F.col(c)).cast(travel.schema[c].dataType).alias(c) for c in travel.columns if c not in ("origin", "destination")]
    return travel.join(still, ["origin", "destination"], "full").select("origin", "destination", *zero)


def profiles(travel: DataFrame) -> DataFrame:
    """origin, destination, day (null: any), arrive_by, times: what a way takes, by the minute of the day.

    travel: origin, destination, minutes, optionally km, day, minute (from when a row holds, 0 if not given) and
    arrive_by (whether the minute is one of arrival; null: both). A way has as many rows as its day has times.
    """
    given = lambda c, kind: (F.col(c) if c in travel.columns else F.lit(None)).cast(kind)
    both = F.explode(F.when(given("arrive_by", "boolean").isNull(), F.array(F.lit(True), F.lit(False))).otherwise(F.array(given("arrive_by", "boolean"))))
    row = F.struct(F.coalesce(given("minute", "int"), F.lit(0)).alias("minute"), F.col("minutes").cast("double").alias("minutes"), given("km", "double").alias("km"))
    rows = travel.select("origin", "destination", given("day", "int").alias("day"), both.alias("arrive_by"), row.alias("row"))
    return rows.groupBy("origin", "destination", "day", "arrive_by").agg(F.array_sort(F.collect_list("row")).alias("times"))


def timed(legs: DataFrame, travel: DataFrame) -> DataFrame:
    """legs (origin, destination, day, at, arrive_by) plus told, the row of the way in force at that minute: the last one that began,
    of the day's own times, else of those for any day; null where there is none."""
    known = profiles(travel)
    keys = ["origin", "destination", "arrive_by"]
    own = known.filter("day IS NOT NULL").withColumnRenamed("times", "own")
    any_ = known.filter("day IS NULL").drop("day").withColumnRenamed("times", "any_day")
    in_force = lambda times: F.element_at(F.filter(times, lambda t: t["minute"] <= F.col("at")), -1)
    some = lambda times: F.when(F.exists(times, lambda t: t["minute"] <= F.col("at")), in_force(times))
    return legs.join(own, [*keys, "day"], "left").join(any_, keys, "left").withColumn("told", F.coalesce(some(F.col("own")), some(F.col("any_day")))).drop("own", "any_day")


def school_distances(schools: DataFrame, travel: DataFrame, limits: Limits | None = None) -> DataFrame:
    """schools with km, the way from home to their place for the first school day's start; null where travel has none."""
    limits = limits or Limits()
    timely = {"days", "start"} <= set(schools.columns)
    day = F.coalesce(F.array_min("days"), F.lit(0)) if timely else F.lit(0)
    at = F.col("start") - limits.service - limits.buffer if timely else F.lit(1439)
    legs = schools.drop("km").select("*", F.lit(HOME).cast("long").alias("origin"), F.col("place").cast("long").alias("destination"), day.cast("int").alias("day"), at.cast("int").alias("at"), F.lit(True).alias("arrive_by"))
    return timed(legs, travel).withColumn("km", F.col("told.km")).drop("origin", "destination", "day", "at", "arrive_by", "told")


def commute(plans: DataFrame, sessions: DataFrame, travel: DataFrame, limits: Limits, schools: DataFrame | None = None) -> DataFrame:
    """The plans' keys and minutes: each day from home by its events in order and back.

    On days with runs to school only, each run is a way of its own, and the next one starts no earlier
    than the return from the last. travel: see profiles(). The first leg of a way is asked for by its arrival, the buffer
    before the event, and reckoned back from there; later legs are asked for by their departure, when an event ends. A
    leg without a row, a leg above the cap, a late arrival or a day outside the limits drops the plan: travel times are
    never made up.
    """
    keys, order = _keys(plans), ("start", "end", "seq")
    events = week_events(plans, sessions, schools, limits)
    day = Window.partitionBy(*keys, "day")
    tours = events.withColumn("tour", F.when(F.bool_or("practice").over(day), 0).otherwise(F.row_number().over(day.orderBy(*order))))
    on = Window.partitionBy(*keys, "day", "tour").orderBy(*order)
    home = F.lit(HOME).cast("long")
    steps = tours.withColumns({"origin": F.coalesce(F.lag("place").over(on), home), "left_at": F.lag("end").over(on), "last": F.lead("seq").over(on).isNull()})
    there = steps.select(*keys, "day", "tour", "origin", F.col("place").alias("destination"), "left_at", F.col("start").alias("due"))
    back = steps.filter("last").select(*keys, "day", "tour", F.col("place").alias("origin"), home.alias("destination"), F.col("end").alias("left_at"), F.lit(None).cast("int").alias("due"))
    asked = there.unionByName(back).withColumns({"arrive_by": F.col("left_at").isNull(), "at": F.coalesce(F.col("left_at"), F.col("due") - limits.buffer)})
    legs = timed(asked, travel).withColumn("minutes", F.when(F.col("origin") == F.col("destination"), 0.0).otherwise(F.col("told.minutes")))
    leaves, returns = F.col("due") - limits.buffer - F.col("minutes"), F.col("left_at") + F.col("minutes")
    first, last = F.col("left_at").isNull(), F.col("due").isNull()
    in_time = F.when(first, leaves >= limits.earliest).when(last, returns <= limits.latest).otherwise(returns <= F.col("due") - limits.buffer)
    ok = F.coalesce((F.col("minutes") <= limits.leg_minutes) & in_time, F.lit(False))
    ways = legs.groupBy(*keys, "day", "tour").agg(F.bool_and(ok).alias("ok"), F.sum("minutes").alias("minutes"), F.max(F.when(first, leaves)).alias("out_at"), F.max(F.when(last, returns)).alias("back_at"))
    rested = F.coalesce(F.col("out_at") >= F.lag("back_at").over(day.orderBy("tour")), F.lit(True))
    return ways.withColumn("ok", F.col("ok") & rested).groupBy(*keys).agg(F.bool_and("ok").alias("ok"), F.sum("minutes").alias("minutes")).filter("ok").drop("ok")


def routed(plans: DataFrame, sessions: DataFrame, schools: DataFrame, travel: DataFrame, limits: Limits) -> DataFrame:
    """plans with minutes, and extra, the minutes that the school adds to the same sessions.

    Plans that no rule refused so far get the reasons travel (the week cannot be driven) and baseline
    (nor could its sessions alone).
    """
    plans = stored(plans)  # read four times below
    still = plans.filter("reason IS NULL")
    week = commute(still, sessions, travel, limits, schools)
    alone = commute(still.select("mask"), sessions, travel, limits).withColumnRenamed("minutes", "baseline")
    found = plans.join(week, ["mask", "school"], "left").join(alone, "mask", "left")
    told = found.withColumn("reason", F.coalesce("reason", F.when(F.col("minutes").isNull(), "travel").when(F.col("baseline").isNull(), "baseline")))
    kept = F.col("reason").isNull()
    return told.withColumns({"extra": F.when(kept, F.col("minutes") - F.col("baseline")), "minutes": F.when(kept, F.col("minutes"))}).drop("baseline")


def rank_plans(plans: DataFrame, limits: Limits, best: int = 5) -> DataFrame:
    """The best plan of each school first, then the next ones, at most best; final order by score.

    plans: as routed() gives them. A plan whose school lacks what a weight asks for has no score, and a
    note says so; ties go by minutes, then the sessions' ids as text, then the school.
    """
    rows = plans.filter("reason IS NULL")
    over = Window.partitionBy()  # 25 000 rows at most
    share = lambda c: F.coalesce(F.when(F.max(c).over(over) > 0, 1 - F.col(c) / F.max(c).over(over)), F.lit(1.0))
    w, schooled = limits.weights, F.col("school") != NO_SCHOOL
    likes = schooled & F.lit(limits.prefers_curriculum)
    unranked = (schooled & F.lit(w[3] > 0) & F.col("first_year").isNull()) | (likes & F.lit(w[4] > 0) & F.col("curriculum_ok").isNull())
    cost = F.when(F.col("first_year").isNull(), F.lit(0.0)).otherwise(share("first_year"))
    parts = F.lit(w[0]) * share("minutes") + F.lit(w[1]) * F.col("priority") + F.lit(w[2]) * F.least(F.col("hours") / limits.hours, F.lit(1.0))
    parts = parts + F.when(schooled, w[3] * cost).otherwise(0.0) + F.when(likes, w[4] * F.coalesce(F.col("curriculum_ok"), F.lit(False)).cast("double")).otherwise(0.0)
    total = F.lit(float(sum(w[:3]))) + F.when(schooled, float(w[3])).otherwise(0.0) + F.when(likes, float(w[4])).otherwise(0.0)
    score = F.when(~unranked & (total > 0), rounded(100 * parts / total, 2))
    told = lambda c: F.col(c) if c in plans.columns else F.lit(None).cast("boolean")
    notes = F.array_compact(F.array(
        F.when(told("suggested"), "holds a suggested session that no facility has confirmed"), F.when(schooled & F.col("first_year").isNull(), "first-year cost unknown"),
        F.when(schooled & ~told("documented"), "school year or source of the costs missing: verify"), F.when(unranked, "not ranked: school data missing"),
    ))
    scored = rows.withColumns({"score": score, "notes": notes})
    order = [F.desc_nulls_last("score"), F.col("minutes"), F.col("slots"), F.col("school")]
    turn = scored.withColumn("turn", F.row_number().over(Window.partitionBy("school").orderBy(*order)))
    later = F.col("turn") > 1
    return turn.orderBy(later, *order).limit(best).orderBy(order[0], order[1], later, *order[2:]).select("mask", "school", "minutes", "extra", "hours", "score", "notes")
