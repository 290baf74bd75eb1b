"""Time-slot coverage and supply metrics per facility.

Sessions have facility, practitioner, day (0 is Monday), start_min, end_min (null: open-ended) and
confidence. The grid is 30-minute slots from 07:00 to 21:00 on seven days: 196 cells. Everything is
keyed by facility, so the aggregates share one partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rosterlake.functions.rounding import rounded

OPEN, CLOSE, SLOT, SLOTS, DAYS = 420, 1260, 30, 28, 7
CELLS = SLOTS * DAYS


@dataclass(frozen=True)
class TimeWindow:
    """A named weekly window: days and minutes from start to end."""

    name: str
    days: tuple[int, ...]
    start: int
    end: int

    def cell(self, day: Column, slot: Column) -> Column:
        t = slot * SLOT + OPEN
        return day.isin(*self.days) & (t >= self.start) & (t < self.end)


#: Fixed values.
EVENING = TimeWindow("weekday_evening", (0, 1, 2, 3, 4), 1020, 1260)
SATURDAY = TimeWindow("saturday", (5,), 480, 840)
WEEKEND = TimeWindow("weekend_full", (5, 6), 420, 1260)
PRIME = (EVENING, SATURDAY)


def usable(sessions: DataFrame) -> DataFrame:
    """Sessions with enough certainty, a day and a start."""
    return sessions.filter((F.col("confidence") != "low") & F.col("day").isNotNull() & F.col("start_min").isNotNull())


def cells(sessions: DataFrame) -> DataFrame:
    """Distinct (facility, day, slot, practitioner) that usable sessions mark.

    Marks are taken every 30 minutes from the session's own start (07:00 at the earliest), so an
    unaligned session marks the slots its samples fall into. An open end counts 30 minutes.
    """
    begin = F.greatest("start_min", F.lit(OPEN))
    end = F.least(F.coalesce("end_min", F.col("start_min") + SLOT), F.lit(CLOSE))
    marks = F.when(begin < end, F.sequence(begin, end - 1, F.lit(SLOT))).otherwise(F.array().cast("array<int>"))
    hit = usable(sessions).select("facility", "day", "practitioner", F.explode(marks).alias("t"))
    return hit.select("facility", "day", F.floor((F.col("t") - OPEN) / SLOT).cast("long").alias("slot"), "practitioner").distinct()


def depth(covered: DataFrame) -> DataFrame:
    """Practitioners per (facility, day, slot)."""
    return covered.groupBy("facility", "day", "slot").agg(F.count("*").alias("practitioners"))


def coverage_ratio(covered: DataFrame) -> DataFrame:
    """Share of the 196 cells with anyone."""
    return covered.groupBy("facility").agg(rounded(F.countDistinct("day", "slot") / F.lit(float(CELLS)), 4).alias("coverage_ratio"))


def supply(sessions: DataFrame) -> DataFrame:
    """Scheduled practitioners, sessions (open-ended ones too) and weekly hours of closed ones."""
    length = F.col("end_min") - F.col("start_min")
    return usable(sessions).groupBy("facility").agg(
        F.countDistinct("practitioner").alias("scheduled"), F.count("*").alias("sessions"),
        rounded(F.coalesce(F.sum(F.when(length > 0, length)), F.lit(0)) / F.lit(60.0), 2).alias("weekly_hours"),
    )


def window_minutes(sessions: DataFrame, windows: tuple[TimeWindow, ...], name: str) -> DataFrame:
    """Hours of overlap with each of the windows, summed: overlapping windows both count."""
    closed = usable(sessions).filter("end_min IS NOT NULL")
    return closed.groupBy("facility").agg(rounded(F.sum(overlap(windows)) / F.lit(60.0), 2).alias(name))


def overlap(windows: tuple[TimeWindow, ...]) -> Column:
    """Minutes of a session inside the windows, one after the other; 0 for an open-ended one."""
    total = F.lit(0)
    for w in windows:
        inside = F.greatest(F.lit(0), F.least("end_min", F.lit(w.end)) - F.greatest("start_min", F.lit(w.start)))
        total = total + F.when(F.col("day").isin(*w.days) & F.col("end_min").isNotNull(), inside).otherwise(0)
    return total


def cell_sets(sessions: DataFrame) -> DataFrame:
    """facility and its covered cells as day * SLOTS + slot: an array of 196 at most."""
    marks = cells(sessions).select("facility", (F.col("day") * SLOTS + F.col("slot")).cast("int").alias("cell"))
    return marks.groupBy("facility").agg(F.collect_set("cell").alias("cells"))


def in_set(cells: str, windows: tuple[TimeWindow, ...]) -> Column:
    """struct(coverage, longest): share of the windows' cells in an array of cells, and the longest run
    of others in minutes; runs stay within a day and follow the windows' own cells."""
    wanted = [d * SLOTS + s for d in range(DAYS) for s in range(SLOTS) if any(d in w.days and w.start <= s * SLOT + OPEN < w.end for w in windows)]
    all_ = F.array(*[F.lit(c) for c in wanted])
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"), F.lit(-1).alias("day"))

    def step(s: Column, c: Column) -> Column:
        day = F.floor(c / SLOTS).cast("int")
        run = F.when(F.array_contains(cells, c), 0).when(day == s["day"], s["run"] + 1).otherwise(1)
        return F.struct(run.alias("run"), F.greatest(s["best"], run).alias("best"), day.alias("day"))

    share = rounded(F.size(F.array_intersect(all_, F.col(cells))) / F.lit(float(len(wanted))), 4)
    return F.struct(share.alias("coverage"), (F.aggregate(all_, start, step)["best"] * SLOT).alias("longest"))


def complete(rows: Column, good: Column, with_good: Column, registered: Column) -> Column:
    """min(usable rows / rows, practitioners with usable rows / registered); registered but no rows: 0."""
    by_rows = F.when(rows > 0, F.coalesce(good, F.lit(0)) / rows)
    by_people = F.when(registered > 0, F.coalesce(with_good, F.lit(0)) / registered)
    return rounded(F.when(by_people.isNull(), by_rows).when(by_rows.isNull(), 0.0).otherwise(F.least(by_rows, by_people)), 4)


def grid(spark: SparkSession) -> DataFrame:
    """The 196 cells: a constant table, broadcast by its size."""
    return spark.range(CELLS).select(F.floor(F.col("id") / SLOTS).cast("int").alias("day"), (F.col("id") % SLOTS).alias("slot"))


def in_windows(windows: tuple[TimeWindow, ...]) -> Column:
    hit = F.lit(False)
    for w in windows:
        hit = hit | w.cell(F.col("day"), F.col("slot"))
    return hit


def window_gaps(facilities: DataFrame, covered: DataFrame, windows: tuple[TimeWindow, ...], prefix: str) -> DataFrame:
    """Per facility: coverage and gap ratio inside the windows, and the longest uncovered run in minutes.

    Runs stay within a day and follow the windows' own cells. A facility without any mark is all gap.
    """
    spark = facilities.sparkSession
    wanted = grid(spark).filter(in_windows(windows))
    asked = facilities.select(F.col("id").alias("facility")).crossJoin(F.broadcast(wanted))
    seen = covered.filter(in_windows(windows)).select("facility", "day", "slot").distinct().withColumn("hit", F.lit(1))
    marked = asked.join(seen, ["facility", "day", "slot"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    by_day = Window.partitionBy("facility", "day").orderBy("slot")
    run = marked.withColumn("island", F.row_number().over(by_day) - F.row_number().over(Window.partitionBy("facility", "day", "hit").orderBy("slot")))
    runs = run.groupBy("facility", "day", "hit", "island").agg(F.count("*").alias("n"))
    both = runs.groupBy("facility").agg(
        F.sum(F.col("n") * F.col("hit")).alias("covered"), F.sum("n").alias("total"),
        F.coalesce(F.max(F.when(F.col("hit") == 0, F.col("n"))), F.lit(0)).alias("longest"),
    )
    share = rounded(F.col("covered") / F.col("total"), 4)
    return both.select("facility", share.alias(f"{prefix}_coverage"), rounded(1 - share, 4).alias(f"{prefix}_gap"), (F.col("longest") * SLOT).alias(f"{prefix}_longest_gap"))


def completeness(sessions: DataFrame, registered: DataFrame) -> DataFrame:
    """min(usable rows / rows, practitioners with usable rows / registered); registered but no rows: 0."""
    rows = sessions.groupBy("facility").agg(F.count("*").alias("rows"))
    good = usable(sessions).groupBy("facility").agg(F.count("*").alias("good"), F.countDistinct("practitioner").alias("with_good"))
    known = registered.groupBy("facility").agg(F.countDistinct("practitioner").alias("registered"))
    joined = rows.join(good, "facility", "left").join(known, "facility", "full").select("facility", "rows", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("with_good", F.lit(0)).alias("with_good"), "registered")
    return joined.select("facility", complete(F.col("rows"), F.col("good"), F.col("with_good"), F.col("registered")).alias("completeness"), "registered")


def heatmap(covered: DataFrame, cap: int = 2) -> DataFrame:
    """Per (facility, day, hour) the larger of the two half-hour depths, capped."""
    return depth(covered).groupBy("facility", "day", (F.floor(F.col("slot") / 2) + OPEN // 60).alias("hour")).agg(F.least(F.max("practitioners"), F.lit(cap)).alias("level"))


def heatmap_wide(covered: DataFrame, cap: int = 2) -> DataFrame:
    """The heat map with a column for each hour from 7 to 20; empty cells are 0."""
    hours = list(range(OPEN // 60, CLOSE // 60))
    wide = heatmap(covered, cap).groupBy("facility", "day").pivot("hour", hours).agg(F.max("level"))
    return wide.select("facility", "day", *[F.coalesce(F.col(str(h)), F.lit(0)).alias(f"h{h:02d}") for h in hours])
