"""Count status, masking, peer universes and the percentile capacity-gap score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.functions.rounding import rounded
from rosterlake.operators import coverage
from rosterlake.operators.matching import external_facilities

HAS, ZERO, UNKNOWN = "has_doctors", "confirmed_zero", "unknown"


@dataclass(frozen=True)
class Weights:
    """Shares of the four components; they add up to one."""

    count: float = 0.20
    hours: float = 0.30
    prime: float = 0.35
    weekend: float = 0.15
    least_completeness: float = 0.70

    def __post_init__(self) -> None:
        if abs(self.count + self.hours + self.prime + self.weekend - 1) > 1e-6:
            raise ValueError("weights must add up to 1")


def universe(facilities: DataFrame, name: str) -> DataFrame:
    """The peer universe: never duplicates; preferred, private or all."""
    rows = facilities.filter("duplicate_of IS NULL")
    if name == "preferred_private":
        return rows.filter("preferred")
    if name == "all_private":
        return rows.filter("ownership = 'swasta'")
    if name == "all_hospitals":
        return rows
    raise ValueError(f"unknown universe {name}")


def count_status(facilities: DataFrame, registered: DataFrame, incomplete_groups: tuple[str, ...] = ()) -> DataFrame:
    """id, n, status: none counts as zero only where the group's list is complete and non-empty elsewhere."""
    n = registered.groupBy("facility").agg(F.countDistinct("practitioner").alias("n"))
    rows = facilities.select("id", "grp").join(n, F.col("id") == F.col("facility"), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    listed = rows.filter((F.col("n") > 0) & F.col("grp").isNotNull()).select("grp").distinct().withColumn("listed", F.lit(True))
    group_known = F.coalesce(F.col("listed"), F.lit(False))
    bad = F.col("grp").isin(*incomplete_groups) if incomplete_groups else F.lit(False)
    status = F.when(F.col("n") > 0, HAS).when(bad, UNKNOWN).when(group_known, ZERO).otherwise(UNKNOWN)
    return rows.join(listed, "grp", "left").select("id", "n", status.alias("status"))


def metrics(facilities: DataFrame, sessions: DataFrame, registered: DataFrame, incomplete_groups: tuple[str, ...] = (), links: DataFrame | None = None) -> DataFrame:
    """One row for every facility; counts and hours are null where the status is unknown.

    Sessions are read twice: once for all sums (by facility and practitioner first, so that distinct people
    are rows), once for the set of covered cells, from which coverage and gaps follow. links (facility,
    person) adds the people a facility shares with others.
    """
    known = F.col("status").isin(HAS, ZERO)
    good = (F.col("confidence") != "low") & F.col("day").isNotNull() & F.col("start_min").isNotNull()
    length = F.col("end_min") - F.col("start_min")
    each = sessions.groupBy("facility", "practitioner").agg(
        F.count("*").alias("rows"), F.count_if(good).alias("good"), F.sum(F.when(good & (length > 0), length)).alias("minutes"),
        F.sum(F.when(good, coverage.overlap(coverage.PRIME))).alias("prime"), F.sum(F.when(good, coverage.overlap((coverage.WEEKEND,)))).alias("weekend"),
    )
    zero = F.lit(0)
    sums = each.groupBy("facility").agg(
        F.sum("rows").alias("rows"), F.sum("good").alias("good"), F.count_if(F.col("good") > 0).alias("with_good"),
        *[F.coalesce(F.sum(c), zero).alias(c) for c in ("minutes", "prime", "weekend")],
    )
    people = registered.groupBy("facility").agg(F.countDistinct("practitioner").alias("registered"))
    taken = coverage.cell_sets(sessions)
    out = facilities.join(count_status(facilities, registered, incomplete_groups), "id").withColumnRenamed("id", "facility")
    out = out.join(sums, "facility", "left").join(people, "facility", "left").join(taken, "facility", "left").withColumn("cells", F.coalesce("cells", F.array().cast("array<int>")))
    if links is None:
        out = out.withColumns({"shared_people": F.lit(None).cast("long"), "mean_other": F.lit(None).cast("double")})
    else:
        out = out.join(external_facilities(links), "facility", "left")
    hours = {n: F.when(known, rounded(F.coalesce(c, zero) / F.lit(60.0), 2)).alias(n) for n, c in (("weekly_hours", "minutes"), ("prime_hours", "prime"), ("weekend_hours", "weekend"))}
    prime, weekend = coverage.in_set("cells", coverage.PRIME), coverage.in_set("cells", (coverage.WEEKEND,))
    return out.select(
        "facility", "name", "grp", "ownership", "preferred", "duplicate_of", "city", "lat", "lon", "status",
        F.when(known, F.col("n")).alias("practitioners"), F.when(known, F.coalesce("good", zero)).alias("sessions"), *hours.values(),
        rounded(F.size("cells") / F.lit(float(coverage.CELLS)), 4).alias("coverage_ratio"),
        prime["coverage"].alias("prime_coverage"), rounded(1 - prime["coverage"], 4).alias("prime_gap"), prime["longest"].alias("prime_longest_gap"),
        weekend["coverage"].alias("weekend_coverage"), rounded(1 - weekend["coverage"], 4).alias("weekend_gap"),
        coverage.complete(F.col("rows"), F.col("good"), F.col("with_good"), F.col("registered")).alias("completeness"), "shared_people", "mean_other",
    )


def eligible(w: Weights) -> Column:
    """Unknown: no. Confirmed zero: yes. With practitioners: complete enough."""
    return F.when(F.col("status") == ZERO, True).when(F.col("status") == HAS, F.coalesce(F.col("completeness") >= w.least_completeness, F.lit(False))).otherwise(False)


def reason(w: Weights) -> Column:
    """Why a facility has no score; null if it has one."""
    return (
        F.when(eligible(w), F.lit(None).cast("string")).when(F.col("status") == UNKNOWN, "practitioner count unknown")
        .when(F.col("completeness").isNull(), "no schedule").otherwise(F.concat(F.lit("schedule "), F.rint(F.col("completeness") * 100).cast("long").cast("string"), F.lit("% complete")))
    )


def scarcity(x: Column, most: Column) -> Column:
    """1 - x/most within 0 and 1; null x or a largest value of 0 or less give 0, no peers 1."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.try_divide(x, most)))
    return F.when(most.isNull(), 1.0).when((most <= 0) | x.isNull(), 0.0).otherwise(share)


def scores(measured: DataFrame, peers: str, w: Weights = Weights()) -> DataFrame:
    """facility, four raw and normalised components, score and reason for a universe's facilities.

    Peer maxima come from facilities with practitioners; percentiles from all eligible ones, the
    confirmed zeros (all components 1) included.
    """
    rows = universe(measured, peers).withColumns({"ok": eligible(w), "reason": reason(w)})
    good = rows.filter("ok")
    most = good.filter(F.col("status") == HAS).agg(F.max("practitioners").alias("most_n"), F.max("weekly_hours").alias("most_h"))
    zero = F.col("status") == ZERO
    raw = good.crossJoin(F.broadcast(most)).select(
        "facility",
        F.when(zero, 1.0).otherwise(scarcity(F.col("practitioners"), F.col("most_n"))).alias("raw_count"),
        F.when(zero, 1.0).otherwise(scarcity(F.col("weekly_hours"), F.col("most_h"))).alias("raw_hours"),
        F.when(zero, 1.0).otherwise(F.coalesce("prime_gap", F.lit(0.0))).alias("raw_prime"),
        F.when(zero, 1.0).otherwise(F.coalesce("weekend_gap", F.lit(0.0))).alias("raw_weekend"),
    )
    names = ("count", "hours", "prime", "weekend")
    # ranks come from counts per distinct value of each component, not from sorting all rows in one task
    long = raw.select("facility", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"raw_{n}").alias("value")) for n in names])).alias("c")).select("facility", "c.name", "c.value")
    placed = long.join(percentile(long, "value", "norm", ("name",)), ["name", "value"])
    norms = placed.groupBy("facility").agg(*[F.max(F.when(F.col("name") == n, F.col("norm"))).alias(f"norm_{n}") for n in names])
    ranked = raw.join(norms, "facility")
    score = rounded(sum((F.lit(getattr(w, n)) * F.col(f"norm_{n}") for n in names), F.lit(0.0)), 4)
    done = ranked.select("facility", *[f"raw_{n}" for n in names], *[f"norm_{n}" for n in names], score.alias("score"))
    return rows.select("facility", "reason").join(done, "facility", "left")


def percentile(rows: DataFrame, value: str, into: str, by: tuple[str, ...] = ()) -> DataFrame:
    """by, value, into: the share of rows at or below each distinct value, to four places."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("n"))
    frame = Window.partitionBy(*by).orderBy(value)
    upto, total = frame.rowsBetween(Window.unboundedPreceding, 0), frame.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return counts.select(*by, value, rounded(F.sum("n").over(upto) / F.sum("n").over(total), 4).alias(into))


def quality_label() -> Column:
    return F.when(F.col("status") == ZERO, "confirmed_zero").when(F.col("score").isNotNull(), "complete").when(F.col("status") == HAS, "partial").otherwise("unknown")


def dashboard_filter(rows: DataFrame, cities=(), groups=(), least_n: int = 0, qualities=(), least_completeness: float = 0.0) -> DataFrame:
    """Optional filters; an empty or zero one does nothing."""
    if cities:
        rows = rows.filter(F.col("city").isin(*cities))
    if groups:
        rows = rows.filter(F.col("grp").isin(*groups))
    if least_n:
        rows = rows.filter(F.coalesce("practitioners", F.lit(0)) >= least_n)
    if qualities:
        rows = rows.filter(F.col("quality").isin(*qualities))
    if least_completeness:
        rows = rows.filter(F.coalesce("completeness", F.lit(0.0)) >= least_completeness)
    return rows


def ranking(rows: DataFrame) -> DataFrame:
    """Score descending, unscored last, then id."""
    return rows.orderBy(F.desc_nulls_last("score"), "facility")
