"""Queries of coverage, supply, status and score."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.operators import coverage, scoring
from rosterlake.plans.views import facility, person_link, roster, session, sql
from rosterlake.sources.staging import stored


def _measured(spark: SparkSession, d: str) -> DataFrame:
    """Every facility's metrics, stored once: the scores read them several times."""
    return stored(scoring.metrics(facility(spark, d), session(spark, d), roster(spark, d), ("NATION_1",), person_link(spark, d)))


def t16_bucket_explode(spark, d):
    return coverage.depth(coverage.cells(session(spark, d)))


def e06_coverage_ratio(spark, d):
    return coverage.coverage_ratio(coverage.cells(session(spark, d)))


def e02_supply(spark, d):
    return coverage.supply(session(spark, d))


def d14_window_hours(spark, d):
    return coverage.window_minutes(session(spark, d), coverage.PRIME, "prime_hours")


def f02_window_gaps(spark, d):
    return coverage.window_gaps(facility(spark, d), coverage.cells(session(spark, d)), coverage.PRIME, "prime")


def e08_completeness(spark, d):
    return coverage.completeness(session(spark, d), roster(spark, d))


def e20_heatmap(spark, d):
    return coverage.heatmap(coverage.cells(session(spark, d)))


def e20_heatmap_pivot(spark, d):
    return coverage.heatmap_wide(coverage.cells(session(spark, d)))


def m08_count_status(spark, d):
    return scoring.count_status(facility(spark, d), roster(spark, d), ("NATION_1",))


def m10_metrics(spark, d):
    return _measured(spark, d)


def m10_compute_core(spark, d):
    m = _measured(spark, d)
    return m.join(scoring.scores(m, "all_hospitals"), "facility", "left").select("facility", "status", "practitioners", "weekly_hours", "coverage_ratio", "prime_gap", "weekend_gap", "completeness", "norm_count", "norm_hours", "norm_prime", "norm_weekend", "score", "reason")


def m07_scores_by_universe(spark, d):
    m = _measured(spark, d)
    parts = [scoring.scores(m, u).withColumn("universe", F.lit(u)) for u in ("preferred_private", "all_private", "all_hospitals")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("universe", "facility", "raw_count", "raw_hours", "norm_count", "norm_hours", "score")


def g01_ranking(spark, d):
    m = _measured(spark, d)
    rows = m.join(scoring.scores(m, "all_hospitals"), "facility").withColumn("quality", scoring.quality_label())
    return scoring.ranking(rows.select("facility", "name", "quality", "score"))


def c09_dashboard(spark, d):
    m = _measured(spark, d)
    rows = m.join(scoring.scores(m, "all_hospitals"), "facility").withColumn("quality", scoring.quality_label())
    kept = scoring.dashboard_filter(rows, cities=("KOTA 0", "KOTA 2", "KOTA 3"), least_n=1, qualities=("complete", "partial"), least_completeness=0.2)
    return kept.select("facility", "city", "quality", "practitioners", "completeness", "score")


def c01_universes(spark, d):
    f = facility(spark, d)
    parts = [scoring.universe(f, u).select("id", F.lit(u).alias("universe")) for u in ("preferred_private", "all_private", "all_hospitals")]
    return parts[0].union(parts[1]).union(parts[2])


def e01_status_counts(spark, d):
    """A row for every status of the domain, zeros included."""
    s = scoring.count_status(facility(spark, d), roster(spark, d), ("NATION_1",))
    return s.agg(*[F.count_if(F.col("status") == k).alias(k) for k in (scoring.HAS, scoring.ZERO, scoring.UNKNOWN, "no_derm_service")]).unpivot([], [scoring.HAS, scoring.ZERO, scoring.UNKNOWN, "no_derm_service"], "status", "n")


_R4 = "decimals({}, 4)"
_RATIO = f"coverage AS (SELECT facility, {_R4.format('count(DISTINCT day * 28 + slot) / 196.0::DOUBLE')} AS coverage_ratio FROM cells GROUP BY 1)"
_SUPPLY = """supply AS (SELECT facility, count(DISTINCT practitioner) AS scheduled, count(*) AS sessions,
  decimals(coalesce(sum(CASE WHEN end_min - start_min > 0 THEN end_min - start_min END), 0)::DOUBLE / 60, 2) AS weekly_hours FROM usable GROUP BY 1)"""
_PRIME_HOURS = """prime_hours AS (SELECT facility, decimals(sum(CASE
    WHEN day <= 4 THEN greatest(0, least(end_min, 1260) - greatest(start_min, 1020))
    WHEN day = 5 THEN greatest(0, least(end_min, 840) - greatest(start_min, 480)) ELSE 0 END)::DOUBLE / 60, 2) AS prime_hours
  FROM usable WHERE end_min IS NOT NULL GROUP BY 1)"""


def _gaps(name: str, prefix: str, grid: str, source: str = "cells") -> str:
    return f"""{name}_m AS (SELECT f.id AS facility, g.day, g.slot, (c.facility IS NOT NULL)::INTEGER AS hit
    FROM facility f CROSS JOIN {grid} g LEFT JOIN (SELECT DISTINCT facility, day, slot FROM {source}) c ON c.facility = f.id AND c.day = g.day AND c.slot = g.slot),
  {name}_i AS (SELECT *, row_number() OVER (PARTITION BY facility, day ORDER BY slot) - row_number() OVER (PARTITION BY facility, day, hit ORDER BY slot) AS island FROM {name}_m),
  {name}_r AS (SELECT facility, day, hit, island, count(*) AS n FROM {name}_i GROUP BY ALL),
  {name}_s AS (SELECT facility, {_R4.format('sum(n * hit)::DOUBLE / sum(n)')} AS cov, coalesce(max(CASE WHEN hit = 0 THEN n END), 0) * 30 AS lg FROM {name}_r GROUP BY 1),
  {name} AS (SELECT facility, cov AS {prefix}_coverage, {_R4.format('(1 - cov)')} AS {prefix}_gap, lg AS {prefix}_longest_gap FROM {name}_s)"""


_COMPLETE = f"""complete AS (
  SELECT facility, {_R4.format('CASE WHEN people IS NULL THEN by_rows WHEN by_rows IS NULL THEN 0.0::DOUBLE ELSE least(by_rows, people) END')} AS completeness, registered
  FROM (SELECT facility, registered, CASE WHEN nrows > 0 THEN coalesce(good, 0)::DOUBLE / nrows END AS by_rows, CASE WHEN registered > 0 THEN coalesce(with_good, 0)::DOUBLE / registered END AS people
    FROM (SELECT facility, count(*) AS nrows FROM session GROUP BY 1)
    LEFT JOIN (SELECT facility, count(*) AS good, count(DISTINCT practitioner) AS with_good FROM usable GROUP BY 1) USING (facility)
    FULL JOIN (SELECT facility, count(DISTINCT practitioner) AS registered FROM roster GROUP BY 1) USING (facility)))"""
_STATUS = """counted AS (SELECT f.id, f.grp, coalesce(r.n, 0) AS n FROM facility f LEFT JOIN (SELECT facility, count(DISTINCT practitioner) AS n FROM roster GROUP BY 1) r ON r.facility = f.id),
status AS (SELECT id, n, CASE WHEN n > 0 THEN 'has_doctors' WHEN grp = 'NATION_1' THEN 'unknown'
    WHEN grp IN (SELECT grp FROM counted WHERE n > 0 AND grp IS NOT NULL) THEN 'confirmed_zero' ELSE 'unknown' END AS status FROM counted)"""
_OVERLAP = """others AS (SELECT person, count(*) - 1 AS other FROM person_link GROUP BY 1),
overlapping AS (SELECT facility, nullif(count(*) FILTER (other > 0), 0) AS shared_people, decimals(sum(other)::DOUBLE / nullif(count(*) FILTER (other > 0), 0), 2) AS mean_other FROM person_link JOIN others USING (person) GROUP BY 1),
weekend_hours AS (SELECT facility, decimals(sum(CASE WHEN day >= 5 THEN greatest(0, least(end_min, 1260) - greatest(start_min, 420)) ELSE 0 END)::DOUBLE / 60, 2) AS weekend_hours FROM usable WHERE end_min IS NOT NULL GROUP BY 1)"""
_METRICS = f"""{_RATIO}, {_SUPPLY}, {_PRIME_HOURS}, {_OVERLAP}, {_gaps('pg', 'prime', 'prime')}, {_gaps('wg', 'weekend', 'weekend')}, {_COMPLETE}, {_STATUS},
metrics AS (SELECT f.id AS facility, f.name, f.grp, f.ownership, f.preferred, f.duplicate_of, f.city, f.lat, f.lon, s.status,
  CASE WHEN s.status <> 'unknown' THEN s.n END AS practitioners, CASE WHEN s.status <> 'unknown' THEN coalesce(u.sessions, 0) END AS sessions,
  CASE WHEN s.status <> 'unknown' THEN coalesce(u.weekly_hours, 0.0::DOUBLE) END AS weekly_hours, CASE WHEN s.status <> 'unknown' THEN coalesce(h.prime_hours, 0.0::DOUBLE) END AS prime_hours,
  coalesce(c.coverage_ratio, 0.0::DOUBLE) AS coverage_ratio, pg.prime_coverage, pg.prime_gap, pg.prime_longest_gap, wg.weekend_coverage, wg.weekend_gap, k.completeness, o.shared_people, o.mean_other,
  CASE WHEN s.status <> 'unknown' THEN coalesce(e.weekend_hours, 0.0::DOUBLE) END AS weekend_hours
  FROM facility f JOIN status s ON s.id = f.id LEFT JOIN supply u ON u.facility = f.id LEFT JOIN prime_hours h ON h.facility = f.id LEFT JOIN coverage c ON c.facility = f.id
  LEFT JOIN pg ON pg.facility = f.id LEFT JOIN wg ON wg.facility = f.id LEFT JOIN complete k ON k.facility = f.id
  LEFT JOIN overlapping o ON o.facility = f.id LEFT JOIN weekend_hours e ON e.facility = f.id)"""


def _scored(universe: str, where: str) -> str:
    u = universe
    norm = lambda c: _R4.format(f"cume_dist() OVER (ORDER BY {c})")
    return f"""{u}_e AS (SELECT *, CASE status WHEN 'confirmed_zero' THEN true WHEN 'has_doctors' THEN coalesce(completeness >= 0.7::DOUBLE, false) ELSE false END AS ok FROM metrics WHERE duplicate_of IS NULL AND {where}),
  {u}_p AS (SELECT max(practitioners) AS mn, max(weekly_hours) AS mh FROM {u}_e WHERE ok AND status = 'has_doctors'),
  {u}_w AS (SELECT facility,
    CASE WHEN status = 'confirmed_zero' OR mn IS NULL THEN 1.0::DOUBLE WHEN mn <= 0 OR practitioners IS NULL THEN 0.0 ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - practitioners::DOUBLE / mn)) END AS raw_count,
    CASE WHEN status = 'confirmed_zero' OR mh IS NULL THEN 1.0::DOUBLE WHEN mh <= 0 OR weekly_hours IS NULL THEN 0.0 ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - weekly_hours / mh)) END AS raw_hours,
    CASE WHEN status = 'confirmed_zero' THEN 1.0::DOUBLE ELSE coalesce(prime_gap, 0) END AS raw_prime,
    CASE WHEN status = 'confirmed_zero' THEN 1.0::DOUBLE ELSE coalesce(weekend_gap, 0) END AS raw_weekend FROM {u}_e, {u}_p WHERE ok),
  {u}_n AS (SELECT *, {norm('raw_count')} AS norm_count, {norm('raw_hours')} AS norm_hours, {norm('raw_prime')} AS norm_prime, {norm('raw_weekend')} AS norm_weekend FROM {u}_w),
  {u}_s AS (SELECT *, {_R4.format('(0.0::DOUBLE + 0.2::DOUBLE * norm_count + 0.3::DOUBLE * norm_hours + 0.35::DOUBLE * norm_prime + 0.15::DOUBLE * norm_weekend)')} AS score FROM {u}_n),
  {u} AS (SELECT e.facility, s.* EXCLUDE (facility), CASE WHEN ok THEN NULL WHEN status = 'unknown' THEN 'practitioner count unknown' WHEN completeness IS NULL THEN 'no schedule'
    ELSE 'schedule ' || decimals(completeness * 100, 0)::BIGINT || '% complete' END AS reason FROM {u}_e e LEFT JOIN {u}_s s USING (facility))"""


_ALL = f"{_METRICS}, {_scored('all_hospitals', 'true')}"
_LABELLED = f"""{_ALL}, labelled AS (SELECT m.*, a.score, CASE WHEN m.status = 'confirmed_zero' THEN 'confirmed_zero' WHEN a.score IS NOT NULL THEN 'complete' WHEN m.status = 'has_doctors' THEN 'partial' ELSE 'unknown' END AS quality FROM metrics m JOIN all_hospitals a USING (facility))"""

QUERIES = {f.__name__: f for f in (t16_bucket_explode, e06_coverage_ratio, e02_supply, d14_window_hours, f02_window_gaps, e08_completeness, e20_heatmap, e20_heatmap_pivot, m08_count_status, m10_metrics, m10_compute_core, m07_scores_by_universe, g01_ranking, c09_dashboard, c01_universes, e01_status_counts)}

_HOUR = "SELECT facility, day, slot // 2 + 7 AS hour, least(max(practitioners), 2) AS level FROM (SELECT facility, day, slot, count(*) AS practitioners FROM cells GROUP BY ALL) GROUP BY ALL"
ORACLES = {
    "t16_bucket_explode": sql("SELECT facility, day, slot, count(*) AS practitioners FROM cells GROUP BY ALL"),
    "e06_coverage_ratio": sql(f"SELECT * FROM (WITH {_RATIO} SELECT * FROM coverage)"),
    "e02_supply": sql(f"SELECT * FROM (WITH {_SUPPLY} SELECT * FROM supply)"),
    "d14_window_hours": sql(f"SELECT * FROM (WITH {_PRIME_HOURS} SELECT * FROM prime_hours)"),
    "f02_window_gaps": sql(f"SELECT * FROM (WITH {_gaps('pg', 'prime', 'prime')} SELECT * FROM pg)"),
    "e08_completeness": sql(f"SELECT * FROM (WITH {_COMPLETE} SELECT * FROM complete)"),
    "e20_heatmap": sql(_HOUR),
    "e20_heatmap_pivot": sql("SELECT facility, day, " + ", ".join(f"coalesce(max(CASE WHEN hour = {h} THEN level END), 0) AS h{h:02d}" for h in range(7, 21)) + f" FROM ({_HOUR}) GROUP BY ALL"),
    "m08_count_status": sql(f"SELECT * FROM (WITH {_STATUS} SELECT * FROM status)"),
    "m10_metrics": sql(f"SELECT * FROM (WITH {_METRICS} SELECT * FROM metrics)"),
    "m10_compute_core": sql(f"SELECT * FROM (WITH {_ALL} SELECT facility, status, practitioners, weekly_hours, coverage_ratio, prime_gap, weekend_gap, completeness, norm_count, norm_hours, norm_prime, norm_weekend, score, reason FROM metrics LEFT JOIN all_hospitals USING (facility))"),
    "m07_scores_by_universe": sql(f"SELECT * FROM (WITH {_ALL}, {_scored('preferred_private', 'preferred')}, {_scored('all_private', 'ownership = ' + chr(39) + 'swasta' + chr(39))} " + " UNION ALL ".join(f"SELECT '{u}' AS universe, facility, raw_count, raw_hours, norm_count, norm_hours, score FROM {u}" for u in ("preferred_private", "all_private", "all_hospitals")) + ")"),
    "g01_ranking": sql(f"SELECT * FROM (WITH {_LABELLED} SELECT facility, name, quality, score FROM labelled ORDER BY score DESC NULLS LAST, facility)"),
    "c09_dashboard": sql(f"SELECT * FROM (WITH {_LABELLED} SELECT facility, city, quality, practitioners, completeness, score FROM labelled WHERE city IN ('KOTA 0', 'KOTA 2', 'KOTA 3') AND coalesce(practitioners, 0) >= 1 AND quality IN ('complete', 'partial') AND coalesce(completeness, 0) >= 0.2)"),
    "c01_universes": sql("SELECT id, 'preferred_private' AS universe FROM facility WHERE duplicate_of IS NULL AND preferred UNION ALL SELECT id, 'all_private' FROM facility WHERE duplicate_of IS NULL AND ownership = 'swasta' UNION ALL SELECT id, 'all_hospitals' FROM facility WHERE duplicate_of IS NULL"),
    "e01_status_counts": sql(f"SELECT * FROM (WITH {_STATUS} SELECT k AS status, count(s.id) AS n FROM (VALUES ('has_doctors'), ('confirmed_zero'), ('unknown'), ('no_derm_service')) d(k) LEFT JOIN status s ON s.status = d.k GROUP BY 1)"),
}
