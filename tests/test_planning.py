"""Weeks with runs to school, in small cases worked out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rosterlake.operators import planning, registry
from rosterlake.sources import sinks

SESSION = "slot long, facility long, day int, start int, end int, locked boolean, priority int"
SCHOOL = "school long, place long, level_ok boolean, km double, first_year double, curriculum_ok boolean, days array<int>, start int, end int"
TRAVEL = "origin long, destination long, minutes int"


@pytest.fixture
def week(spark):
    sessions = spark.createDataFrame([(0, 7, 0, 600, 700, True, 5), (1, 8, 1, 600, 720, False, 3)], SESSION)
    schools = spark.createDataFrame([(1, 9, True, 3.0, None, None, [0, 2], 450, 800)], SCHOOL)
    ways = [(-1, 7, 20), (7, -1, 20), (-1, 8, 30), (8, -1, 30), (-1, 9, 10), (9, -1, 10), (9, 7, 25), (7, 9, 25)]
    return sessions, schools, spark.createDataFrame(ways, TRAVEL)


def plan(spark, week, **limits):
    limits = planning.Limits(sessions=1, **limits)
    sessions, schools, travel = week
    return planning.routed(planning.enumerate_plans(sessions, schools, limits), sessions, schools, travel, limits), limits


def test_school_days(spark, week):
    """Monday: home, school, practice, school, home; Wednesday: two ways from home and back."""
    row = plan(spark, week)[0].first()
    assert (row["reason"], row["minutes"], row["extra"]) == (None, 10 + 25 + 25 + 10 + 4 * 10, 70 + 40 - 40)
    assert plan(spark, week, mode="other")[0].first()["extra"] == 0
    assert plan(spark, week, mode="drop-off")[0].first()["minutes"] == 10 + 25 + 20 + 20


def test_second_way_waits_for_the_return(spark, week):
    sessions, schools, travel = week
    close = schools.withColumn("end", F.lit(475))  # fetched from 475, so out at 450; back at 460 from the first way
    late = planning.routed(planning.enumerate_plans(sessions, close, planning.Limits(sessions=1)), sessions, close, travel, planning.Limits(sessions=1)).first()
    assert late["reason"] == "travel"


def test_reasons(spark, week):
    sessions, schools, travel = week
    assert plan(spark, week, budget=1.0)[0].first()["reason"] == "budget unknown"
    dear = schools.withColumn("first_year", F.lit(2.0))
    assert plan(spark, (sessions, dear, travel), budget=1.0)[0].first()["reason"] == "over budget"
    assert plan(spark, week, school_km=2.0)[0].first()["reason"] == "too far"
    assert plan(spark, (sessions, schools.withColumn("end", F.lit(650)), travel))[0].first()["reason"] == "overlap"
    assert plan(spark, (sessions, schools, travel.filter("origin <> 7 OR destination <> -1")))[0].first()["reason"] == "baseline"


def test_no_school(spark, week):
    sessions, schools, travel = week
    plans, limits = plan(spark, (sessions, schools.limit(0), travel))
    row = planning.rank_plans(plans, limits).first()
    assert (row["school"], row["minutes"], row["extra"], row["notes"]) == (planning.NO_SCHOOL, 40, 0, [])
    assert row["score"] == pytest.approx(round(100 * (40 * 0 + 40 * 1 + 20 * (100 / 60 / 40)) / 100, 2))


def test_unranked_plans_have_a_note(spark, week):
    plans, limits = plan(spark, week, weights=(1, 1, 1, 1, 0))
    row = planning.rank_plans(plans, limits).first()
    assert row["score"] is None and row["notes"] == ["first-year cost unknown", "not ranked: school data missing"]


def test_rejections_count_a_school_once(spark, week):
    sessions, schools, travel = week
    free = sessions.withColumn("locked", F.lit(False))
    plans, _ = plan(spark, (free, schools.withColumn("level_ok", F.lit(False)), travel))
    assert plans.count() == 2
    assert [tuple(r) for r in planning.rejections(plans).collect()] == [("level", 1)]


def test_too_few_or_too_many_sessions(spark, week):
    for n in (0, 3):
        with pytest.raises(ValueError):
            planning.masks(week[0], n)


def test_no_way_between_equal_points(spark, week):
    places = spark.createDataFrame([(7, 1.0, 2.0), (9, 1.0, 2.0), (8, None, 2.0)], "place long, lat double, lon double")
    got = {(r["origin"], r["destination"]): r["minutes"] for r in planning.same_points(week[2], places).collect()}
    assert got[7, 9] == got[9, 7] == got[7, 7] == 0 and got[-1, 8] == 30 and (8, 8) not in got


def test_tiers_are_replaced(spark, tmp_path):
    path = str(tmp_path / "registry")
    rows = spark.createDataFrame([(1, registry.MAP, registry.MAP_SOURCE), (2, registry.CURATED, "website")], "id long, tier string, geocode_source string")
    sinks.replace_tiers(rows, path)
    sinks.replace_tiers(spark.createDataFrame([(3, registry.MAP, registry.MAP_SOURCE)], rows.schema), path)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [2, 3]
    kept = registry.map_reload(rows.union(spark.createDataFrame([(4, registry.MAP, None)], rows.schema)), rows.limit(0))
    assert sorted(r["id"] for r in kept.collect()) == [2, 4]
