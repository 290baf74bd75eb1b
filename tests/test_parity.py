"""Rules held against plain Python: rounding, arrays under a key, like names, travel by time, pages and loads."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from rosterlake.functions.rounding import rounded
from rosterlake.functions.text import array_under, array_under_in_blocks
from rosterlake.operators import matching, planning
from rosterlake.plans import ingest
from rosterlake.sources import adapters

from .test_domain import conservative
from .test_ingest import COLUMBIA, COLUMBIA_DETAIL, RADJAK, frame, payload


@pytest.mark.parametrize("places", [0, 2, 4])
def test_rounding_is_that_of_python(spark, places):
    r = random.Random(places)
    xs = [i / 1000 + 0.005 for i in range(0, 4000, 10)] + [r.uniform(-1000, 1000) for _ in range(5000)] + [-2.675, 1.115, 0.5, 1.5, 2.5, -0.5, 1e17, 2.0**52 + 1]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", rounded(F.col("x"), places).alias("y")).collect()
    assert [r["y"] for r in rows] == [round(r["x"], places) for r in rows]
    odd = spark.sql("SELECT CAST(NULL AS DOUBLE) AS x UNION ALL SELECT double('NaN') UNION ALL SELECT double('-inf')").select(rounded(F.col("x"), 2).cast("string").alias("y"))
    assert [r["y"] for r in odd.collect()] == [None, "NaN", "-Infinity"]


def first_list(x, key):
    """The rule, written as it reads."""
    if isinstance(x, dict) and isinstance(x.get(key), list):
        return x[key]
    inner = x.values() if isinstance(x, dict) else x if isinstance(x, list) else ()
    return next((got for v in inner if (got := first_list(v, key)) is not None), None)


def test_array_under_a_key(spark):
    r = random.Random(3)

    def some(depth):
        kind = r.randrange(5) if depth else 4
        if kind < 2:
            return {k: some(depth - 1) for k in r.sample(["k", "a", "b", "c"], r.randrange(5))}
        return [some(depth - 1) for _ in range(r.randrange(4))] if kind < 4 else r.choice([1, None, "k", "é\"", True, [], {}])

    docs = [some(6) for _ in range(400)]
    texts = [json.dumps(d, ensure_ascii=i % 2 == 0) for i, d in enumerate(docs)]
    df = spark.createDataFrame([(i, t, texts[i - 2 : i]) for i, t in enumerate(texts)], "i int, t string, b array<string>")
    got = df.select("i", array_under(F.col("t"), "k").alias("x"), array_under_in_blocks(F.concat(F.array(F.lit("{broken")), "b"), "k").alias("y")).collect()
    assert len({r["x"] for r in got}) > 20
    for row in got:
        i = row["i"]
        want = [first_list(docs[i], "k"), next((w for d in (docs[i - 2 : i]) if (w := first_list(d, "k")) is not None), None)]
        assert [None if v is None else json.loads(v) for v in (row["x"], row["y"])] == want
    odd = ["", None, "{", "[" * 100_000, '{"k":["\\ud800"]}', "3"]
    assert [r["x"] for r in spark.createDataFrame([(t,) for t in odd], "t string").select(array_under(F.col("t"), "k").alias("x")).collect()] == [None, None, None, None, '["\\ud800"]', None]


@pytest.mark.parametrize("threshold", [50.0, 70.0, 80.0, 100.0])
def test_similar_names_against_all_pairs(spark, threshold):
    r = random.Random(int(threshold))
    name = lambda: "".join(r.choice("aab c") for _ in range(r.randrange(0, 12)))
    left, right = ({(r.choice("xy"), name()) for _ in range(60)} | {("x", "abc " * 25), ("y", "abc " * 24)} for _ in range(2))
    frames = [spark.createDataFrame([*side, *list(side)[:5]], "scope string, n string") for side in (left, right)]
    got = {(g["scope"], g["n"], g["other"]): g["score"] for g in matching.similar_names(*frames, threshold).collect()}
    want = {(s, n, m): conservative(n, m) for s, n in left for z, m in right if s == z and n and m and conservative(n, m) >= threshold}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert matching.similar_names(frames[0].limit(0), frames[1], threshold).count() == 0


def test_names_without_any_group(spark):
    """A constant null group on both sides, over tables that Spark does not fold."""
    names = spark.range(9).select(F.col("id").alias("key"), F.concat(F.lit("place "), "id").alias("raw"), F.lit(None).cast("string").alias("grp"))
    places = spark.range(5).select("id", F.concat(F.lit("Place "), "id", F.lit("x")).alias("name"), F.lit(None).cast("string").alias("grp"))
    assert {r["key"]: r["id"] for r in matching.fuzzy_best(names, places).collect()} == {k: k if k < 5 else 0 for k in range(9)}
    with pytest.raises(ValueError):
        matching.fuzzy_best(names, places, 0)


def test_travel_in_force(spark):
    rows = [(1, 2, 10, None, None, None), (1, 2, 20, None, 480, True), (1, 2, 30, 0, 540, None), (1, 2, 40, 0, 600, False), (2, 1, 5, 3, 0, None)]
    travel = spark.createDataFrame(rows, "origin long, destination long, minutes int, day int, minute int, arrive_by boolean")

    def told(origin, destination, day, at, arrive_by):
        fits = [t for t in rows if t[:2] == (origin, destination) and t[5] in (None, arrive_by) and (t[4] or 0) <= at]
        own, any_ = [t for t in fits if t[3] == day], [t for t in fits if t[3] is None]
        return max(own or any_, key=lambda t: t[4] or 0, default=(None,) * 6)[2]

    legs = [(o, d, day, at, by) for o, d in ((1, 2), (2, 1), (2, 3)) for day in (0, 3) for at in (0, 479, 480, 540, 599, 600, 1439) for by in (True, False)]
    got = planning.timed(spark.createDataFrame(legs, "origin long, destination long, day int, at int, arrive_by boolean"), travel).collect()
    assert len(got) == len(legs)
    assert all((r["told"] and r["told"]["minutes"]) == told(r["origin"], r["destination"], r["day"], r["at"], r["arrive_by"]) for r in got)


def test_a_slower_morning_makes_a_plan_late(spark):
    """The same way costs more before nine: the leg is asked for at its time of arrival, the way back at its departure."""
    sessions = spark.createDataFrame([(0, 7, 0, 600, 700, True, 5)], "slot long, facility long, day int, start int, end int, locked boolean, priority int")
    schools = spark.createDataFrame([], "school long, place long, level_ok boolean, km double, first_year double, curriculum_ok boolean, days array<int>, start int, end int")
    rows = [(-1, 7, 20, None, 0, None), (-1, 7, 45, 0, 560, True), (7, -1, 20, None, 0, None), (7, -1, 33, None, 690, False), (7, -1, 99, None, 701, False)]
    travel = spark.createDataFrame(rows, "origin long, destination long, minutes int, day int, minute int, arrive_by boolean")
    limits = planning.Limits(sessions=1)
    row = planning.routed(planning.enumerate_plans(sessions, schools, limits), sessions, schools, travel, limits).first()
    assert (row["reason"], row["minutes"]) == (None, 45 + 33)


def columbia(spark, special, branch):
    page = COLUMBIA_DETAIL.replace("<strong>Dermatology</strong><strong>BSD</strong>", f"<strong>{special}</strong><strong>{branch}</strong>")
    details = spark.createDataFrame([("/doctor-appointment/m", page)], "record string, html string")
    return [(r["record"], r["day_text"]) for r in adapters.REGISTRY["columbia_asia"](frame(spark, COLUMBIA, branch="RS Columbia Asia BSD"), details).collect()]


def test_pages_of_another_branch_or_specialty_give_no_times(spark):
    """The site calls its branches RSCA BSD and RSCA Pulomas; the record of the listing stays."""
    assert sorted(columbia(spark, "Dermatology", "RSCA BSD")) == [("/doctor-appointment/m", d) for d in ("Friday", "Monday", "Monday")]
    for special, branch in (("Dermatology", "RSCA Pulomas"), ("Cardiology", "RSCA BSD"), ("Dermatology", "")):
        assert columbia(spark, special, branch) == [("/doctor-appointment/m", None)]


def test_siloam_keeps_a_doctor_without_sessions(spark):
    listing = payload(spark, {"data": [{"doctor_id": "d1", "name": "dr. A, Sp.DV"}, {"doctor_id": "d2", "name": "dr. B, Sp.DV"}]})
    near = [{"hospital_name": "Siloam Asri", "hospital_address": "Jakarta"}]
    plans = payload(spark, {"data": {"doctor": {"doctor_id": "d1"}, "availability": near, "schedule": []}}, {"data": {"availability": near, "schedule": [{"doctor_id": "d2", "day": 1, "from_time": "08:00", "to_time": "09:00"}]}})
    assert sorted((r["record"], r["day_text"]) for r in adapters.siloam(listing, plans).collect()) == [("d1", None), ("d2", "1")]


def test_times_of_pages_with_a_branch_each(spark):
    listing = '<div class="item asp_r_pagepost asp_r_pagepost_55"><div class="doctor-card-name"><a href="/s">dr. S, Sp.KK</a></div><div class="doctor-card-location">Karawang</div></div>'
    row = '<div class="schedule-day-row"><div class="schedule-day-label">{}</div><div class="schedule-day-time">{}</div></div>'
    page = f'<div class="schedule-item"><div class="schedule-hospital">Primaya Karawang</div>{row.format("Senin", "08:00 - 10:00 (BPJS)")}</div><div class="schedule-item"><div class="schedule-hospital">Primaya Depok</div></div>'
    details = spark.createDataFrame([("55", page)], "record string, html string")
    got = sorted((r["branch"], r["day_text"], r["time_text"]) for r in adapters.REGISTRY["primaya"](frame(spark, listing), details).collect())
    assert got == [("Primaya Depok", None, None), ("Primaya Karawang", "Senin", "08:00 - 10:00")]


def test_written_load_counts_what_it_writes(spark, tmp_path):
    raw = adapters.REGISTRY["radjak"](frame(spark, RADJAK))
    more = spark.createDataFrame([("radjak", "b", "dr. B, Sp.KK", "RS Nowhere At All"), ("radjak", "c", "dr. C, Sp.JP", "RS Radjak Salemba"), ("radjak", "d", "dr. D, Sp.KK", None)], "source string, record string, raw_name string, branch string")
    raw = raw.unionByName(more, allowMissingColumns=True)
    facilities = spark.createDataFrame([(5, "RS Ｒadjak Salemba", None)], "id long, name string, grp string")
    for _ in range(2):
        counts = ingest.write(raw, facilities, str(tmp_path))
    read = {n: spark.read.parquet(f"{tmp_path}/{n}") for n in ("records", "practitioners", "sessions")}
    assert counts == {"records": 4, "not_specialist": 1, "unmatched": 2, "practitioners": 1, "sessions": read["sessions"].count()}
    told = {r["record"]: (r["outcome"], r["unmatched_names"]) for r in read["records"].collect()}
    assert told == {"dr. g, sp.kk": ("loaded", []), "b": ("unmatched", ["RS Nowhere At All"]), "c": ("not specialist", []), "d": ("unmatched", ["dr. D, Sp.KK (no branch named)"])}
    assert [(r["record"], r["facility"]) for r in read["practitioners"].collect()] == [("dr. g, sp.kk", 5)]
    empty = ingest.write(raw.limit(0), facilities, str(tmp_path))
    assert set(empty.values()) == {0}
