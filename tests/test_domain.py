"""Small golden cases of the operators that SQL does not cover, and of edge cases."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from rosterlake.functions import similarity, text, timeparse
from rosterlake.operators import coverage, geo_supply, matching, planning, scoring
from rosterlake.sources import html, payloads


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("raw", "key"),
    [("dr. Ani Sari, Sp.KK", "ani sari"), ("Prof. Dr. dr. Budi", "budi"), ("  drg. Cici ", "g cici"), ("Ani-Sari", "ani sari"), ("Drajat Budi", "ajat budi"), ("", "")],
)
def test_person_key(spark, raw, key):
    assert one(spark, raw, text.person_key) == key


@pytest.mark.parametrize(
    ("raw", "name"),
    [("RSUD Tebet", "tebet"), ("RS. Mitra Hospital", "mitra"), ("Rumah Sakit Ibu dan Anak Bunda", "bunda"), ("Siloam Hospitals  Kebon-Jeruk", "siloam kebon jeruk"), ("RS Café Ñandú", "café ñandú")],
)
def test_facility_name(spark, raw, name):
    assert one(spark, raw, text.facility_name) == name


@pytest.mark.parametrize(
    ("raw", "yes"),
    [
        ("Sp.KK", True), ("dr. A, Sp.DV", True), ("SpDVE", True), ("Sp. K.K. (K)", True), ("Kulit dan Kelamin", True), ("Dermatology", True), ("sp.dv(k)", True),
        ("Sp.KKLP", False), ("Sp.KJ", False), ("Sp.KFR", False), ("Sp.KL", False), ("Sp.KO", False), ("Sp.KN", False), ("Sp.KG", False), ("Sp.KKV", False), ("Sp.PK", False), ("Sp.OG", False), ("Sp.A", False), ("", False), (None, False),
    ],
)
def test_specialist(spark, raw, yes):
    assert one(spark, raw, text.is_specialist) is yes


@pytest.mark.parametrize(
    ("raw", "sessions"),
    [
        ("08.00 - 10:30", [("08:00", "10:30", "high")]), ("8:00-9:00 dan 13.00-15.00", [("08:00", "09:00", "high"), ("13:00", "15:00", "high")]), ("16:00 - selesai", [("16:00", None, "high")]),
        ("Dengan Perjanjian", [(None, None, "medium")]), ("08:00 s/d 10:00", [(None, None, "low")]), ("08:00 – 10:00", [(None, None, "low")]), ("dengan  perjanjian", [(None, None, "medium")]), ("08:00-10:00 13:00-15:00", [(None, None, "low")]), ("", [(None, None, "low")]), (None, [(None, None, "low")]), ("08:00-09:00 dan tutup", [(None, None, "low")]),
    ],
)
def test_time_ranges(spark, raw, sessions):
    assert [tuple(s) for s in one(spark, raw, timeparse.time_ranges)] == sessions


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        new = [0]
        for j, d in enumerate(b):
            new.append(row[j] + 1 if c == d else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_ratio_against_a_plain_table(spark):
    rng = random.Random(4)
    pairs = [("", ""), ("a", ""), ("", "b"), ("siloam", "siloam")] + [tuple("".join(rng.choices("abc ", k=rng.randrange(12))) for _ in "xy") for _ in range(60)]
    got = spark.createDataFrame([Row(i=i, a=a, b=b) for i, (a, b) in enumerate(pairs)]).select("i", similarity.ratio(F.col("a"), F.col("b")).alias("r")).collect()
    for r in got:
        a, b = pairs[r["i"]]
        assert r["r"] == pytest.approx(200 * lcs(a, b) / (len(a) + len(b)) if a or b else 100)


def conservative(a, b):
    sa, sb = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    return min(200 * lcs(x, y) / (len(x) + len(y)) if x or y else 100.0 for x, y in ((a, b), (sa, sb)))


def test_arrow_scores_against_a_plain_table(spark):
    rng = random.Random(5)
    pairs = [("", ""), ("a", ""), ("x" * 70 + "y", "y" + "x" * 66), ("é\U0001f600b", "b\U0001f600")] + [tuple("".join(rng.choices("abc ", k=rng.randrange(70))) for _ in "xy") for _ in range(80)]
    df = spark.createDataFrame([Row(i=i, a=a, b=b) for i, (a, b) in enumerate(pairs)])
    for r in df.select("i", similarity.many_scores(F.col("a"), F.col("b")).alias("s")).collect():
        a, b = pairs[r["i"]]
        assert r["s"] == pytest.approx(conservative(a, b)), (a, b)


def test_fuzzy_best_against_all_pairs(spark):
    rng = random.Random(6)
    base = ["mitra keluarga", "siloam asri", "hermina depok", "emc", "ab", "a", "pondok indah raya", "eka bsd"]

    def edited(t):
        t = list(t)
        for _ in range(rng.randrange(4)):
            t.insert(rng.randrange(len(t) + 1), rng.choice("abe "))
            if rng.random() < 0.6:
                t.pop(rng.randrange(len(t)))
        return " ".join("".join(t).split())

    places = [(i, edited(rng.choice(base)), rng.choice([None, "g", "h"])) for i in range(150)]
    asked = [(i, edited(rng.choice(base)), rng.choice([None, "g", "h"])) for i in range(120)] + [(500, "", None), (501, None, "g")]
    got = matching.fuzzy_best(spark.createDataFrame(asked, "key long, raw string, grp string"), spark.createDataFrame(places, "id long, name string, grp string")).collect()
    assert len(got) == len(asked)
    for r in got:
        best = (0, 0)
        if r["raw"]:
            best = max(((conservative(r["raw"], n), -i) for i, n, g in places if n and (r["grp"] is None or r["grp"] == g)), default=(0, 0))
        want = (-best[1], round(best[0], 4)) if best[0] >= 80 else (None, None)
        assert (r["id"], r["score"]) == (want[0], pytest.approx(want[1]) if want[1] else None), r


def test_fuzzy_join_has_no_nested_loop(spark):
    df = matching.fuzzy_best(spark.createDataFrame([(1, "x y", None)], "key long, raw string, grp string"), spark.range(5).selectExpr("id", "concat('n', id) AS name", "if(id > 1, 'g', 'h') AS grp"))
    assert "NestedLoop" not in df._jdf.queryExecution().toString() and "Cartesian" not in df._jdf.queryExecution().toString()


def test_rounding_and_strict_times(spark):
    from rosterlake.functions.rounding import rounded

    xs = [0.125, 0.375, 2.5, -0.125, 1 / 3, None]
    got = [r["y"] for r in spark.createDataFrame([Row(i=i, x=x) for i, x in enumerate(xs)]).orderBy("i").select(rounded(F.col("x"), 2).alias("y")).collect()]
    assert got == [None if x is None else round(x, 2) for x in xs]
    assert one(spark, "08:30", timeparse.strict_minutes) == 510
    for bad in ("24:00", "8.30", "", None, "12:60"):
        with pytest.raises(Exception, match="no time of day"):
            one(spark, bad, timeparse.strict_minutes)
    assert one(spark, "RS Mitra (Bekasi) 2", text.slug) == "rs-mitra-bekasi-2"


def test_display_alias_and_group_override(spark):
    f = spark.createDataFrame([(1, "RS A", -6.2, 106.8, "g"), (2, "RS B", -6.3, 106.8, None), (3, "RS B", -6.3, 106.8, None)], "id long, name string, lat double, lon double, grp string")
    rows = [(2, "RS A", -6.2001, 106.8, "last"), (1, "RS A", -6.2, 106.8, "zz before"), (3, "RS B", -6.3, 106.8, "two rows"), (4, "RS C", 0.0, 0.0, "none"), (5, "RS A", -6.2, 106.9, "elsewhere")]
    a = spark.createDataFrame(rows, "position int, name string, lat double, lon double, alias string")
    # the last alias of a facility holds; of several facilities of a name at a place the smallest id has it
    assert {r["id"]: r["display_alias"] for r in matching.display_alias(f, a).collect()} == {1: "last", 2: "two rows", 3: None}
    o = spark.createDataFrame([("rsud a", "new")], "name string, grp string")
    assert {r["id"]: r["grp"] for r in matching.group_override(f, o).collect()} == {1: "new", 2: None, 3: None}


def sessions(spark, *rows):
    return spark.createDataFrame(list(rows), "facility long, practitioner long, day int, start_min int, end_min int, confidence string")


@pytest.mark.parametrize(
    ("start", "end", "slots"),
    [(420, 480, [0, 1]), (855, 885, [14]), (400, 450, [0]), (1250, None, [27]), (1300, 1400, []), (600, 600, []), (600, None, [6])],
)
def test_cells(spark, start, end, slots):
    got = coverage.cells(sessions(spark, (1, 2, 3, start, end, "high"))).collect()
    assert sorted(r["slot"] for r in got) == slots


def test_usable_and_empty(spark):
    rows = sessions(spark, (1, 2, None, 480, 500, "high"), (1, 2, 1, None, 500, "high"), (1, 2, 1, 480, 500, "low"))
    assert coverage.supply(rows).count() == 0
    assert coverage.completeness(rows, spark.createDataFrame([(1, 2)], "facility long, practitioner long")).first()["completeness"] == 0.0


def test_percentile_ties(spark):
    got = scoring.percentile(spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,)], "v double"), "v", "p").collect()
    assert {r["v"]: r["p"] for r in got} == {1.0: 0.25, 2.0: 0.75, 3.0: 1.0}


def test_weights_add_up():
    with pytest.raises(ValueError):
        scoring.Weights(count=0.5)


def test_radius_join_against_all_pairs(spark):
    rng = random.Random(1)
    pts = [(i, rng.uniform(-89, 89) if i % 3 else rng.uniform(-7, -6), rng.uniform(100, 108)) for i in range(150)]
    df = spark.createDataFrame(pts, "id long, lat double, lon double")
    got = {(r["anchor"], r["id"]) for r in geo_supply.radius_join(df, df, 60.0).collect()}
    import math

    def km(a, b):
        x = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371 * math.asin(min(1, math.sqrt(x)))

    assert got == {(a[0], b[0]) for a in pts for b in pts if a[0] != b[0] and km(a, b) <= 60}
    # across 180 degrees, near a pole, and 1.4 km apart at 60 degrees north
    pts = [(0, 10.0, 179.9), (1, 10.0, -179.9), (2, 89.9, 0.0), (3, 89.9, 170.0), (4, 60.0, 20.0), (5, 60.0, 20.025), (6, -90.0, 5.0), (7, -89.9, -100.0)]
    pts += [(10 + i, rng.uniform(60, 90), rng.uniform(-180, 180)) for i in range(120)]
    df = spark.createDataFrame(pts, "id long, lat double, lon double")
    for most in (1.5, 60.0, 400.0):
        got = [(r["anchor"], r["id"]) for r in geo_supply.radius_join(df, df, most).collect()]
        assert sorted(got) == sorted((a[0], b[0]) for a in pts for b in pts if a[0] != b[0] and km(a, b) <= most)


def test_neighbourhood_golden(spark):
    """Five neighbours, four known, three with practitioners, one zero, three distinct people, 17 hours."""
    pairs = spark.createDataFrame([(0, i, 1.0) for i in range(1, 6)], "anchor long, id long, distance double")
    m = spark.createDataFrame([(1, "has_doctors", 8.0), (2, "has_doctors", 6.0), (3, "has_doctors", 3.0), (4, "confirmed_zero", 0.0), (5, "unknown", None)], "facility long, status string, weekly_hours double")
    people = spark.createDataFrame([(1, 1, "a"), (2, 2, "a"), (2, 3, "b"), (3, 4, None), (5, 5, "z")], "facility long, practitioner long, person string")
    r = geo_supply.neighbourhood(pairs, m, people).first()
    assert (r["total"], r["known"], r["unknown"], r["has"], r["zero"], r["people"], r["hours"], r["ratio"], r["quality"]) == (5, 4, 1, 3, 1, 3, 17.0, 0.8, "high")


def test_greedy_dedup_against_one_pass(spark):
    rng = random.Random(3)
    names = ["mitra keluarga", "mitra keluarga a", "mitra kelapa", "siloam", "siloam b", "hermina", "hermina x", "hermina xyz"]
    rows = [(i, rng.choice(names), (-6.2 + rng.random() / 50) if rng.random() > 0.2 else None, 106.8) for i in range(30)]
    import math

    def score(a, b):
        sa, sb = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
        return min(200 * lcs(a, b) / (len(a) + len(b)), 200 * lcs(sa, sb) / (len(sa) + len(sb)))

    def near(a, b):
        if a[2] is None or b[2] is None:
            return True
        x = math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371 * math.asin(math.sqrt(x)) <= 1.5

    kept, want = [], {}
    for r in rows:
        best = max(((score(r[1], k[1]), -k[0]) for k in kept if near(r, k)), default=(0, 0))
        if best[0] >= 85:
            want[r[0]] = -best[1]
        else:
            kept.append(r)
            want[r[0]] = r[0]
    df = spark.createDataFrame(rows, "ordinal long, name string, lat double, lon double")
    assert {r["ordinal"]: r["into"] for r in matching.greedy_dedup(df).collect()} == want


def test_greedy_dedup_of_a_long_chain(spark):
    # 1.1 km apart, alike: hop i meets i-1 and i+1 only; the order of input is zigzag along the chain
    n = 80
    rows = [((i * 7) % n, "mitra keluarga", -6.8 + i / 100, 106.8) for i in range(n)]
    at = {o: i for i, (o, *_) in enumerate(rows)}
    kept, want = set(), {}
    for o in sorted(at):
        beside = [p for p in kept if abs(at[p] - at[o]) == 1]
        want[o] = min(beside, default=o)
        if not beside:
            kept.add(o)
    got = matching.greedy_dedup(spark.createDataFrame(rows, "ordinal long, name string, lat double, lon double")).collect()
    assert len(got) == n and {r["ordinal"]: r["into"] for r in got} == want


def test_curated_errors(spark):
    row = lambda name, lat: (name, *["x"] * 5, lat, 106.8, *["x"] * 6, None)
    ok = spark.createDataFrame([row("A", -6.2), row("B", -6.2)], payloads.CURATED)
    assert payloads.curated(ok).count() == 2
    for bad in ([row("A", -6.2), row("a", -6.2)], [row("", -6.2)], [row("A", 6.2)], [row("A", None)]):
        with pytest.raises(Exception, match="name|point|region"):
            payloads.curated(spark.createDataFrame(bad, payloads.CURATED)).collect()
    assert payloads.curated(payloads.empty_registry(spark)).count() == 0


def test_latest_snapshot(spark):
    files = spark.createDataFrame([("/raw/eka/2026-01-02/a.html",), ("/raw/eka/2026-03-01/a.html",), ("/raw/eka/notes/a.html",)], "path string")
    assert [r["path"] for r in payloads.latest_snapshot(files).collect()] == ["/raw/eka/2026-03-01/a.html"]
    assert payloads.latest_snapshot(files.filter("false")).count() == 0


def test_html_items():
    page = "<title>T &amp; U</title><script>var a='<a href=x>'</script><div class='card big' id=c1>dr. A<br><a href='/d?x=1'>more</a></div><table><tr><th data-label=Senin>08:00</th></table><select><option value=s>S</option></select>"
    got = html.items(page, card="card")
    assert ("title", 0, "", "T & U") in got and ("card", 1, "c1", "dr. Amore") in got and ("a", 2, "/d?x=1", "more") in got and ("th", 3, "Senin", "08:00") in got and ("option", 4, "s", "S") in got
    assert html.items(None) == [] and html.items("") == []


def test_plan_limits(spark):
    many = spark.range(17).select(F.col("id").alias("slot"), F.lit(False).alias("locked"))
    with pytest.raises(ValueError):
        planning.masks(many, 3)
    some = spark.range(5).select(F.col("id").alias("slot"), (F.col("id") == 1).alias("locked"))
    assert sorted(r["mask"] for r in planning.masks(some, 2).collect()) == [3, 6, 10, 18]


def test_missing_leg_drops_the_plan(spark):
    s = spark.createDataFrame([(0, 7, 0, 600, 700, False, 5)], "slot long, facility long, day int, start int, end int, locked boolean, priority int")
    plans = spark.createDataFrame([(1,)], "mask long")
    there = [(-1, 7, 30), (7, -1, 30)]
    travel = spark.createDataFrame(there, "origin long, destination long, minutes int")
    assert planning.commute(plans, s, travel, planning.Limits()).first()["minutes"] == 60
    assert planning.commute(plans, s, travel.limit(1), planning.Limits()).count() == 0
