"""Matching of many names that are all alike: results against all pairs, and work that stays near the number of matches."""

from __future__ import annotations

import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rosterlake.functions import alike
from rosterlake.operators import matching
from rosterlake.plans.catalogue import QUERIES

from .conftest import DATA
from .test_domain import conservative


def block(names, **more):
    return pd.DataFrame({"scope": "x", "n": names, "tokens": [" ".join(sorted(n.split())) for n in names], **more})


@pytest.mark.parametrize("front", [7, 1 << 18])
def test_pairs_of_long_and_odd_names(monkeypatch, front):
    """More than one word of bits, several lengths, letters of one side only, and a front cut at every step."""
    monkeypatch.setattr(alike, "FRONT", front)
    r = random.Random(8)
    name = lambda: "".join(r.choice("ab é\U0001f600") for _ in range(r.choice([1, 2, 3, 8, 9, 63, 64, 65, 129, 130]))).strip() or "z"
    asked = list({name() for _ in range(40)})
    known = list({name() for _ in range(40)} | {n + "q" for n in asked[:9]} | {n[1:] for n in asked if len(n) > 60})
    floors = [r.choice([50.0, 70.0, 95.0]) for _ in asked]
    found = alike.all_pairs(block(asked, floor=floors, whole=False), block(known))
    got = {(g.n, g.other): g.score for g in found.itertuples()}
    want = {(a, b): conservative(a, b) for a, f in zip(asked, floors) for b in known if conservative(a, b) >= f}
    assert len(got) == len(found) and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_work_near_the_matches(monkeypatch):
    """5 times the known names: the rows of the walk grow less than that, and stay far below all pairs."""
    rows = []
    grown = alike._grown
    monkeypatch.setattr(alike, "_grown", lambda v, m: rows.append(len(v)) or grown(v, m))
    seen = []
    asked = block([f"supplier {k}" for k in range(11111, 11611) if "0" not in str(k)], floor=80.0, whole=True)
    for n in (8_000, 40_000):
        rows.clear()
        alike.best_pairs(asked, block([f"supplier {k:09d}" for k in range(n)], id=range(n)))
        seen.append(sum(rows))
    assert seen[1] < 5 * seen[0] and seen[1] < len(asked) * 40_000 / 50


def test_fuzzy_best_of_many_like_names(spark):
    """10 000 places of like names: every name that lost its zeros meets the smallest place that holds it, in time.

    Pairs that met on a shared letter were a good part of all pairs; d07 over 10 000 suppliers was not done after 115 s.
    """
    n = 10_000
    places = spark.range(n).select("id", F.format_string("Supplier#%09d", "id").alias("name"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("g"), F.col("id") % 5)).alias("grp"))
    names = places.filter("id % 4 = 1").select(F.col("id").alias("key"), F.concat(F.lit("RS "), F.regexp_replace("name", "0", "")).alias("raw"), F.lit(None).cast("string").alias("grp"))
    began = time.monotonic()
    got = {r["key"]: (r["id"], r["score"]) for r in matching.fuzzy_best(names, places).collect()}
    assert time.monotonic() - began < 60
    assert len(got) == n // 4

    def holds(k, digits):
        it = iter(f"{k:09d}")
        return all(c in it for c in digits)

    for key in random.Random(2).sample(sorted(got), 60):
        digits = str(key).replace("0", "")
        if len(digits) < 3:
            assert got[key] == (None, None)
        else:
            length = 9 + len(digits)
            assert got[key] == (next(k for k in range(n) if holds(k, digits)), pytest.approx(200 * length / (length + 18), abs=1e-4))


def test_blocks_of_both_sides(spark, monkeypatch):
    """Every block of the one side meets every block of the other, once."""
    monkeypatch.setattr(matching, "ASKED_BLOCK", 7)
    monkeypatch.setattr(matching, "KNOWN_BLOCK", 5)
    side = spark.range(40).select(F.concat(F.lit("s"), F.col("id") % 2).alias("scope"), F.concat(F.lit("name "), "id").alias("n"))
    got = [(r["n"], r["other"]) for r in matching.similar_names(side, side, 50.0).collect()]
    want = {(f"name {i}", f"name {j}") for i in range(40) for j in range(40) if i % 2 == j % 2 and conservative(f"name {i}", f"name {j}") >= 50}
    assert len(got) == len(want) and set(got) == want


@pytest.fixture(scope="module")
def many_suppliers(tmp_path_factory, spark):
    """20 000 suppliers in place of the smallest table's; nations as they are."""
    folder = tmp_path_factory.mktemp("many")
    k = F.col("s_suppkey")
    spark.range(20_000).select(F.col("id").alias("s_suppkey")).select(k, F.format_string("Supplier#%09d", k).alias("s_name"), (k * 7 % 25).cast("int").alias("s_nationkey"), F.lit(1.0).alias("s_acctbal")).write.parquet(f"{folder}/supplier.parquet")
    spark.read.parquet(f"{DATA}/nation.parquet").write.parquet(f"{folder}/nation.parquet")
    return str(folder)


def short(k):
    return "RS Supplier#" + str(k).replace("0", "")


def test_load_summary_of_many_like_names(spark, many_suppliers):
    began = time.monotonic()
    got = {r["source"]: (r["total"], r["unmatched"], r["unmatched_names"]) for r in QUERIES["e18_load_summary"](spark, many_suppliers).collect()}
    assert time.monotonic() - began < 60
    for source in range(3):
        # of names without zeros those with less than three digits stay below the threshold
        open_ = {k: short(k) if k % 4 == 1 else "Quite Another Place" for k in range(source, 20_000, 3) if k % 4 == 3 or (k % 4 == 1 and len(str(k).replace("0", "")) < 3)}
        assert got[f"s{source}"] == (len(range(source, 20_000, 3)), len(open_), "|".join(sorted(set(open_.values()))))


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("[s_suppkey#")


def test_load_summary_reads_its_names_once(spark):
    """The plan of the walks held the whole way of both sides again and again: 59 scans of the suppliers."""
    assert scans(QUERIES["e18_load_summary"](spark, DATA)) <= 4


def test_cascade_of_many_like_names(spark, many_suppliers):
    began = time.monotonic()
    got = {r["key"]: (r["id"], r["how"]) for r in QUERIES["d08_cascade"](spark, many_suppliers).collect()}
    assert time.monotonic() - began < 60
    assert len(got) == 20_000
    aliased = {short(k) for k in range(1, 20_000, 8)}
    for k, found in got.items():
        if k % 4 == 3:
            assert found == (5, "point alias")
        elif k % 4 == 1 and short(k) in aliased:
            assert found == (9, "name alias")
        elif k % 4 == 1 and len(str(k).replace("0", "")) < 3:
            assert found == (None, "none")
        elif k % 4 == 1:
            assert found[0] <= k and found[1] == "fuzzy"
        else:
            assert found == (k, "fuzzy")


def test_cascade_reads_its_names_once(spark):
    """Settled and open names held the aliases' joins each time they were read: 197 scans of the suppliers."""
    assert scans(QUERIES["d08_cascade"](spark, DATA)) <= 4


def greedy_in_order(rows, near):
    """(ordinal, kept, review) by one pass in input order; rows: ordinal, name, lat."""
    kept, want = [], {}
    for r in rows:
        score, minus = max(((conservative(r[1], k[1]), -k[0]) for k in kept if near(r, k)), default=(0, 0))
        want[r[0]] = (-minus, None) if score >= 85 else (r[0], -minus if score >= 70 else None)
        if score < 85:
            kept.append(r)
    return want


@pytest.mark.parametrize("off_map", [0.0, 0.2])
def test_greedy_batches_against_one_pass(spark, monkeypatch, off_map):
    """Many batches, a crowd within reach of each other, merges and review notes."""
    monkeypatch.setattr(matching, "BATCH", 7)
    r = random.Random(12)
    rows = [(i * 3, f"place {r.randrange(400):03d} {r.choice('ab')}", r.choice([-6.2, -6.21, -6.23]) if r.random() >= off_map else None) for i in range(120)]
    # 0.01 degrees are 1.1 km, 0.02 are 2.2 km
    want = greedy_in_order(rows, lambda x, y: x[2] is None or y[2] is None or abs(x[2] - y[2]) < 0.0134)
    df = spark.createDataFrame([(o, n, lat, None if lat is None else 106.8) for o, n, lat in rows] + [(999, "", -6.2, 106.8), (1000, None, None, None)], "ordinal long, name string, lat double, lon double").repartition(5)
    got = {x["ordinal"]: (x["into"], x["review"]) for x in matching.greedy_dedup(df).collect()}
    assert got == want | {999: (999, None), 1000: (1000, None)}
    assert sum(o != into for o, (into, _) in want.items()) > 20 and sum(review is not None for _, review in want.values()) > 20


def test_greedy_meets_kept_ones_only(spark, monkeypatch):
    """1 200 copies at one place: the pairs that are scored stay far below all 719 400."""
    monkeypatch.setattr(matching, "BATCH", 50)
    seen = []
    pairs = matching.candidate_pairs
    monkeypatch.setattr(matching, "candidate_pairs", lambda *a: seen.append(pairs(*a)) or seen[-1])
    df = spark.range(1200).select(F.col("id").alias("ordinal"), F.lit("mitra keluarga").alias("name"), F.lit(-6.2).alias("lat"), F.lit(106.8).alias("lon"))
    assert {(x["into"], x["review"]) for x in matching.greedy_dedup(df).collect()} == {(0, None)}
    assert sum(p.count() for p in seen) < 5 * 1200
