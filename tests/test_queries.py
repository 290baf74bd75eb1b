"""Queries without SQL against brute force over the whole smallest tables."""

from __future__ import annotations

import pytest

from rosterlake.operators import planning
from rosterlake.plans.catalogue import QUERIES

from .conftest import DATA
from .test_domain import conservative


def plain_name(t):
    import re

    t = re.sub(r"^(rsud|rs)\b\.?\s*", "", t.lower().strip())
    return " ".join(re.sub(r"[^\w\s]", " ", re.sub(r"\bhospitals?\b", " ", t)).split())


def tables(duck):
    rows = duck.execute("SELECT s_suppkey, s_name, CASE WHEN s_nationkey % 3 <> 0 THEN n_name END FROM supplier JOIN nation ON s_nationkey = n_nationkey ORDER BY 1").fetchall()
    raw = {0: lambda n: n.upper(), 1: lambda n: "RS " + n.replace("0", ""), 2: lambda n: n + " Hospital", 3: lambda n: "Quite Another Place"}
    return rows, [(k, raw[k % 4](n), g if k % 3 else None) for k, n, g in rows]


def best(raw, grp, facilities):
    n = plain_name(raw)
    found = max(((round(conservative(n, plain_name(f)), 4), -i) for i, f, g in facilities if grp is None or g == grp), default=(0, 0))
    return (-found[1], found[0]) if found[0] >= 80 else (None, None)


def test_d07_fuzzy_match(spark, duck):
    facilities, names = tables(duck)
    got = {r["key"]: (r["id"], r["score"]) for r in QUERIES["d07_fuzzy_match"](spark, DATA).collect()}
    assert got == {k: best(raw, g, facilities) for k, raw, g in names}


def test_d08_cascade(spark, duck):
    facilities, names = tables(duck)
    got = {r["key"]: (r["id"], r["how"]) for r in QUERIES["d08_cascade"](spark, DATA).collect()}
    assert len(got) == len(names)
    aliased = {raw for k, raw, _ in names if k % 8 == 1}
    ninth = [i for i, n, _ in facilities if n == "Supplier#000000009"]
    for k, raw, g in names:
        if raw == "Quite Another Place":
            assert got[k] in ((5, "point alias"), (None, "none"))
        elif raw in aliased and ninth:
            assert got[k] == (ninth[0], "name alias")
        else:
            i = best(raw, g, facilities)[0]
            assert got[k] == (i, "none" if i is None else "fuzzy")


def test_e18_load_summary(spark, duck):
    facilities, names = tables(duck)
    want = {}
    for k, raw, g in names:
        one = want.setdefault(f"s{k % 3}", [0, 0, set()])
        one[0] += 1
        if best(raw, g, facilities)[0] is None:
            one[1] += 1
            one[2].add(raw)
    got = {r["source"]: [r["total"], r["unmatched"], set(filter(None, r["unmatched_names"].split("|")))] for r in QUERIES["e18_load_summary"](spark, DATA).collect()}
    assert got == want


def test_j06_html_items(spark, duck):
    """Links of every page, counted without a parser."""
    import re

    pages = duck.execute("SELECT html FROM pages").fetchall()
    want = sum(len(re.findall(r"<a[ >]", re.sub(r"(?s)<(script|style)\b.*?</\1>", "", re.sub(r"(?s)<!--.*?-->", "", h or "")))) for (h,) in pages)
    rows = QUERIES["j06_html_items"](spark, DATA).collect()
    assert sum(r["n"] if "n" in r.asDict() else 1 for r in rows if r["kind"] == "a") == want


def test_m13_legend(spark):
    rows = QUERIES["m13_legend"](spark, DATA).collect()
    assert rows and len({tuple(r) for r in rows}) == len(rows)


def test_limits_are_checked():
    for wrong in ({"weights": (0, 0, 0, 0, 0)}, {"sessions": 9}, {"latest": 1440}, {"mode": "walk"}, {"budget": float("inf")}, {"service": 61}):
        with pytest.raises(ValueError):
            planning.Limits(**wrong)
