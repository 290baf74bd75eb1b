"""Every registered domain query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

from rosterlake.plans.catalogue import ORACLES, QUERIES

from . import test_domain, test_queries
from .conftest import DATA

#: Queries that SQL cannot express, with the test that holds them against brute force.
BRUTE = {
    "d07_fuzzy_match": test_queries.test_d07_fuzzy_match, "d08_cascade": test_queries.test_d08_cascade, "e18_load_summary": test_queries.test_e18_load_summary,
    "d09_greedy_dedup": test_domain.test_greedy_dedup_against_one_pass,
    "j06_html_items": test_queries.test_j06_html_items, "m13_legend": test_queries.test_m13_legend,
}


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return str([plain(x) for x in v]) if isinstance(v, list | tuple) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    if name not in ORACLES:
        assert callable(BRUTE[name])
        return
    said = duck.execute(ORACLES[name])
    names = [d[0] for d in said.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in said.fetchall())


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
