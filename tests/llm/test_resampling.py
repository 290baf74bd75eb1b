"""Importance resampling against plain Python, and the exact selection against sorting."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from rosterlake.llm import target_resampling as tr

from ..conftest import DATA
from ..test_oracles import plain


def features(text, n, buckets):
    w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return len(w), [zlib.crc32(b" ".join(w[i : i + k])) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def brute(rows, target, percent, seed, n, buckets, least):
    own = [features(t, n, buckets) for _, t in rows]
    s, t = Counter(x for _, f in own for x in f), Counter(x for text in target for x in features(text, n, buckets)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    out = []
    for (d, _), (words, f) in zip(rows, own, strict=True):
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        w = sum(gain[x] for x in f)
        out.append([d, words, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = i + 1
    return sorted(map(tuple, out), key=str)


TEXTS = [None, "", "...", "a", "A b, a-B", "Ünï cødé 123", "word " * 5000, "x" * 4000, "same text of some words", "same text of some words", "a b c d e f g", "tab\tand\nline"]


@pytest.mark.parametrize(("n", "buckets", "percent", "least"), [(1, 10_000, 50, 1), (2, 50, 30, 0), (3, 7, 100, 3), (1, 10, 0, 0)])
def test_against_plain_python(spark, n, buckets, percent, least):
    rows = [(i % 9 if i != 4 else None, t) for i, t in enumerate(TEXTS * 3)]
    docs = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id long, text string, score string").repartition(3)
    target = spark.createDataFrame([("a b c",), (None,), ("Some other text",)], "text string")
    got = tr.resample(docs, target, percent, 5, n, buckets, least).collect()
    want = brute(rows, ["a b c", None, "Some other text"], percent, 5, n, buckets, least)
    # rows of one id and score may change places only among themselves
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted((w[:5] for w in want), key=str)
    assert sorted((r["score"], r["rank"]) for r in got if r["rank"]) == sorted((w[4], w[5]) for w in want if w[5])


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("few", [0, 5, 10_000])
def test_cutoff_is_the_kth_key(spark, seed, few):
    rng = random.Random(seed)
    keys = [(rng.choice([rng.randint(-20, 20), -5]), 0, rng.randint(0, 50), i) for i in range(400)]
    # dealt unevenly: one partition, or by score with a third of all rows in one
    frame = spark.createDataFrame(sorted(keys), "down long, nulled int, doc_id long, row long")
    frame = frame.repartition(7, "down") if seed else frame.coalesce(1)
    for k in (1, 2, 199, 200, 201, 399, 400):
        assert tr.cutoff(frame, k, few) == sorted(keys)[k - 1]
    assert tr.cutoff(frame, 0) is None
    with pytest.raises(ValueError):
        tr.cutoff(frame, 401)


def test_every_count_discards_a_quarter():
    rng = random.Random(3)
    for _ in range(200):
        parts = [sorted((rng.randint(0, 99), 0, 0, i * 1000 + j) for j in range(rng.choice([1, 2, 50]))) for i in range(rng.randint(1, 9))]
        pivot = tr._middle([(p[(len(p) - 1) // 2], len(p)) for p in parts])
        every = [k for p in parts for k in p]
        assert sum(k <= pivot for k in every) * 4 >= len(every) - 4 and sum(k >= pivot for k in every) * 4 >= len(every) - 4


def test_query_against_sql(spark, duck):
    df = tr.op11_target_resampling(spark, DATA)
    assert df.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in df.dtypes} == {"bigint"}
    said = duck.execute(tr.ORACLE)
    at = [[d[0] for d in said.description].index(c) for c in df.columns]
    assert sorted(tuple(map(plain, r)) for r in df.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in said.fetchall())


def test_edge_tables(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string, item_id long")
    none.write.parquet(f"{tmp_path}/documents.parquet")
    none.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert tr.op11_target_resampling(spark, str(tmp_path)).count() == 0
