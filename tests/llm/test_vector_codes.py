"""Product codes against numpy rounds over all vectors at once."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from rosterlake.llm import vector_codes as vc

from ..conftest import DATA
from ..test_oracles import plain


def brute(v, parts, entries, rounds):
    """(codes, errors, codebooks) of whole numbers v, in order of ids."""
    wide = -(-v.shape[1] // parts)
    v = np.pad(v, ((0, 0), (0, wide * parts - v.shape[1]))).astype(object)
    codes, errors, books = [], 0, []
    for p in range(parts):
        x = v[:, p * wide : (p + 1) * wide]
        book = [list(r) for r in x[:entries]]
        for turn in range(rounds + 1):
            far = [[sum((a - b) ** 2 for a, b in zip(r, e, strict=True)) for e in book] for r in x]
            at = [f.index(min(f)) for f in far]
            if turn < rounds:
                for e in range(len(book)):
                    own = [r for r, a in zip(x, at, strict=True) if a == e]
                    if own:
                        book[e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
        codes.append(at)
        errors = errors + np.array([min(f) for f in far], object)
        books.append(book)
    return ["".join(f"{c:02x}" for c in r) for r in zip(*codes, strict=True)], errors.tolist(), books


def sha(books):
    return hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


@pytest.mark.parametrize(("n", "d", "parts", "entries", "rounds", "scale"), [(90, 16, 8, 16, 6, 1.0), (7, 10, 4, 16, 3, 1.0), (60, 6, 3, 5, 0, 1.0), (50, 8, 8, 4, 4, 2000.0), (40, 8, 2, 3, 5, 1e7)])
def test_against_all_at_once(spark, n, d, parts, entries, rounds, scale):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, d)) * scale
    x[n // 3 : 2 * n // 3] = x[0]  # a third of all rows is one vector
    order = rng.permutation(n)
    rows = spark.createDataFrame([(int(i), [float(c) for c in x[i]], int(i % 3), "clash") for i in order], "vec_id long, embedding array<double>, label int, code string").repartition(5)
    vectors = vc.stored(vc.whole_vectors(rows), "vectors")
    books = vc.learn(vectors, parts, entries, rounds, salts=3)
    got = {r["vec_id"]: (r["code"], r["error"]) for r in vc.encode(vectors, books).collect()}
    whole = np.clip(np.floor(4096 * x), -vc.LARGEST, vc.LARGEST).astype(np.int64)
    codes, errors, want = brute(whole, parts, entries, rounds)
    assert [got[i] for i in range(n)] == list(zip(codes, errors, strict=True))
    if d % parts == 0:
        assert vc.digest(books) == {d: sha(want)}
    back = {r["vec_id"]: r["v"] for r in vc.decode(vc.encode(vectors, books), books).collect()}
    assert all(sum((int(a) - int(b)) ** 2 for a, b in zip(back[i], whole[i], strict=True)) == errors[i] for i in range(n))


def test_members_that_keep_their_entry_are_not_shuffled(spark, monkeypatch):
    """Only the movers of a round reach the shuffle to the owners."""
    sent = []
    kind = type(spark.range(1))

    def counted(self, *a, f=kind.repartition):
        if "moved" in self.columns:
            sent.append(self.count())
        return f(self, *a)

    monkeypatch.setattr(kind, "repartition", counted)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(4, 8)) * 5
    rows = [(i, [float(c) for c in centres[i % 4] + rng.normal(size=8) * 0.01]) for i in range(400)]
    vectors = vc.stored(spark.createDataFrame(rows, "vec_id long, v array<double>").selectExpr("vec_id", "transform(v, x -> int(1000 * x)) AS v"), "vectors")
    vc.learn(vectors, parts=2, entries=4, rounds=4)
    assert sent[0] == 800 and len(sent) == 4 and sent[1:] == [0, 0, 0]


def test_odd_vectors(spark, tmp_path):
    big = 3.0e38
    rows = [
        (1, [0.5, -0.25] * 4, 1), (2, None, 1), (3, [0.5, None] * 4, 1), (4, [math.nan] * 8, 2), (5, [math.inf] * 8, None), (6, [], None), (7, [], 1),
        (8, [1.0, 2.0, 3.0], None), (8, [1.0, 2.0, 3.0], None), (9, [big] * 8, 2), (None, [0.1] * 8, None), (1, [0.5, -0.25] * 4, 1),
    ]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = vc.op12_vector_codes(spark, str(tmp_path)).collect()
    assert sorted(str(r["vec_id"]) for r in got) == sorted(["1", "1", "6", "7", "8", "8", "9", "None"])
    assert all(r["error"] == 0 for r in got) and {r["label_error"] for r in got} == {0}
    assert next(r for r in got if r["vec_id"] == 6)["code"] == "00" * 8
    assert len({r["codebooks_sha256"] for r in got}) == 3
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert vc.op12_vector_codes(spark, f"{tmp_path}/none").count() == 0


def test_label_errors(spark):
    coded = spark.createDataFrame([(1, None, "00", 5, 8), (2, None, "00", 6, 8), (3, 1, "01", 7, 8), (4, 2, "01", 1, 8), (4, 2, "01", 1, 8)], "vec_id long, label int, code string, error long, d int")
    got = vc.with_label_error(coded, salts=3)
    assert got.columns == ["vec_id", "label", "code", "error", "d", "label_error"]
    assert sorted((r["vec_id"], r["label_error"]) for r in got.collect()) == [(1, 11), (2, 11), (3, 7), (4, 2), (4, 2)]


def test_query_against_sql(spark, duck):
    df = vc.op12_vector_codes(spark, DATA)
    said = duck.execute(vc.ORACLE)
    at = [[d[0] for d in said.description].index(c) for c in df.columns]
    assert sorted(tuple(map(plain, r)) for r in df.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in said.fetchall())
