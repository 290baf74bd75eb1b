"""Importance resampling towards a target distribution over hashed word runs, drawn by exact selection.

Texts become bags of features: runs of 1 to n words, hashed into buckets. The counts of all source and of all
target features give every bucket a gain, the log ratio of the smoothed shares in whole thousandths, and a text
weighs the sum of its features' gains. The gains are one array of a number per bucket (a size fixed by the
parameter, whatever the corpus), so a batch of texts is scored by indexing into it. A seeded Gumbel
number per id is added: the highest sums are a draw without replacement by weight.

How many are drawn follows from the share and from the count of texts that are long enough. The cutoff, the key
(score, id, row) of the last one drawn, is found by weighted median-of-medians selection: each
partition gives the median of its remaining keys, and the weighted median of those (by remaining sizes) is the
pivot. At least half of the remaining keys lie in partitions whose median is not above it, and half of theirs
are no greater; the same holds above. So at least a quarter of the remaining keys goes with every count, however
keys are dealt. One pass over the keys counts around a pivot and gives the medians on both sides of
it. Once no more than FEW keys remain they are looked at themselves. Only the drawn are sorted, by ranges.

Nothing but the gains, the bucket counts and one line per partition reaches the driver. Hashed features and keys
are Parquet in the shared folder.

Edge cases: null text has no features, weight 0, and cannot be drawn if least_words is over 0; ids that are null
are hashed as the empty text and come last among equal scores; repeated ids are rows of their own; rows that are
equal throughout are interchangeable; empty source or target counts as no features (all gains follow from
smoothing); an empty table gives an empty result; extra columns play no part.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.llm._common import discard, held, load, parts, ship, stored
from rosterlake.llm.sharding import numbered

#: Keys that are looked at themselves; the work only, not the result, depends on it.
FEW = 10_000
CACHE = 300_000
#: What separates words: all ASCII bytes but digits and letters; capitals become small.
_FOLD = bytes(ord(chr(b).lower()) if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


class _Buckets(dict):
    """Bucket of each feature, up to CACHE of them."""

    def __init__(self, size: int):
        super().__init__()
        self.size = size

    def __missing__(self, feature: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        got = self[feature] = zlib.crc32(feature) % self.size
        return got


def feature_buckets(text: bytes | None, n: int, bucket_of: _Buckets) -> tuple[int, np.ndarray]:
    """Number of words, and the buckets of all runs of 1 to n words."""
    words = text.translate(_FOLD).split(b" ") if text else []
    words = [w for w in words if w]
    runs = chain(words, *(map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False)) for k in range(2, n + 1)))
    return len(words), np.fromiter(map(bucket_of.__getitem__, runs), np.uint32)


def hashed(texts: DataFrame, text: str, n: int, buckets: int, key: str | None = None) -> DataFrame:
    """doc_id, n_words, features (little-endian 32-bit buckets) of each row."""
    ship(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket_of = held(("buckets", buckets), lambda: _Buckets(buckets))
        for b in chain.from_iterable(parts(w, 1) for w in batches):
            got = [feature_buckets(t, n, bucket_of) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array([w for w, _ in got], pa.int64()), pa.array([f.astype("<u4").tobytes() for _, f in got], pa.binary())], ["doc_id", "n_words", "features"])

    ids = F.col(key).cast("long") if key else F.lit(None).cast("long")
    return texts.select(ids.alias("doc_id"), F.col(text).cast("string").alias("t")).mapInArrow(run, "doc_id long, n_words long, features binary")


def bucket_counts(features: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket stands in all rows: one array a task, added up in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            flat = np.frombuffer(b"".join(x for x in b.column(0).to_pylist() if x), "<u4")
            total += np.bincount(flat, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in features.select("features").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(share in the target / share in the source)) of each bucket, shares smoothed by one."""
    size, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + size) / ((s + 1.0) * (t_all + size)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(features: DataFrame, gains: np.ndarray) -> DataFrame:
    """features plus n_features and weight; gains is an array of fixed size that every task gets."""
    sent = features.sparkSession.sparkContext.broadcast(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = [np.frombuffer(x or b"", "<u4") for x in b.column(2).to_pylist()]
            weight = [int(sent.value[f].sum()) for f in flat]
            yield pa.record_batch([b.column(0), b.column(1), pa.array([len(f) for f in flat], pa.int64()), pa.array(weight, pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    return features.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(seed: int, key: str = "doc_id"):
    """floor(-1000 ln(-ln u)); u from the first 32 bits of sha256 of seed and id."""
    said = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(said, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


KEY = ["down", "nulled", "doc_id", "row"]


def _medians(keys: DataFrame, low: tuple | None, high: tuple | None, pivot: tuple | None) -> list:
    """One line per partition about its keys between low and high (both left out): how many are not above the
    pivot and how many are, and the median of each side."""

    def within(k: np.ndarray, bound: tuple) -> np.ndarray:
        """Whether keys (columns) come before the bound."""
        less, equal = np.zeros(k.shape[1], bool), np.ones(k.shape[1], bool)
        for column, value in zip(k, bound, strict=True):
            less |= equal & (column < value)
            equal &= column == value
        return less

    def median(k: np.ndarray) -> list[int] | None:
        return k[:, np.lexsort(k[::-1])[(k.shape[1] - 1) // 2]].tolist() if k.shape[1] else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = []
        for b in batches:
            k = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns])
            if low is not None:
                k = k[:, ~within(k, low[:-1] + (low[-1] + 1,))]
            if high is not None:
                k = k[:, within(k, high)]
            if k.shape[1]:
                kept.append(k)
        k = np.concatenate(kept, 1) if kept else np.empty((4, 0), np.int64)
        upto = within(k, pivot[:-1] + (pivot[-1] + 1,)) if pivot is not None else np.zeros(k.shape[1], bool)
        sides = [k[:, upto], k[:, ~upto]]
        yield pa.record_batch([pa.array([s.shape[1]]) for s in sides] + [pa.array([median(s)], pa.list_(pa.int64())) for s in sides], ["n_upto", "n_above", "m_upto", "m_above"])

    lines = keys.select(*KEY).mapInArrow(run, "n_upto long, n_above long, m_upto array<long>, m_above array<long>")
    return lines.filter("n_upto + n_above > 0").collect()


def _middle(medians: list[tuple[tuple, int]]) -> tuple:
    """The weighted median of the partitions' medians."""
    half, so_far = sum(n for _, n in medians), 0
    for m, n in sorted(medians):
        so_far += 2 * n
        if so_far >= half:
            return m
    raise ValueError("no keys remain")


def cutoff(keys: DataFrame, k: int, few: int = FEW) -> tuple | None:
    """The k-th smallest of the distinct keys (columns KEY, none null), exactly; None if k is 0.

    low and high are the keys between which the k-th one is known to lie, skip is how many lie up to low.
    """
    if k < 1:
        return None
    low = high = pivot = None
    skip = 0
    while True:
        lines = _medians(keys, low, high, pivot)
        upto = sum(r["n_upto"] for r in lines)
        if pivot is not None and skip + upto == k:
            return pivot
        if pivot is not None and skip + upto > k:
            high, remaining, side = pivot, upto - 1, "upto"
        elif pivot is not None:
            low, skip, remaining, side = pivot, skip + upto, sum(r["n_above"] for r in lines), "above"
        else:
            remaining, side = sum(r["n_above"] for r in lines), "above"
        if skip + remaining < k:
            raise ValueError("fewer keys than are to be drawn")
        if remaining <= few:
            return _nth(keys, low, high, k - skip)
        pivot = _middle([(tuple(r[f"m_{side}"]), r[f"n_{side}"]) for r in lines if r[f"n_{side}"]])


def _nth(keys: DataFrame, low: tuple | None, high: tuple | None, n: int) -> tuple:
    """The n-th of the few keys that remain."""
    own = F.struct(*KEY)
    some = keys.select(*KEY)
    if low is not None:
        some = some.filter(own > _struct(low))
    if high is not None:
        some = some.filter(own < _struct(high))
    return sorted(tuple(r) for r in some.collect())[n - 1]


def _struct(key: tuple):
    return F.struct(*[F.lit(v).cast(t).alias(c) for v, t, c in zip(key, ("long", "int", "long", "long"), KEY, strict=True)])


def resample(docs: DataFrame, target: DataFrame, percent: int, seed: int, n: int = 1, buckets: int = 10_000, least_words: int = 20, key: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row of docs, and the rank of the drawn ones (1, 2, ...).

    Of the N rows of at least least_words words floor(percent * N / 100) are drawn, highest scores first.
    """
    if not 0 <= percent <= 100 or n < 1 or buckets < 1:
        raise ValueError("percent lies in 0 to 100; n and buckets are positive")
    features = stored(hashed(docs, text, n, buckets, key), "features")
    gains = gains_of(bucket_counts(features, buckets), bucket_counts(hashed(target, target_text, n, buckets), buckets))
    rows = weigh(features, gains).withColumn("score", F.col("weight") + gumbel(seed))
    keyed = stored(rows.withColumn("row", F.monotonically_increasing_id()), "keys")
    discard(features)
    able = keyed.filter(F.col("n_words") >= least_words).select((-F.col("score")).alias("down"), F.col("doc_id").isNull().cast("int").alias("nulled"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "row")
    last = cutoff(able, percent * able.count() // 100)
    own = F.struct((-F.col("score")).alias("down"), F.col("doc_id").isNull().cast("int").alias("nulled"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("row"))
    drawn = (F.col("n_words") >= least_words) & (own <= _struct(last)) if last is not None else F.lit(False)
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    ranked, _ = numbered(keyed.filter(drawn), [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")])
    rest = keyed.filter(~drawn).select(*columns, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*columns, (F.col("row_number") + 1).cast("long").alias("rank")).union(rest) if last is not None else rest


def op11_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = load(spark, sf_dir, "documents", spread=True), load(spark, sf_dir, "benchmark")
    return resample(docs, target, percent=10, seed=2024).select("doc_id", "n_features", "weight", "score", "rank")


ORACLE = r"""
WITH steps AS (SELECT list_reduce(list_prepend(i::BIGINT, range(1, 9)), lambda c, j: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS step, i FROM range(256) t(i)),
crc AS (SELECT list(step ORDER BY i) AS steps FROM steps),
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS f FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS f FROM benchmark),
one AS (SELECT doc_id, unnest(f) AS f FROM w),
two AS (SELECT unnest(f) AS f FROM b),
word AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM one UNION SELECT f FROM two)),
raw AS (SELECT f, list_transform(range(1, len(h) // 2 + 1), lambda i: ('0x' || substr(h, 2 * i - 1, 2))::BIGINT) AS u FROM word),
coded AS (SELECT f, xor(list_reduce(list_prepend(4294967295, u), lambda c, x: xor(c // 256, steps[xor(c % 256, x) + 1])), 4294967295) % 10000 AS bucket FROM raw, crc),
source AS (SELECT bucket, count(*) AS n FROM one JOIN coded USING (f) GROUP BY 1),
target AS (SELECT bucket, count(*) AS n FROM two JOIN coded USING (f) GROUP BY 1),
sums AS (SELECT (SELECT coalesce(sum(n), 0) FROM source)::DOUBLE AS s_all, (SELECT coalesce(sum(n), 0) FROM target)::DOUBLE AS t_all),
gain AS (SELECT source.bucket, floor(1000 * ln((coalesce(target.n, 0) + 1.0::DOUBLE) * (s_all + 10000) / ((source.n + 1.0::DOUBLE) * (t_all + 10000))))::BIGINT AS g
         FROM source LEFT JOIN target USING (bucket), sums),
heavy AS (SELECT doc_id, sum(g)::BIGINT AS weight FROM one JOIN coded USING (f) JOIN gain USING (bucket) GROUP BY 1),
scored AS (SELECT w.doc_id, len(w.f)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
                  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || w.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
           FROM w LEFT JOIN heavy ON heavy.doc_id = w.doc_id),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT s.doc_id, s.n_features, s.weight, s.score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank
FROM scored s LEFT JOIN ranked ON ranked.doc_id = s.doc_id
"""
