"""Shard and slot of every row by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0 to n-1 in ascending order of (doc_id, text checksum, size). A balanced Feistel
network permutes the next power of four; a value of n or more is sent through again until it falls
below n, which makes a permutation of exactly the n numbers. Position p is shard p mod shards,
slot p div shards, so shard sizes differ by one row at most (law ``rows``) and both come from the
row number alone: position(i, n, seed) needs no table, and inverse() leads back.

Edge cases: null text has size 16 and checksum 0; null ids sort first; repeated rows get numbers of
their own; fewer rows than shards leave shards empty; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.llm._common import load, ship, stored

ROUNDS = 6


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))


def _keys(seed: int) -> list[int]:
    return [int(k) for k in np.random.default_rng(seed).integers(0, 1 << 63, ROUNDS)]


def _half_bits(n: int) -> int:
    return max(1, -(-max(1, n - 1).bit_length() // 2))


def _once(x: np.ndarray, bits: int, keys: list[int], back: bool) -> np.ndarray:
    mask, b = np.uint64((1 << bits) - 1), np.uint64(bits)
    left, right = x >> b, x & mask
    for k in reversed(keys) if back else keys:
        if back:
            left, right = right ^ (_mix(left, k) & mask), left
        else:
            left, right = right, left ^ (_mix(right, k) & mask)
    return left << b | right


def _walk(i: np.ndarray, n: int, seed: int, back: bool) -> np.ndarray:
    bits, keys = _half_bits(n), _keys(seed)
    x = _once(np.asarray(i, np.uint64), bits, keys, back)
    while (over := x >= n).any():
        x[over] = _once(x[over], bits, keys, back)
    return x.astype(np.int64)


def position(i, n: int, seed: int = 0) -> np.ndarray:
    """Where row numbers i of n land."""
    return _walk(i, n, seed, False)


def inverse(p, n: int, seed: int = 0) -> np.ndarray:
    """The row numbers at positions p."""
    return _walk(p, n, seed, True)


def numbered(rows: DataFrame, order: list) -> tuple[DataFrame, int]:
    """rows plus ``row_number`` from 0 in the given order, and their count.

    Rows are range-partitioned and sorted once and stored with their place in the partition; only
    the counts of the partitions come to the driver.
    """
    spark = rows.sparkSession
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"__id": F.monotonically_increasing_id()})
    placed = stored(placed.withColumns({"__part": F.shiftright("__id", 33).cast("int"), "__at": F.col("__id").bitwiseAND((1 << 33) - 1)}).drop("__id"), "numbered")
    counts = {r["__part"]: r["n"] for r in placed.groupBy("__part").agg(F.count("*").alias("n")).collect()}
    starts, total = [], 0
    for p in sorted(counts):
        starts.append((p, total))
        total += counts[p]
    first = spark.createDataFrame(starts, "__part int, __first long")
    return placed.join(F.broadcast(first), "__part").withColumn("row_number", F.col("__first") + F.col("__at")).drop("__part", "__at", "__first"), total


def shard(rows: DataFrame, n: int, shards: int, seed: int = 0, number: str = "row_number") -> DataFrame:
    """rows plus shard int and slot long, from their row numbers among n."""
    ship(rows.sparkSession)
    from pyspark.sql import types as T

    at = rows.columns.index(number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = position(b.column(at).to_numpy(zero_copy_only=False), n, seed)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((p % shards).astype(np.int32)), pa.array(p // shards)], [*b.schema.names, "shard", "slot"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())]))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id"), (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    lined, n = numbered(rows, [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")])
    if not n:
        lined = rows.withColumn("row_number", F.lit(0).cast("long"))
    done = shard(lined, max(1, n), 40, seed=9)
    return done.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
