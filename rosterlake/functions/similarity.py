"""Indel similarity of strings: as expressions, and as an Arrow function for many pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence: one row of the table is carried over a's characters."""
    # split on the empty pattern gives the characters
    x = F.when(F.length(a) > 0, F.split(a, "")).otherwise(F.array().cast("array<string>"))
    y = F.when(F.length(b) > 0, F.split(b, "")).otherwise(F.array().cast("array<string>"))

    def row(above: Column, c: Column) -> Column:
        # entry j: max(above[j], row[j-1]), or above[j-1] + 1 where the characters agree
        steps = F.zip_with(F.zip_with(above, F.slice(F.concat(F.array(F.lit(0)), above), 1, F.size(above)), lambda up, diagonal: F.struct(up.alias("up"), diagonal.alias("di"))), y, lambda p, d: F.when(c == d, p["di"] + 1).otherwise(p["up"]))
        grown = F.aggregate(steps, F.struct(F.array().cast("array<int>").alias("r"), F.lit(0).alias("last")), lambda s, v: F.struct(F.concat(s["r"], F.array(F.greatest(s["last"], v))).alias("r"), F.greatest(s["last"], v).alias("last")))
        return grown["r"]

    end = F.aggregate(x, F.array_repeat(F.lit(0), F.size(y)), row)
    return F.when(F.size(y) == 0, 0).otherwise(F.element_at(end, -1))


def ratio(a: Column, b: Column) -> Column:
    """100 times twice the common subsequence over both lengths; two empty texts are alike."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 100.0).otherwise(F.lit(200.0) * common_subsequence(a, b) / total)


def sorted_tokens(a: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(F.trim(a), r"\s+"), lambda t: t != "")), " ")


def conservative(a: Column, b: Column) -> Column:
    """The smaller of the plain ratio and the ratio of sorted tokens."""
    return F.least(ratio(a, b), ratio(sorted_tokens(a), sorted_tokens(b)))


def ceiling(a: Column, b: Column) -> Column:
    """No ratio is above this: 200 times the shorter length over both; a cheap filter before the rest."""
    return F.lit(200.0) * F.least(F.length(a), F.length(b)) / F.greatest(F.lit(1), F.length(a) + F.length(b))


def subsequences(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of pairs, by bit vectors over all pairs at once."""
    out = np.zeros(len(a), np.int64)
    long = np.array([len(y) > 63 for y in b], bool)
    for i in np.flatnonzero(long):
        out[i] = _one_subsequence(a[i], b[i])
    at = np.flatnonzero(~long)
    for lo in range(0, len(at), 8192):
        some = at[lo : lo + 8192]
        x, y = _codes([a[i] for i in some], 1), _codes([b[i] for i in some], 2)
        place = np.uint64(1) << np.arange(y.shape[1], dtype=np.uint64)
        v = np.full(len(some), ~np.uint64(0))
        for j in range(x.shape[1]):
            u = v & np.where(y == x[:, j, None], place, np.uint64(0)).sum(1, dtype=np.uint64)
            v = (v + u) | (v - u)
        width = np.fromiter((len(b[i]) for i in some), np.uint64, len(some))
        out[some] = np.bitwise_count(~v & ((np.uint64(1) << width) - np.uint64(1)))
    return out


def _codes(some: list[str], fill: int) -> np.ndarray:
    """Characters as numbers, a row each; what is behind the end equals no character of the other side."""
    width = max(map(len, some), default=0)
    raw = np.frombuffer("".join(t.ljust(width, chr(fill)) for t in some).encode("utf-32-le", "surrogatepass"), np.uint32)
    return raw.reshape(len(some), width)


def _one_subsequence(a: str, b: str) -> int:
    masks: dict[str, int] = {}
    for j, c in enumerate(b):
        masks[c] = masks.get(c, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for c in a:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(b) - v.bit_count()


def _of_pairs(x: pd.Series, y: pd.Series) -> np.ndarray:
    total = x.str.len().to_numpy() + y.str.len().to_numpy()
    return np.where(total == 0, 100.0, 200.0 * subsequences(x.tolist(), y.tolist()) / np.maximum(1, total))


@F.pandas_udf(DoubleType())
def many_ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    """ratio(a, b) of strings that are not null, an Arrow batch at a time."""
    return pd.Series(_of_pairs(a, b))


@F.pandas_udf(DoubleType())
def scores(a: pd.Series, b: pd.Series, sorted_a: pd.Series, sorted_b: pd.Series) -> pd.Series:
    """many_scores of strings whose sorted tokens are given."""
    return pd.Series(np.minimum(_of_pairs(a, b), _of_pairs(sorted_a, sorted_b)))


def many_scores(a: Column, b: Column) -> Column:
    """conservative(a, b) of strings that are not null, an Arrow batch at a time."""
    return scores(a, b, sorted_tokens(a), sorted_tokens(b))
