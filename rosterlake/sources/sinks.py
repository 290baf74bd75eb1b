"""Tables, reports and exports. Every write replaces its target whole, so a run can be repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_report(df: DataFrame, path: str, sample: int | None = None) -> None:
    """JSON lines; with sample, that many rows at most."""
    (df.limit(sample) if sample else df).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def replace_tiers(rows: DataFrame, path: str) -> None:
    """Registry rows into a table by tier and geocode source: the parts that rows has are replaced, others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tier", "geocode_source").parquet(path)


def merge_scores(old: DataFrame, new: DataFrame) -> DataFrame:
    """Scores by (facility, universe): new ones win, others stay."""
    keep = old.join(new.select("facility", "universe"), ["facility", "universe"], "left_anti")
    return keep.unionByName(new)


def signature(df: DataFrame, columns: list[str]) -> DataFrame:
    """df plus the sha256 of the JSON of the columns: equal inputs, equal signature."""
    return df.withColumn("signature", F.sha2(F.to_json(F.struct(*columns)), 256))
