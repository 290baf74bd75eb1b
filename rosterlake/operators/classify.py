"""Terciles, marker classes and legend text of map metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Metric, whether partial facilities take part, whether more is better, fixed cut points (null: terciles).
METRICS = (
    ("practitioners", True, True, (3.0, 5.0)),
    ("weekly_hours", False, True, None),
    ("coverage_ratio", False, True, None),
    ("score", False, False, None),
)


def absent(x: Column) -> Column:
    return x.isNull() | F.isnan(x)


def long_form(rows: DataFrame) -> DataFrame:
    """facility, status, quality, metric, value: a row for each metric."""
    wide = rows.select("facility", "status", "quality", *[F.col(m).cast("double").alias(m) for m, *_ in METRICS])
    return wide.unpivot(["facility", "status", "quality"], [m for m, *_ in METRICS], "metric", "value")


def _takes_part(partial: Column) -> Column:
    return ~absent(F.col("value")) & ~F.col("quality").isin("unknown", "confirmed_zero") & ((F.col("quality") != "partial") | partial)


def scales(values: DataFrame) -> DataFrame:
    """metric, n, least, most, lower and upper third (linear interpolation), fixed ones where given."""
    allow = F.col("metric").isin(*[m for m, p, *_ in METRICS if p])
    good = values.filter(_takes_part(allow))
    s = good.groupBy("metric").agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"), F.percentile("value", [1 / 3, 2 / 3]).alias("p"))
    lower, upper, least, most = F.get("p", 0), F.get("p", 1), F.col("least"), F.col("most")
    for m, _, _, fixed in METRICS:
        if fixed:
            mine = F.col("metric") == m
            lower, upper = F.when(mine, fixed[0]).otherwise(lower), F.when(mine, fixed[1]).otherwise(upper)
            least, most = F.when(mine, 0.0).otherwise(least), F.when(mine, 999.0).otherwise(most)
    return s.select("metric", "n", least.alias("least"), most.alias("most"), lower.alias("lower"), upper.alias("upper"))


def classify(values: DataFrame, scale: DataFrame) -> DataFrame:
    """facility, metric, colour: confirmed zero green; missing, unknown or barred partial gray; one
    value orange; else by thirds, turned round for metrics where more is worse."""
    allow = F.col("metric").isin(*[m for m, p, *_ in METRICS if p])
    rising = F.col("metric").isin(*[m for m, _, r, _ in METRICS if r])
    low, high = F.when(rising, "green").otherwise("red"), F.when(rising, "red").otherwise("green")
    colour = (
        F.when(F.col("quality") == "confirmed_zero", "green")
        .when(absent(F.col("value")) | (F.col("quality") == "unknown"), "gray").when((F.col("quality") == "partial") & ~allow, "gray")
        .when(F.col("most").isNull() | (F.col("most") <= F.col("least")), "orange")
        .when(F.col("value") <= F.col("lower"), low).when(F.col("value") <= F.col("upper"), "orange").otherwise(high)
    )
    return values.join(F.broadcast(scale), "metric", "left").select("facility", "metric", colour.alias("colour"))


def legend(scale: DataFrame) -> DataFrame:
    """metric, text of the three bands."""
    f = lambda c: F.format_number(c, 2)
    return scale.select("metric", F.concat(F.lit("<= "), f("lower"), F.lit(" | <= "), f("upper"), F.lit(" | above")).alias("legend"))
