"""Distances and boxes on the globe."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_KM = 6371.0
#: Fixed value: south, west, north, east of the region in scope.
REGION = (-6.80, 106.30, -5.90, 107.30)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in kilometres; null if any coordinate is."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    known = lat1.isNotNull() & lon1.isNotNull() & lat2.isNotNull() & lon2.isNotNull()
    return F.when(known, 2 * F.lit(EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a))))


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float] = REGION) -> Column:
    """Inside the box, borders included."""
    south, west, north, east = box
    return lat.between(south, north) & lon.between(west, east)


def missing(lat: Column, lon: Column) -> Column:
    return lat.isNull() | lon.isNull()


def same_place(lat1: Column, lon1: Column, lat2: Column, lon2: Column, tolerance: float) -> Column:
    """Each coordinate differs by less than the tolerance, in degrees."""
    return (F.abs(lat1 - lat2) < tolerance) & (F.abs(lon1 - lon2) < tolerance)


def meet(left: DataFrame, right: DataFrame, lat1: str, lon1: str, lat2: str, lon2: str, km: float) -> DataFrame:
    """Pairs of rows at most km apart that share a cell of a grid; each pair once.

    Rows of the grid are km high. A row's columns are at least as wide as km is a row nearer to the pole, and
    wrap at 180 degrees; near a pole a row is one column. The right side stands in each cell it could meet.
    """
    step = km / (math.pi * EARTH_KM / 180) * 1.0001

    def row(lat: str) -> Column:
        return F.floor((F.col(lat) + 90) / step)

    # columns of a row: as many as fit round the circle a row nearer to the pole
    def columns(r: Column) -> Column:
        worst = F.greatest(F.abs(r * step - 90), F.abs((r + 1) * step - 90))
        return F.greatest(F.lit(1), F.floor(F.lit(360.0) * F.cos(F.radians(F.least(worst + step, F.lit(90.0)))) / step)).cast("long")

    def column(lon: str, n: Column) -> Column:
        return F.pmod(F.floor((F.col(lon) + 180) / 360 * n), n)

    own = left.withColumn("__r", row(lat1)).withColumn("__c", column(lon1, columns(F.col("__r"))))
    wide = right.withColumn("__r", F.explode(F.sequence(row(lat2) - 1, row(lat2) + 1))).withColumn("__n", columns(F.col("__r")))
    around = F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.pmod(column(lon2, F.col("__n")) + d, F.col("__n"))))
    met = own.join(wide.withColumn("__c", F.explode(around)).drop("__n"), ["__r", "__c"]).drop("__r", "__c")
    return met.filter(haversine_km(F.col(lat1), F.col(lon1), F.col(lat2), F.col(lon2)) <= km)
