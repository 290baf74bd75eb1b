"""Radius joins, neighbourhood rollups, spatial audit and point lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.functions.geo import haversine_km, in_box, meet, missing, same_place
from rosterlake.functions.rounding import rounded
from rosterlake.functions.text import not_empty


def radius_join(anchors: DataFrame, places: DataFrame, km: float) -> DataFrame:
    """(anchor, id, distance) for places within km, the anchor itself excluded; an equi-join on grid cells."""
    a = anchors.filter(~missing(F.col("lat"), F.col("lon"))).select(F.col("id").alias("anchor"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"))
    b = places.filter(~missing(F.col("lat"), F.col("lon"))).select("id", "lat", "lon")
    d = haversine_km(F.col("a_lat"), F.col("a_lon"), F.col("lat"), F.col("lon"))
    return meet(a, b, "a_lat", "a_lon", "lat", "lon", km).filter(F.col("anchor") != F.col("id")).select("anchor", "id", d.alias("distance"))


def quality_bucket(ratio: Column, high: float = 0.80, medium: float = 0.50) -> Column:
    return F.when(ratio.isNull() | (ratio == 0), "unknown").when(ratio >= high, "high").when(ratio >= medium, "medium").otherwise("low")


def neighbourhood(pairs: DataFrame, measured: DataFrame, people: DataFrame) -> DataFrame:
    """Rollup by anchor over its neighbours: counts by status, distinct people, hours, share known.

    people: facility, id and person (null: counted by its own id); only of facilities that have
    practitioners. A neighbour has one row in measured.
    """
    near = pairs.join(measured.select(F.col("facility").alias("id"), "status", "weekly_hours"), "id")
    known = F.col("status").isin("has_doctors", "confirmed_zero")
    flat = near.groupBy("anchor").agg(
        F.count("*").alias("total"), F.count_if(known).alias("known"), F.count_if(~known).alias("unknown"),
        F.count_if(F.col("status") == "has_doctors").alias("has"), F.count_if(F.col("status") == "confirmed_zero").alias("zero"),
        rounded(F.sum(F.coalesce("weekly_hours", F.lit(0.0))), 2).alias("hours"),
    )
    key = F.coalesce(F.col("person"), F.concat(F.lit("doctor-id:"), F.col("practitioner").cast("string")))
    who = near.filter("status = 'has_doctors'").join(people, F.col("id") == F.col("facility")).groupBy("anchor").agg(F.countDistinct(key).alias("people"))
    ratio = rounded(F.col("known") / F.col("total"), 4)
    return flat.join(who, "anchor", "left").select("anchor", "total", "known", "unknown", "has", "zero", F.coalesce("people", F.lit(0)).alias("people"), "hours", ratio.alias("ratio"), quality_bucket(ratio).alias("quality"))


def ranked_neighbours(pairs: DataFrame) -> DataFrame:
    """anchor, rank, id, distance: nearest first."""
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("anchor").orderBy("distance", "id")))


def nearest(points: DataFrame, lat: float, lon: float, limit: int = 40) -> DataFrame:
    """Named points by squared coordinate difference, at most limit of them."""
    off = F.pow(F.col("lat") - lat, 2) + F.pow(F.col("lon") - lon, 2)
    named = points.filter(not_empty(F.col("name")).isNotNull() & ~missing(F.col("lat"), F.col("lon")))
    return named.withColumn("off", off).orderBy("off", "id").limit(limit)


def shared_coordinates(facilities: DataFrame) -> DataFrame:
    """lat, lon, n and sorted names where several facilities stand on one point."""
    return facilities.filter(~missing(F.col("lat"), F.col("lon"))).groupBy("lat", "lon").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("name")), "|").alias("names")).filter("n > 1")


def spatial_audit(facilities: DataFrame) -> DataFrame:
    """id, audited confidence: missing unknown, outside low, shared point medium, else kept or medium."""
    same = facilities.filter(~missing(F.col("lat"), F.col("lon"))).groupBy("lat", "lon").agg(F.count("*").alias("n"))
    gone = missing(F.col("lat"), F.col("lon"))
    joined = facilities.join(same, ["lat", "lon"], "left")
    audited = F.when(gone, "unknown").when(~in_box(F.col("lat"), F.col("lon")), "low").when(F.col("n") > 1, "medium").otherwise(F.coalesce("confidence", F.lit("medium")))
    return joined.select("id", audited.alias("confidence"))


def confidence_histogram(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.coalesce("confidence", F.lit("unknown")).alias("confidence")).agg(F.count("*").alias("n"))


def point_lookup(facilities: DataFrame, asked: DataFrame, tolerance: float) -> DataFrame:
    """asked (key, name, lat, lon) with the facility of that name at that point; none if several fit."""
    f = facilities.select("id", F.col("name").alias("f_name"), F.col("lat").alias("f_lat"), F.col("lon").alias("f_lon"))
    hit = asked.join(f, (F.col("name") == F.col("f_name")) & same_place(F.col("lat"), F.col("lon"), F.col("f_lat"), F.col("f_lon"), tolerance))
    return hit.groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("n")).filter("n = 1").select("key", "id")
