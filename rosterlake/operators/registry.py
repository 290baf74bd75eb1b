"""The facility registry: map and curated rows in one table, with the corrections that people entered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.functions.text import address, facility_name
from rosterlake.operators.matching import display_alias, group_match, group_override, ownership, resolve_overrides

MAP, CURATED = "official", "manual"
MAP_SOURCE = "osm_overpass"
COLUMNS = ("id", "name", "name_key", "aliases", "grp", "ownership", "address", "city", "lat", "lon", "geocode_source", "geocode_confidence", "tier", "status", "preferred")


def map_rows(mapped: DataFrame, groups: list[str], overrides: DataFrame) -> DataFrame:
    """Registry rows of deduplicated map elements.

    mapped: id, name, kind (of operator), full, street, number, city, lat, lon, aliases (array of text, or
    null). overrides: name, grp; an override by normalised name wins over a group's name inside the name.
    A row without both coordinates has no geocode source and the status unknown.
    """
    placed = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    named = group_override(mapped.withColumn("grp", group_match(F.coalesce("name", F.lit("")), groups)), overrides)
    return named.select(
        "id", F.coalesce("name", F.lit("(unnamed)")).alias("name"), facility_name(F.coalesce("name", F.lit(""))).alias("name_key"),
        F.to_json(F.coalesce("aliases", F.array().cast("array<string>"))).alias("aliases"), "grp", ownership(F.col("kind")).alias("ownership"),
        address(F.col("full"), F.col("street"), F.col("number"), F.col("city")).alias("address"), "city", "lat", "lon",
        F.when(placed, MAP_SOURCE).alias("geocode_source"), F.when(placed, "medium").alias("geocode_confidence"), F.lit(MAP).alias("tier"),
        F.when(placed, "partial").otherwise("unknown").alias("status"), F.col("grp").isNotNull().alias("preferred"),
    )


def curated_rows(curated: DataFrame, groups: list[str]) -> DataFrame:
    """Registry rows of facilities that people entered whole: id, name, grp, ownership, address, city, lat,
    lon, geocode_source, geocode_confidence. Preferred if the group is configured, letter by letter."""
    return curated.withColumns({
        "name_key": facility_name(F.col("name")), "aliases": F.lit("[]"), "tier": F.lit(CURATED), "status": F.lit("manual"),
        "preferred": F.coalesce(F.col("grp").isin(*groups), F.lit(False)),
    }).select(*COLUMNS)


def registry(mapped: DataFrame, curated: DataFrame, groups: list[str], group_overrides: DataFrame, duplicates: DataFrame, aliases: DataFrame) -> DataFrame:
    """All rows with duplicate_of and display_alias; corrections that name no row are left out.

    duplicates: key, source and target (struct of name, lat, lon). aliases: position, name, lat, lon, alias.
    """
    rows = map_rows(mapped, groups, group_overrides).unionByName(curated_rows(curated, groups))
    same = resolve_overrides(duplicates, rows).groupBy(F.col("source_id").alias("id")).agg(F.max_by("target_id", "key").alias("duplicate_of"))
    return display_alias(rows, aliases).join(same, "id", "left")


def replaced(old: DataFrame, new: DataFrame, gone: Column) -> DataFrame:
    """old without the rows that gone holds for (null: they stay), and new."""
    return old.filter(~F.coalesce(gone, F.lit(False))).unionByName(new, allowMissingColumns=True)


def map_reload(old: DataFrame, new: DataFrame) -> DataFrame:
    """old with its map rows replaced; map rows placed by another source stay."""
    return replaced(old, new, (F.col("tier") == MAP) & (F.col("geocode_source") == MAP_SOURCE))


def curated_reload(old: DataFrame, new: DataFrame) -> DataFrame:
    """old with all its curated rows replaced."""
    return replaced(old, new, F.col("tier") == CURATED)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new, and those of old whose keys new does not have."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)
