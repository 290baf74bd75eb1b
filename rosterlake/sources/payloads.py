"""Readers of cached payloads: map registry JSON, curated and override CSV, paged listings, nested schedules.

Collection itself is not part of the engine; readers take folders of files that Spark opens, so a
payload can lie in any store. All give typed rows; what cannot be read is null or an error by rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rosterlake.functions.geo import in_box, missing
from rosterlake.functions.text import not_empty

OSM_ELEMENT = "struct<type:string,id:long,lat:double,lon:double,center:struct<lat:double,lon:double>,tags:map<string,string>>"
CURATED = "name string, grp string, ownership string, hospital_type string, address string, city string, lat double, lon double, geocode_source string, geocode_confidence string, website string, source_url string, geocode_source_url string, source_note string, verified_at timestamp"
OVERRIDE = "entity_type string, entity_key string, field string, override_value string, reason string, source_note string, overridden_by string, overridden_at string"
RAW_RECORD = "source string, record string, raw_name string, credentials string, branch string, day_text string, time_text string, source_url string"


def osm_elements(payload: DataFrame, json: str = "json") -> DataFrame:
    """Rows of a map-registry response (a text column of JSON documents)."""
    e = payload.select(F.explode(F.from_json(json, f"elements array<{OSM_ELEMENT}>")["elements"]).alias("e")).select("e.*")
    tag = lambda k: not_empty(F.try_element_at("tags", F.lit(k)))
    return e.select(
        "type", "id", F.when(F.col("type") == "node", F.col("lat")).otherwise(F.col("center.lat")).alias("lat"),
        F.when(F.col("type") == "node", F.col("lon")).otherwise(F.col("center.lon")).alias("lon"), tag("name").alias("name"),
        F.coalesce(tag("website"), tag("contact:website")).alias("website"), tag("operator:type").alias("operator_type"),
        tag("addr:full").alias("full"), tag("addr:street").alias("street"), tag("addr:housenumber").alias("number"),
        F.coalesce(tag("addr:suburb"), tag("addr:village")).alias("suburb"), F.coalesce(tag("addr:city"), tag("addr:county")).alias("city"),
        F.concat_ws("/", F.lit("https://www.openstreetmap.org"), "type", F.col("id").cast("string")).alias("source_url"),
    )


def empty_registry(spark: SparkSession) -> DataFrame:
    """A source that has no rows by design."""
    return spark.createDataFrame([], CURATED)


def curated(rows: DataFrame) -> DataFrame:
    """Curated facilities; fails on a missing name, a repeated one (any case) or a point out of the region.

    rows has CURATED's columns; spark.read.csv(path, header=True, schema=CURATED, mode="FAILFAST")
    gives them.
    """
    times = rows.groupBy(F.lower("name").alias("k")).agg(F.count("*").alias("times"))
    joined = rows.join(times, F.lower("name") == F.col("k"), "left").drop("k")
    bad = (
        F.when(not_empty(F.trim("name")).isNull(), "a name is missing").when(F.col("times") > 1, F.concat(F.lit("repeated name: "), F.col("name")))
        .when(missing(F.col("lat"), F.col("lon")), F.concat(F.lit("no point: "), F.col("name"))).when(~in_box(F.col("lat"), F.col("lon")), F.concat(F.lit("outside the region: "), F.col("name")))
    )
    return joined.filter(F.when(bad.isNotNull(), F.raise_error(bad).cast("boolean")).otherwise(True)).drop("times")


def overrides(rows: DataFrame) -> DataFrame:
    """Override rows (entity, attribute, value): those without an entity type go, a bad time is null."""
    return rows.filter(not_empty(F.trim("entity_type")).isNotNull()).withColumn("overridden_at", F.try_to_timestamp("overridden_at"))


def override_table(rows: DataFrame, entity: str, fields: list[str]) -> DataFrame:
    """entity_key and a column for each field."""
    return overrides(rows).filter(F.col("entity_type") == entity).groupBy("entity_key").pivot("field", fields).agg(F.first("override_value"))


def latest_snapshot(files: DataFrame, path: str = "path") -> DataFrame:
    """Files of the latest folder whose name is an ISO date."""
    dated = files.withColumn("dt", F.try_to_date(F.regexp_extract(path, r"/(\d{4}-\d{2}-\d{2})/", 1)))
    last = dated.agg(F.max("dt").alias("last"))
    return dated.join(F.broadcast(last), F.col("dt") == F.col("last")).drop("last")


def page_numbers(html: Column) -> Column:
    """Sorted distinct page numbers of pagination links."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(r"[?&]page=(\d+)"), 1), lambda x: x.cast("int"))))


def last_write_wins(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def first_call_wins(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


# --- nested schedules ----------------------------------------------------------------------------


def nested_map(rows: DataFrame, json: str = "payload") -> DataFrame:
    """branch -> clinic -> [{day, from_time, to_time}]: a row per session."""
    kind = "map<string,map<string,array<struct<day:string,from_time:string,to_time:string>>>>"
    a = rows.select("record", F.explode(F.from_json(json, kind)).alias("branch", "clinics"))
    b = a.select("record", "branch", F.explode("clinics").alias("clinic", "sessions"))
    return b.select("record", "branch", "clinic", F.explode("sessions").alias("s")).select("record", "branch", "clinic", F.col("s.day").alias("day_text"), F.col("s.from_time").alias("start_text"), F.col("s.to_time").alias("end_text"))


def nested_clinics(rows: DataFrame, json: str = "payload") -> DataFrame:
    """[{hospital, clinics: [{clinic_name, schedules: [{day, time_from, time_to}]}]}]; clinics without schedules stay."""
    kind = "array<struct<hospital:string,clinics:array<struct<clinic_name:string,schedules:array<struct<day:string,time_from:string,time_to:string>>>>>>"
    a = rows.select("record", F.explode(F.from_json(json, kind)).alias("h"))
    b = a.select("record", F.col("h.hospital").alias("branch"), F.explode_outer("h.clinics").alias("c"))
    return b.select("record", "branch", F.col("c.clinic_name").alias("clinic"), F.explode_outer("c.schedules").alias("s")).select("record", "branch", "clinic", F.col("s.day").alias("day_text"), F.col("s.time_from").alias("start_text"), F.col("s.time_to").alias("end_text"))


def nested_shifts(rows: DataFrame, json: str = "payload") -> DataFrame:
    """[{polyclinic_name, hospitals: [{hospital_name, schedules: [{day, shifts: [{start_time, end_time}]}]}]}]."""
    kind = "array<struct<polyclinic_name:string,hospitals:array<struct<hospital_name:string,schedules:array<struct<day:string,shifts:array<struct<start_time:string,end_time:string>>>>>>>>"
    a = rows.select("record", F.explode(F.from_json(json, kind)).alias("p"))
    b = a.select("record", F.col("p.polyclinic_name").alias("clinic"), F.explode("p.hospitals").alias("h"))
    c = b.select("record", "clinic", F.col("h.hospital_name").alias("branch"), F.explode("h.schedules").alias("s"))
    return c.select("record", "branch", "clinic", F.col("s.day").alias("day_text"), F.explode("s.shifts").alias("t")).select("record", "branch", "clinic", "day_text", F.col("t.start_time").alias("start_text"), F.col("t.end_time").alias("end_text"))


def split_fields(rows: DataFrame, json: str = "payload") -> DataFrame:
    """[{weekday, start_hour, start_minute, end_hour, end_minute}] with numbers as text or not."""
    kind = "array<struct<weekday:int,start_hour:string,start_minute:int,end_hour:string,end_minute:int>>"
    return rows.select("record", F.explode(F.from_json(json, kind)).alias("s")).select("record", "s.*")


def branch_names(source: Column, payload: Column) -> Column:
    """Branch names inside a payload, by the shape its source has; unknown or malformed gives none."""
    none = F.array().cast("array<string>")
    by_map = F.map_keys(F.from_json(payload, "map<string,string>"))
    by_list = F.transform(F.from_json(payload, "array<struct<hospital:string>>"), lambda h: h["hospital"])
    by_shift = F.flatten(F.transform(F.from_json(payload, "array<struct<hospitals:array<struct<hospital_name:string>>>>"), lambda p: F.transform(p["hospitals"], lambda h: h["hospital_name"])))
    found = F.when(source == "map", by_map).when(source == "clinics", by_list).when(source == "shifts", by_shift)
    return F.array_distinct(F.filter(F.coalesce(found, none), lambda x: x.isNotNull()))
