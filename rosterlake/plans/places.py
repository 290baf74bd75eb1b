"""Queries of distance, audit, matching, overlap, classification, planning, sinks and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.functions import geo
from rosterlake.functions import text as tx
from rosterlake.functions.rounding import rounded
from rosterlake.operators import classify, coverage, geo_supply, matching, planning, registry, scoring
from rosterlake.plans import supply
from rosterlake.sources.staging import stored
from rosterlake.plans.views import facility, person_link, read, roster, session, sql
from rosterlake.sources import payloads


def _status(spark, d) -> DataFrame:
    return supply._measured(spark, d)


def _anchors(spark, d) -> DataFrame:
    return facility(spark, d).filter("id % 10 = 3").select("id", "lat", "lon")


def d06_radius_join(spark, d):
    f = facility(spark, d).select("id", "lat", "lon")
    parts = [geo_supply.radius_join(_anchors(spark, d), f, km).withColumn("km", F.lit(km)) for km in (3.0, 5.0, 10.0)]
    return parts[0].union(parts[1]).union(parts[2]).select("km", "anchor", "id", rounded(F.col("distance"), 6).alias("distance"))


def e11_neighbourhood(spark, d):
    m = _status(spark, d)
    pairs = geo_supply.radius_join(_anchors(spark, d), facility(spark, d), 10.0)
    p = F.col("practitioner")
    people = roster(spark, d).select("facility", "practitioner", F.when(p % 4 != 0, F.concat(F.lit("p"), (p % 40).cast("string"))).alias("person"))
    return geo_supply.neighbourhood(pairs, m, people)


def g03_neighbours(spark, d):
    pairs = geo_supply.radius_join(_anchors(spark, d), facility(spark, d), 10.0)
    return geo_supply.ranked_neighbours(pairs).select("anchor", "rank", "id", rounded(F.col("distance"), 6).alias("distance"))


def _points(spark, d) -> DataFrame:
    """Customers as points: some share a place, some lie outside, some have none."""
    k = F.col("c_custkey")
    lat, lon = F.lit(-6.9) + (k % 60) / F.lit(50.0), F.lit(106.2) + (k % 45) / F.lit(40.0)
    conf = F.when(k % 5 == 0, "high").when(k % 5 == 1, "low").when(k % 5 == 2, "medium")
    return read(spark, d, "customer").select(k.alias("id"), F.col("c_name").alias("name"), F.when(k % 17 != 0, lat).alias("lat"), F.when(k % 17 != 0, lon).alias("lon"), conf.alias("confidence"))


def e14_shared_coordinates(spark, d):
    return geo_supply.shared_coordinates(_points(spark, d))


def e15_confidence_histogram(spark, d):
    return geo_supply.confidence_histogram(_points(spark, d))


def e16_spatial_audit(spark, d):
    return geo_supply.spatial_audit(_points(spark, d))


def c04_in_region(spark, d):
    return _points(spark, d).filter(geo.in_box(F.col("lat"), F.col("lon"))).select("id")


def c13_point_lookup(spark, d):
    f = facility(spark, d)
    asked = f.select(F.col("id").alias("key"), "name", (F.col("lat") + F.when(F.col("id") % 4 == 0, 0.01).otherwise(0.0)).alias("lat"), "lon")
    twice = f.unionByName(f.filter("id % 6 = 0").withColumn("id", F.col("id") + 1000))
    return geo_supply.point_lookup(twice, asked, 1e-6)


def g06_nearest(spark, d):
    return geo_supply.nearest(facility(spark, d), -6.2, 106.8).select("id", rounded(F.col("off"), 8).alias("off"))


def c12_groups(spark, d):
    f = facility(spark, d)
    return f.select("id", matching.group_match(F.concat("name", F.lit(" "), F.col("city")), ["kota 1", "KOTA 3", "00007"]).alias("grp"))


def c11_ownership(spark, d):
    k = F.col("c_custkey") % 6
    kind = F.when(k == 0, "private").when(k == 1, "private_non_profit").when(k == 2, "government").when(k == 3, "public").when(k == 4, "community").otherwise("religious")
    return read(spark, d, "customer").select(F.col("c_custkey").alias("id"), matching.ownership(kind).alias("ownership"))


def c15_address(spark, d):
    k = F.col("c_custkey")
    full, street, number = F.when(k % 3 == 0, "Jl. A 1").otherwise(""), F.when(k % 3 == 1, "Jl. B"), F.when(k % 2 == 0, "7")
    return read(spark, d, "customer").select(k.alias("id"), tx.address(full, street, number, F.when(k % 5 != 0, F.col("c_mktsegment"))).alias("address"), tx.shown_name(F.col("c_name"), F.when(k % 4 == 0, F.lit("alias"))).alias("shown"))


def c06_facility_only(spark, d):
    k = F.col("p_partkey")
    label = F.when(k % 4 == 0, F.concat(F.lit("RS "), F.col("p_name"))).when(k % 4 == 1, F.concat(F.col("p_name"), F.lit(" Hospital"))).when(k % 4 == 2, F.concat(F.lit("Klinik RS "), F.col("p_name"))).otherwise(F.col("p_name"))
    return read(spark, d, "part").filter(matching.facility_only(label, F.when(k % 7 == 0, F.lit("grp")), ("klinik", "apotek"))).select(k.alias("id"))


def c07_in_region_hints(spark, d):
    p = read(spark, d, "part")
    return p.filter(matching.in_region(F.col("p_name"), ("red", "hot", "gear"), ("bolt",))).select(F.col("p_partkey").alias("id"))


def d05_person_overlap(spark, d):
    return matching.external_facilities(person_link(spark, d))


def _names(spark, d) -> DataFrame:
    f = facility(spark, d)
    k = F.col("id")
    raw = F.when(k % 4 == 0, F.upper("name")).when(k % 4 == 1, F.concat(F.lit("RS "), F.regexp_replace("name", "0", ""))).when(k % 4 == 2, F.concat(F.col("name"), F.lit(" Hospital"))).otherwise(F.lit("Quite Another Place"))
    return f.select(k.alias("key"), raw.alias("raw"), F.when(k % 3 != 0, F.col("grp")).alias("grp"))


def d07_fuzzy_match(spark, d):
    return matching.fuzzy_best(_names(spark, d), facility(spark, d))


def d08_cascade(spark, d):
    f = facility(spark, d)
    names = _names(spark, d)
    point = names.filter("key % 8 = 3").limit(1).select("raw").join(f.filter("id = 5").select("lat", "lon"))
    alias = names.filter("key % 8 = 1").select("raw").distinct().withColumn("target", F.lit("Supplier#000000009"))
    return matching.cascade(names, f, point, alias)


def d09_greedy_dedup(spark, d):
    f = facility(spark, d)
    twin = f.filter("id % 5 = 0").select((F.col("id") + 1000).alias("id"), F.concat(F.lit("RS "), F.col("name")).alias("name"), (F.col("lat") + 0.001).alias("lat"), F.col("lon").alias("lon"))
    return matching.greedy_dedup(f.select("id", "name", "lat", "lon").unionByName(twin).withColumnRenamed("id", "ordinal"))


def d10_overrides(spark, d):
    f = facility(spark, d)
    side = lambda i: F.struct(F.col("name"), (F.col("lat") + i).alias("lat"), F.col("lon"))
    a = f.select(F.col("id").alias("key"), side(0.0001).alias("source"))
    b = f.select((F.col("id") - 1).alias("key"), side(0.0).alias("target"))
    c = a.join(b, "key").withColumn("target", F.when(F.col("key") % 5 == 0, F.lit(None)).otherwise(F.col("target")))
    return matching.resolve_overrides(c, f)


def d13_practitioner_details(spark, d):
    s = session(spark, d).select("facility", "practitioner", "day", "start_min")
    return roster(spark, d).join(s, ["facility", "practitioner"], "left").dropDuplicates(["facility", "practitioner", "day", "start_min"])


def _values(spark, d) -> DataFrame:
    m = _status(spark, d)
    rows = m.join(scoring.scores(m, "all_hospitals"), "facility").withColumn("quality", scoring.quality_label())
    return classify.long_form(rows)


def e23_scales(spark, d):
    s = classify.scales(_values(spark, d))
    return s.select("metric", "n", *[rounded(F.col(c), 6).alias(c) for c in ("least", "most", "lower", "upper")])


def m12_classes(spark, d):
    v = stored(_values(spark, d))
    return classify.classify(v, classify.scales(v))


def p08_free_gaps(spark, d):
    s = session(spark, d)
    known = coverage.completeness(s, roster(spark, d))
    return planning.free_gaps(s, facility(spark, d).select("id", F.col("id").alias("position")), known, minutes=120)


def _plan_tables(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ten sessions of a made-up week, a school in every region, and the ways between all places."""
    k = F.col("id")
    sessions = spark.range(10).select(
        k.alias("slot"), (k % 4).alias("facility"), (k % 5).cast("int").alias("day"), (540 + 90 * (k % 3)).cast("int").alias("start"),
        (660 + 90 * (k % 3)).cast("int").alias("end"), (k == 0).alias("locked"), (1 + k % 5).cast("int").alias("priority"),
    )
    r = F.col("r_regionkey").cast("long")
    schools = read(spark, d, "region").select(
        r.alias("school"), (10 + r).alias("place"), (r != 3).alias("level_ok"), F.when(r != 1, 1000.0 * (1 + r % 4)).alias("first_year"), (r % 2 == 0).alias("curriculum_ok"),
        F.when(r == 2, F.array(F.lit(5), F.lit(6))).otherwise(F.array(F.lit(0), F.lit(6))).alias("days"), F.lit(470).alias("start"), F.lit(900).alias("end"),
    )
    place = spark.range(-1, 4).select(k.alias("p")).union(schools.select("place"))
    p, q = F.col("origin"), F.col("destination")
    travel = place.select(F.col("p").alias("origin")).crossJoin(place.select(F.col("p").alias("destination"))).filter(p != q)
    travel = travel.select(p, q, (15 + F.pmod(p * 7 + q * 11, F.lit(45))).cast("int").alias("minutes"), ((q - 10) * 4.0 + F.when(q == 14, 10).otherwise(0)).alias("km"))
    return sessions, planning.school_distances(schools, travel), travel


_LIMITS = planning.Limits(sessions=3, days=3, hours=10.0, budget=3500.0, school_km=20.0, weights=(40, 30, 10, 10, 10), prefers_curriculum=True)


def _routed(spark, d) -> DataFrame:
    s, schools, travel = _plan_tables(spark, d)
    return planning.routed(planning.enumerate_plans(s, schools, _LIMITS), s, schools, travel, _LIMITS)


def p02_plan_rejections(spark, d):
    return planning.rejections(_routed(spark, d))


def p06_ranked_plans(spark, d):
    return planning.rank_plans(_routed(spark, d), _LIMITS).withColumn("notes", F.array_join("notes", "|"))


def p09_school_minutes(spark, d):
    return _routed(spark, d).filter("reason IS NULL").select("mask", "school", "minutes", "extra")


def _registry_tables(spark, d) -> tuple[DataFrame, ...]:
    f, k = facility(spark, d), F.col("id")
    kind = F.get(F.array(*[F.lit(x) for x in ("private", "government", "religious")]), (k % 3).cast("int"))
    mapped = f.filter("id % 5 <> 0").select(
        "id", "name", kind.alias("kind"), F.when(k % 4 == 0, "Jl. A 1").alias("full"), F.when(k % 4 == 1, "Jl. B").alias("street"), F.lit("7").alias("number"), "city",
        F.when(k % 13 != 0, F.col("lat")).alias("lat"), "lon", F.when(k % 2 == 1, F.array(F.lower("name"))).alias("aliases"),
    )
    curated = f.filter("id % 5 = 0").select("id", "name", F.when(k % 2 == 0, "0001").otherwise("other").alias("grp"), "ownership", F.col("city").alias("address"), "city", "lat", "lon", F.lit("website").alias("geocode_source"), F.lit("high").alias("geocode_confidence"))
    groups = f.filter("id % 31 = 4").select("name", F.concat(F.lit("group "), k).alias("grp"))
    point = lambda name, by: F.struct(F.col("name"), (F.col("lat") + by).alias("lat"), F.col("lon")).alias(name)
    duplicates = f.filter("id % 17 = 3").select(k.alias("key"), point("source", 0.0001)).join(f.select((k + 1).alias("key"), point("target", 0.0)), "key")
    aliases = f.filter("id % 19 = 4").select(k.alias("position"), "name", "lat", (F.col("lon") + F.when(k % 2 == 0, 0.001).otherwise(0.0001)).alias("lon"), F.concat(F.lit("Known as "), k).alias("alias"))
    return mapped, curated, groups, duplicates, aliases


def o01_registry(spark, d):
    mapped, curated, groups, duplicates, aliases = _registry_tables(spark, d)
    return registry.registry(mapped, curated, ["0001", "00002"], groups, duplicates, aliases)


def b03_reload(spark, d):
    mapped, curated, groups, *_ = _registry_tables(spark, d)
    old = registry.map_rows(mapped, ["0001"], groups).unionByName(registry.curated_rows(curated, ["0001"]))
    news = registry.map_rows(mapped.filter("id % 2 = 0").withColumn("city", F.lit("moved")), ["0001"], groups)
    told = registry.curated_rows(curated.filter("id % 3 = 0").withColumn("city", F.lit("moved")), ["0001"])
    return registry.curated_reload(registry.map_reload(old, news), told).select("id", "tier", "city", "geocode_source")


def b06_upsert(spark, d):
    f = facility(spark, d)
    old = f.select("id", F.col("name").alias("value"), F.lit("old").alias("run"))
    return registry.upsert(old, f.filter("id % 3 = 0").select((F.col("id") * 2).alias("id"), F.col("city").alias("value"), F.lit("new").alias("run")), ["id"])


def d11_display_alias(spark, d):
    *_, aliases = _registry_tables(spark, d)
    return matching.display_alias(facility(spark, d), aliases).select("id", "display_alias")


def d12_group_override(spark, d):
    _, _, groups, *_ = _registry_tables(spark, d)
    return matching.group_override(facility(spark, d), groups).select("id", "grp")


def m14_school_costs(spark, d):
    p = read(spark, d, "part")
    k = F.col("p_partkey")
    s = p.select(k.alias("id"), F.col("p_retailprice").alias("admission"), F.when(k % 5 != 0, k * 1.0).alias("monthly"), F.when(k % 7 != 0, F.lit(250.0)).alias("annual"), F.lit(10.0).alias("other"))
    return planning.school_costs(s).select("id", "first_year", "recurring")


def e18_load_summary(spark, d):
    n = matching.fuzzy_best(_names(spark, d), facility(spark, d)).withColumn("source", F.concat(F.lit("s"), (F.col("key") % 3).cast("string")))
    return n.groupBy("source").agg(F.count("*").alias("total"), F.count_if(F.col("id").isNull()).alias("unmatched"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("id").isNull(), F.col("raw")))), "|").alias("unmatched_names"))


def e19_registry_counters(spark, d):
    f = facility(spark, d)
    return f.agg(F.count("*").alias("total"), F.count("lat").alias("with_coords"), F.count_if("preferred").alias("preferred"), F.count_if(F.col("ownership") == "swasta").alias("private"), F.count_if(F.col("ownership") == "pemerintah").alias("public"), F.count_if(F.col("ownership").isNull()).alias("unknown"))


def e21_map_centre(spark, d):
    return facility(spark, d).agg(rounded(F.avg("lat"), 6).alias("lat"), rounded(F.avg("lon"), 6).alias("lon"))


def e22_latest(spark, d):
    return read(spark, d, "events").agg(F.max("ts").alias("latest"))


def g08_options(spark, d):
    f = facility(spark, d)
    return f.select(F.lit("city").alias("kind"), F.col("city").alias("value")).union(f.filter("grp IS NOT NULL").select(F.lit("group"), "grp")).distinct().orderBy("kind", "value")


def a02_osm_elements(spark, d):
    k = F.col("s_suppkey")
    tags = F.create_map(F.lit("name"), F.col("s_name"), F.lit("website"), F.when(k % 2 == 0, F.lit("")).otherwise(F.lit("w")), F.lit("contact:website"), F.lit("c"), F.lit("addr:village"), F.lit("v"), F.lit("operator:type"), F.lit("public"))
    node = F.named_struct(F.lit("type"), F.when(k % 3 == 0, "way").otherwise("node"), F.lit("id"), k, F.lit("lat"), F.when(k % 3 != 0, k * 0.5), F.lit("lon"), F.when(k % 3 != 0, k * 0.25), F.lit("center"), F.when(k % 3 == 0, F.struct((k * 2.0).alias("lat"), (k * 4.0).alias("lon"))), F.lit("tags"), tags)
    doc = read(spark, d, "supplier").groupBy((k % 4).alias("page")).agg(F.to_json(F.struct(F.collect_list(node).alias("elements"))).alias("json"))
    return payloads.osm_elements(doc).select("type", "id", "lat", "lon", "name", "website", "suburb", "source_url", matching.ownership(F.col("operator_type")).alias("ownership"))


def a06_override_table(spark, d):
    p = read(spark, d, "part")
    k = F.col("p_partkey")
    rows = p.select(F.when(k % 3 == 0, "hospital").when(k % 3 == 1, "doctor").otherwise(" ").alias("entity_type"), (k % 50).cast("string").alias("entity_key"), F.when(k % 2 == 0, "display_alias").otherwise("duplicate_of").alias("field"), F.concat(F.lit("v"), (k % 50).cast("string")).alias("override_value"), F.lit("bad").alias("overridden_at"))
    return payloads.override_table(rows, "hospital", ["display_alias", "duplicate_of"])


def b11_signature(spark, d):
    f = facility(spark, d).select("id", F.sha2(F.concat_ws("|", "name", F.coalesce("grp", F.lit("")), "city"), 256).alias("signature"))
    return f


QUERIES = {f.__name__: f for f in (d06_radius_join, e11_neighbourhood, g03_neighbours, e14_shared_coordinates, e15_confidence_histogram, e16_spatial_audit, c04_in_region, c13_point_lookup, g06_nearest, c12_groups, c11_ownership, c15_address, c06_facility_only, c07_in_region_hints, d05_person_overlap, d07_fuzzy_match, d08_cascade, d09_greedy_dedup, d10_overrides, d13_practitioner_details, e23_scales, m12_classes, p08_free_gaps, p02_plan_rejections, p06_ranked_plans, p09_school_minutes, o01_registry, b03_reload, b06_upsert, d11_display_alias, d12_group_override, m14_school_costs, e18_load_summary, e19_registry_counters, e21_map_centre, e22_latest, g08_options, a02_osm_elements, a06_override_table, b11_signature)}

_D = "2 * 6371.0::DOUBLE * asin(least(1.0::DOUBLE, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"
_PAIRS = f"pairs AS (SELECT * FROM (SELECT a.id AS anchor, b.id, {_D} AS distance FROM facility a JOIN facility b ON a.id % 10 = 3 AND a.id <> b.id) WHERE distance <= 10)"
_POINTS = """points AS (SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 17 <> 0 THEN -6.9::DOUBLE + (c_custkey % 60) / 50.0::DOUBLE END AS lat,
  CASE WHEN c_custkey % 17 <> 0 THEN 106.2::DOUBLE + (c_custkey % 45) / 40.0::DOUBLE END AS lon, CASE c_custkey % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' END AS confidence FROM customer)"""
_LONG = f"""{supply._LABELLED}, v AS (SELECT facility, status, quality, 'practitioners' AS metric, practitioners::DOUBLE AS value FROM labelled UNION ALL SELECT facility, status, quality, 'weekly_hours', weekly_hours FROM labelled
  UNION ALL SELECT facility, status, quality, 'coverage_ratio', coverage_ratio FROM labelled UNION ALL SELECT facility, status, quality, 'score', score FROM labelled),
 part_ AS (SELECT * FROM v WHERE value IS NOT NULL AND quality NOT IN ('unknown', 'confirmed_zero') AND (quality <> 'partial' OR metric = 'practitioners')),
 sc AS (SELECT metric, count(*) AS n, CASE WHEN metric = 'practitioners' THEN 0 ELSE min(value) END AS least, CASE WHEN metric = 'practitioners' THEN 999 ELSE max(value) END AS most,
   CASE WHEN metric = 'practitioners' THEN 3 ELSE quantile_cont(value, 1.0::DOUBLE / 3) END AS lower, CASE WHEN metric = 'practitioners' THEN 5 ELSE quantile_cont(value, 2.0::DOUBLE / 3) END AS upper FROM part_ GROUP BY 1)"""
_R6 = "decimals({}, 6)"

#: The planner's rules over the same week, as plain SQL: v is 1 with the school and 0 without.
_PLANS = """ses AS (SELECT id AS slot, id % 4 AS facility, (id % 5)::INTEGER AS day, 540 + 90 * (id % 3) AS start, 660 + 90 * (id % 3) AS fin, id = 0 AS locked, 1 + id % 5 AS priority FROM range(10) r(id)),
 sch AS (SELECT r_regionkey::BIGINT AS school, 10 + r_regionkey AS place, r_regionkey <> 3 AS level_ok, r_regionkey * 4.0::DOUBLE + CASE WHEN r_regionkey = 4 THEN 10 ELSE 0 END AS km, CASE WHEN r_regionkey <> 1 THEN 1000.0::DOUBLE * (1 + r_regionkey % 4) END AS first_year,
   r_regionkey % 2 = 0 AS curriculum_ok, CASE WHEN r_regionkey = 2 THEN [5, 6] ELSE [0, 6] END AS days FROM region),
 pl AS (SELECT m AS mask FROM range(1024) r(m) WHERE bit_count(m) = 3 AND m & 1 = 1),
 tk AS (SELECT mask, ses.* FROM pl JOIN ses ON (mask >> slot) & 1 = 1),
 facts AS (SELECT mask, count(DISTINCT day) AS n_days, sum(fin - start) / 60.0::DOUBLE AS hours, sum((fin - start) * priority)::DOUBLE / sum(fin - start) / 5 AS priority, list(slot::VARCHAR ORDER BY NOT locked, slot) AS slots FROM tk GROUP BY 1),
 runs AS (SELECT school, place, unnest(days) AS day, 460 AS start, 470 AS fin, 16 AS seq FROM sch UNION ALL SELECT school, place, unnest(days), 900, 910, 17 FROM sch),
 ev AS (SELECT v, mask, school, day, start, fin, facility AS place, true AS practice, slot AS seq FROM tk, sch, range(2) x(v) UNION ALL SELECT 1, mask, school, day, start, fin, place, false, seq FROM pl, runs),
 clash AS (SELECT DISTINCT mask, school, true AS clash FROM (SELECT mask, school, fin > lead(start) OVER (PARTITION BY mask, school, day ORDER BY start, fin, seq) AS c FROM ev WHERE v = 1) WHERE c),
 tours AS (SELECT *, CASE WHEN bool_or(practice) OVER (PARTITION BY v, mask, school, day) THEN 0 ELSE row_number() OVER (PARTITION BY v, mask, school, day ORDER BY start, fin, seq) END AS tour FROM ev),
 steps AS (SELECT *, coalesce(lag(place) OVER w, -1) AS origin, lag(fin) OVER w AS left_at, lead(seq) OVER w IS NULL AS is_last FROM tours WINDOW w AS (PARTITION BY v, mask, school, day, tour ORDER BY start, fin, seq)),
 legs AS (SELECT v, mask, school, day, tour, origin, place AS destination, left_at, start AS due FROM steps UNION ALL SELECT v, mask, school, day, tour, place, -1, fin, NULL FROM steps WHERE is_last),
 timed AS (SELECT *, CASE WHEN origin = destination THEN 0 ELSE 15 + ((origin * 7 + destination * 11) % 45 + 45) % 45 END AS minutes FROM legs),
 ways AS (SELECT v, mask, school, day, tour, sum(minutes) AS minutes, bool_and(minutes <= 120 AND CASE WHEN left_at IS NULL THEN due - 15 - minutes >= 360 WHEN due IS NULL THEN left_at + minutes <= 1320 ELSE left_at + minutes + 15 <= due END) AS ok,
   max(CASE WHEN left_at IS NULL THEN due - 15 - minutes END) AS out_at, max(CASE WHEN due IS NULL THEN left_at + minutes END) AS back_at FROM timed GROUP BY 1, 2, 3, 4, 5),
 weeks AS (SELECT v, mask, school, sum(minutes)::BIGINT AS minutes, bool_and(ok AND coalesce(out_at >= before, true)) AS ok FROM (SELECT *, lag(back_at) OVER (PARTITION BY v, mask, school, day ORDER BY tour) AS before FROM ways) GROUP BY 1, 2, 3),
 plans AS (SELECT mask, school, hours, priority, slots, first_year, curriculum_ok, w.minutes, w.minutes - b.minutes AS extra, CASE WHEN NOT level_ok THEN 'level' WHEN first_year IS NULL THEN 'budget unknown' WHEN first_year > 3500 THEN 'over budget' WHEN km > 20 THEN 'too far'
   WHEN n_days > 3 OR hours > 10 THEN 'days or hours' WHEN clash THEN 'overlap' WHEN NOT w.ok THEN 'travel' WHEN NOT b.ok THEN 'baseline' END AS reason
   FROM facts CROSS JOIN sch JOIN (SELECT * FROM weeks WHERE v = 1) w USING (mask, school) JOIN (SELECT * FROM weeks WHERE v = 0) b USING (mask, school) LEFT JOIN clash USING (mask, school)),
 ranked AS (SELECT *, decimals(100 * (40 * (1 - minutes / max(minutes) OVER ()) + 30 * priority + 10 * least(hours / 10, 1) + 10 * (1 - first_year / max(first_year) OVER ()) + 10 * curriculum_ok::INTEGER) / 100, 2) AS score FROM plans WHERE reason IS NULL),
 turns AS (SELECT *, row_number() OVER (PARTITION BY school ORDER BY score DESC, minutes, slots) > 1 AS later FROM ranked)"""
_KEYED = "regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')"
_MAP_ROWS = """mapped AS (SELECT *, CASE WHEN id % 13 <> 0 THEN lat END AS lat_, id % 13 <> 0 AS placed FROM facility WHERE id % 5 <> 0)"""

ORACLES = {
    "d06_radius_join": sql(f"SELECT km, anchor, id, {_R6.format('distance')} AS distance FROM (SELECT a.id AS anchor, b.id, {_D} AS distance FROM facility a JOIN facility b ON a.id % 10 = 3 AND a.id <> b.id), (VALUES (3.0::DOUBLE), (5.0::DOUBLE), (10.0::DOUBLE)) r(km) WHERE distance <= km"),
    "e11_neighbourhood": sql(f"""SELECT * FROM (WITH {_PAIRS}, {supply._METRICS}, near AS (SELECT p.anchor, p.id, m.status, m.weekly_hours FROM pairs p JOIN metrics m ON m.facility = p.id),
      flat AS (SELECT anchor, count(*) AS total, count(*) FILTER (status <> 'unknown') AS known, count(*) FILTER (status = 'unknown') AS unknown, count(*) FILTER (status = 'has_doctors') AS has, count(*) FILTER (status = 'confirmed_zero') AS zero, decimals(sum(coalesce(weekly_hours, 0)), 2) AS hours FROM near GROUP BY 1),
      who AS (SELECT anchor, count(DISTINCT coalesce(CASE WHEN practitioner % 4 <> 0 THEN 'p' || (practitioner % 40) END, 'doctor-id:' || practitioner)) AS people FROM near JOIN roster ON roster.facility = near.id WHERE status = 'has_doctors' GROUP BY 1),
      r AS (SELECT *, {supply._R4.format('known::DOUBLE / total')} AS ratio FROM flat LEFT JOIN who USING (anchor))
      SELECT anchor, total, known, unknown, has, zero, coalesce(people, 0) AS people, hours, ratio, CASE WHEN ratio = 0 THEN 'unknown' WHEN ratio >= 0.8 THEN 'high' WHEN ratio >= 0.5 THEN 'medium' ELSE 'low' END AS quality FROM r)"""),
    "g03_neighbours": sql(f"SELECT * FROM (WITH {_PAIRS} SELECT anchor, row_number() OVER (PARTITION BY anchor ORDER BY distance, id) AS rank, id, {_R6.format('distance')} AS distance FROM pairs)"),
    "e14_shared_coordinates": f"WITH {_POINTS} SELECT lat, lon, count(*) AS n, string_agg(name, '|' ORDER BY name) AS names FROM points WHERE lat IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1",
    "e15_confidence_histogram": f"WITH {_POINTS} SELECT coalesce(confidence, 'unknown') AS confidence, count(*) AS n FROM points GROUP BY 1",
    "e16_spatial_audit": f"WITH {_POINTS} SELECT id, CASE WHEN lat IS NULL OR lon IS NULL THEN 'unknown' WHEN NOT (lat BETWEEN -6.8 AND -5.9 AND lon BETWEEN 106.3 AND 107.3) THEN 'low' WHEN count(*) OVER (PARTITION BY lat, lon) > 1 THEN 'medium' ELSE coalesce(confidence, 'medium') END AS confidence FROM points",
    "c04_in_region": f"WITH {_POINTS} SELECT id FROM points WHERE lat BETWEEN -6.8 AND -5.9 AND lon BETWEEN 106.3 AND 107.3",
    "c13_point_lookup": sql("SELECT id AS key, id FROM facility WHERE id % 4 <> 0 AND id % 6 <> 0"),
    "g06_nearest": sql("SELECT id, decimals(off, 8) AS off FROM (SELECT id, pow(lat + 6.2::DOUBLE, 2) + pow(lon - 106.8::DOUBLE, 2) AS off FROM facility ORDER BY off, id LIMIT 40)"),
    "c12_groups": sql("SELECT id, CASE WHEN contains(lower(name || ' ' || city), 'kota 1') THEN 'kota 1' WHEN contains(lower(name || ' ' || city), 'kota 3') THEN 'KOTA 3' WHEN contains(name, '00007') THEN '00007' END AS grp FROM facility"),
    "c11_ownership": "SELECT c_custkey AS id, CASE WHEN c_custkey % 6 IN (0, 1) THEN 'swasta' WHEN c_custkey % 6 IN (2, 3, 4) THEN 'pemerintah' END AS ownership FROM customer",
    "c15_address": """SELECT c_custkey AS id, nullif(concat_ws(', ', coalesce(CASE WHEN c_custkey % 3 = 0 THEN 'Jl. A 1' END, nullif(concat_ws(' ', CASE WHEN c_custkey % 3 = 1 THEN 'Jl. B' END, CASE WHEN c_custkey % 2 = 0 THEN '7' END), '')), CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END), '') AS address,
      CASE WHEN c_custkey % 4 = 0 THEN c_name || ' (a.k.a. alias)' ELSE c_name END AS shown FROM customer""",
    "c06_facility_only": "SELECT p_partkey AS id FROM part WHERE p_partkey % 4 IN (0, 1) OR (p_partkey % 4 = 3 AND p_partkey % 7 = 0)",
    "c07_in_region_hints": "SELECT p_partkey AS id FROM part WHERE NOT contains(p_name, 'bolt') AND (contains(p_name, 'red') OR contains(p_name, 'hot') OR contains(p_name, 'gear'))",
    "d05_person_overlap": sql("SELECT * FROM (WITH o AS (SELECT person, count(*) - 1 AS other FROM person_link GROUP BY 1) SELECT facility, nullif(count(*) FILTER (other > 0), 0) AS shared_people, decimals(sum(other)::DOUBLE / nullif(count(*) FILTER (other > 0), 0), 2) AS mean_other FROM person_link JOIN o USING (person) GROUP BY 1)"),
    "d10_overrides": sql("SELECT a.id AS key, a.id AS source_id, b.id AS target_id FROM facility a JOIN facility b ON b.id = a.id + 1 WHERE a.id % 5 <> 0"),
    "d13_practitioner_details": sql("SELECT DISTINCT facility, practitioner, day, start_min FROM roster LEFT JOIN session USING (facility, practitioner)"),
    "e23_scales": sql(f"SELECT * FROM (WITH {_LONG} SELECT metric, n, {_R6.format('least')} AS least, {_R6.format('most')} AS most, {_R6.format('lower')} AS lower, {_R6.format('upper')} AS upper FROM sc)"),
    "m12_classes": sql(f"""SELECT * FROM (WITH {_LONG} SELECT facility, metric, CASE WHEN quality = 'confirmed_zero' THEN 'green' WHEN value IS NULL OR quality = 'unknown' THEN 'gray' WHEN quality = 'partial' AND metric <> 'practitioners' THEN 'gray'
      WHEN most IS NULL OR most <= least THEN 'orange' WHEN value <= lower THEN CASE WHEN metric = 'score' THEN 'red' ELSE 'green' END WHEN value <= upper THEN 'orange' ELSE CASE WHEN metric = 'score' THEN 'green' ELSE 'red' END END AS colour FROM v LEFT JOIN sc USING (metric))"""),
    "p08_free_gaps": sql(f"""SELECT facility, day, start, start + 120 AS "end", turn FROM (WITH {supply._COMPLETE}, s AS (SELECT * FROM usable), spots AS (SELECT facility AS id FROM complete WHERE completeness >= 0.8::DOUBLE AND facility IN (SELECT facility FROM usable)),
      c AS (SELECT id AS facility, d::INTEGER AS day, t::INTEGER AS start FROM spots, range(6) a(d), range(480, 1141, 120) b(t)),
      f AS (SELECT facility, day, min(start) AS start FROM c WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.facility = c.facility AND s.day = c.day AND (s.end_min IS NULL OR (c.start < s.end_min AND s.start_min < c.start + 120))) GROUP BY 1, 2)
      SELECT *, row_number() OVER (PARTITION BY facility ORDER BY day) AS turn FROM f ORDER BY turn, facility LIMIT 16)"""),
    "p02_plan_rejections": f"WITH {_PLANS} SELECT coalesce(reason, 'kept') AS reason, CASE WHEN reason IN ('level', 'budget unknown', 'over budget', 'too far') THEN count(DISTINCT school) ELSE count(*) END AS n FROM plans GROUP BY reason",
    "p06_ranked_plans": f"WITH {_PLANS} SELECT mask, school, minutes, extra, hours, score, '' AS notes FROM turns ORDER BY later, score DESC, minutes, slots, school LIMIT 5",
    "p09_school_minutes": f"WITH {_PLANS} SELECT mask, school, minutes, extra FROM plans WHERE reason IS NULL",
    "o01_registry": sql(f"""SELECT * FROM (WITH {_MAP_ROWS}, r AS (
      SELECT id, name, CASE WHEN id % 2 = 1 THEN '["' || lower(name) || '"]' ELSE '[]' END AS aliases,
        CASE WHEN id % 31 = 4 THEN 'group ' || id WHEN contains(name, '0001') THEN '0001' WHEN contains(name, '00002') THEN '00002' END AS grp, CASE id % 3 WHEN 0 THEN 'swasta' WHEN 1 THEN 'pemerintah' END AS ownership,
        CASE id % 4 WHEN 0 THEN 'Jl. A 1' WHEN 1 THEN 'Jl. B 7' ELSE '7' END || ', ' || city AS address, city, lat_ AS lat, lon, CASE WHEN placed THEN 'osm_overpass' END AS geocode_source, CASE WHEN placed THEN 'medium' END AS geocode_confidence,
        'official' AS tier, CASE WHEN placed THEN 'partial' ELSE 'unknown' END AS status FROM mapped
      UNION ALL SELECT id, name, '[]', CASE WHEN id % 2 = 0 THEN '0001' ELSE 'other' END, ownership, city, city, lat, lon, 'website', 'high', 'manual', 'manual' FROM facility WHERE id % 5 = 0)
      SELECT r.*, {_KEYED} AS name_key, CASE WHEN tier = 'manual' THEN grp = '0001' ELSE grp IS NOT NULL END AS preferred,
        CASE WHEN id % 17 = 3 AND lat IS NOT NULL THEN (SELECT t.id FROM r t WHERE t.id = r.id - 1 AND t.lat IS NOT NULL) END AS duplicate_of, CASE WHEN id % 19 = 4 AND id % 2 = 1 AND lat IS NOT NULL THEN 'Known as ' || id END AS display_alias FROM r)"""),
    "b03_reload": sql(f"""SELECT * FROM (WITH {_MAP_ROWS} SELECT id, 'official' AS tier, city, NULL AS geocode_source FROM mapped WHERE NOT placed
      UNION ALL SELECT id, 'official', 'moved', CASE WHEN placed THEN 'osm_overpass' END FROM mapped WHERE id % 2 = 0 UNION ALL SELECT id, 'manual', 'moved', 'website' FROM facility WHERE id % 15 = 0)"""),
    "b06_upsert": sql("SELECT id, name AS value, 'old' AS run FROM facility WHERE id % 6 <> 0 OR id / 2 NOT IN (SELECT id FROM facility) UNION ALL SELECT id * 2, city, 'new' FROM facility WHERE id % 3 = 0"),
    "d11_display_alias": sql("SELECT id, CASE WHEN id % 19 = 4 AND id % 2 = 1 THEN 'Known as ' || id END AS display_alias FROM facility"),
    "d12_group_override": sql("SELECT id, CASE WHEN id % 31 = 4 THEN 'group ' || id ELSE grp END AS grp FROM facility"),
    "m14_school_costs": "SELECT p_partkey AS id, p_retailprice + 12 * CASE WHEN p_partkey % 5 <> 0 THEN p_partkey::DOUBLE END + CASE WHEN p_partkey % 7 <> 0 THEN 250.0::DOUBLE END + 10.0::DOUBLE AS first_year, 12 * CASE WHEN p_partkey % 5 <> 0 THEN p_partkey::DOUBLE END + CASE WHEN p_partkey % 7 <> 0 THEN 250.0::DOUBLE END AS recurring FROM part",
    "e19_registry_counters": sql("SELECT count(*) AS total, count(lat) AS with_coords, count(*) FILTER (preferred) AS preferred, count(*) FILTER (ownership = 'swasta') AS private, count(*) FILTER (ownership = 'pemerintah') AS public, count(*) FILTER (ownership IS NULL) AS unknown FROM facility"),
    "e21_map_centre": sql(f"SELECT {_R6.format('avg(lat)')} AS lat, {_R6.format('avg(lon)')} AS lon FROM facility"),
    "e22_latest": "SELECT max(ts) AS latest FROM events",
    "g08_options": sql("SELECT DISTINCT 'city' AS kind, city AS value FROM facility UNION SELECT DISTINCT 'group', grp FROM facility WHERE grp IS NOT NULL"),
    "a02_osm_elements": """SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'way' ELSE 'node' END AS type, s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey * 2.0::DOUBLE ELSE s_suppkey * 0.5::DOUBLE END AS lat,
      CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey * 4.0::DOUBLE ELSE s_suppkey * 0.25::DOUBLE END AS lon, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'c' ELSE 'w' END AS website, 'v' AS suburb,
      'https://www.openstreetmap.org/' || CASE WHEN s_suppkey % 3 = 0 THEN 'way' ELSE 'node' END || '/' || s_suppkey AS source_url, 'pemerintah' AS ownership FROM supplier""",
    "a06_override_table": "SELECT (p_partkey % 50)::VARCHAR AS entity_key, max(CASE WHEN p_partkey % 2 = 0 THEN 'v' || (p_partkey % 50) END) AS display_alias, max(CASE WHEN p_partkey % 2 = 1 THEN 'v' || (p_partkey % 50) END) AS duplicate_of FROM part WHERE p_partkey % 3 = 0 GROUP BY 1",
    "b11_signature": sql("SELECT id, sha256(concat_ws('|', name, coalesce(grp, ''), city)) AS signature FROM facility"),
}
