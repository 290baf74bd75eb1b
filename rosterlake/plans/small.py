"""Queries of formats, local times, geocodes, legends and embedded JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterlake.functions import text as tx
from rosterlake.functions import timeparse
from rosterlake.functions.rounding import rounded
from rosterlake.operators import classify
from rosterlake.plans import ingest, places
from rosterlake.plans.views import read
from rosterlake.sources import adapters


def t15_local_days(spark, d):
    return read(spark, d, "events").select("event_id", timeparse.local_day(F.col("ts")).alias("day"))


def t13_week_times(spark, d):
    e = read(spark, d, "events")
    monday = timeparse.next_monday(F.to_date("ts"))
    return e.select("event_id", monday.alias("monday"), timeparse.week_time(monday, F.col("event_id") % 7, F.col("event_id") % 1440).alias("at"))


def s15_formats(spark, d):
    o = read(spark, d, "orders")
    return o.select("o_orderkey", tx.rupiah(F.floor("o_totalprice")).alias("price"), timeparse.clock((F.col("o_orderkey") % 1440).cast("int")).alias("clock"))


def a20_geocodes(spark, d):
    k = F.col("c_custkey")
    addr = F.when(k % 9 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("c_name")))
    kind = F.when(k % 4 == 0, "Suburb").when(k % 4 == 1, "building").otherwise("city")
    lat = F.when(k % 7 == 0, "n/a").otherwise("-6.2")
    return read(spark, d, "customer").select(k.alias("id"), tx.geocode_key(addr).alias("key"), tx.geocode_confidence(addr, kind, lat, F.lit("106.8")).alias("confidence"))


def a24_embedded_json(spark, d):
    s = read(spark, d, "supplier")
    page = F.concat(F.lit('<script>self.push([1,"1a:{\\"id\\":'), F.col("s_suppkey"), F.lit('}"])</script><script>self.push([1,"2:not json"])</script><script>push([1,"3:[1,2]"])</script>'))
    return s.select("s_suppkey", F.array_join(tx.embedded_json(page), "|").alias("found"))


def a18_speciality_ids(spark, d):
    p = read(spark, d, "part").groupBy((F.col("p_partkey") % 20).alias("page")).agg(F.sort_array(F.collect_list(F.struct("p_partkey", F.when(F.col("p_partkey") % 3 == 0, "Dermatologi").when(F.col("p_partkey") % 3 == 1, "KULIT").otherwise("Jantung").alias("n")))).alias("l"))
    return p.select("page", F.size(tx.specialist_ids(F.col("l.p_partkey"), F.col("l.n"))).cast("long").alias("n"))


def a25_array_under(spark, d):
    """The list of a page's payload: under its key at the top, deep inside, beside a value of that name that is no list, or absent."""
    p = read(spark, d, "part")
    k, v = F.col("p_partkey").cast("string"), F.col("p_partkey") % 6
    own = F.concat(F.lit('"doctors":[{"id":'), k, F.lit("}]"))
    text = (
        F.when(v == 0, F.concat(F.lit("{"), own, F.lit("}"))).when(v == 1, F.concat(F.lit('{"a":[{"x":{'), own, F.lit('}}],"doctors":{"n":1}}'))).when(v == 2, F.concat(F.lit('{"a":{"doctors":[1]},'), own, F.lit("}")))
        .when(v == 3, F.concat(F.lit('[{"doctors":'), k, F.lit('},{"b":{"doctors":[]}}]'))).when(v == 4, F.lit('{"a":1}'))
    )
    broken = F.concat(F.lit("{"), own)
    return p.select(F.col("p_partkey").alias("id"), tx.array_under(text, "doctors").alias("found"), tx.array_under_in_blocks(F.array(broken, F.lit('{"a":[]}'), F.coalesce(text, F.lit("[]"))), "doctors").alias("in_blocks"))


def practice(spark, d):
    """(listing, facilities): a record of several branches for each supplier, a facility for each nation."""
    n = read(spark, d, "nation").select("n_nationkey", F.trim("n_name").alias("place"))
    k = F.col("s_suppkey")
    session = lambda day, a, b: F.struct(F.lit(day).alias("day"), F.lit(a).alias("time_from"), F.lit(b).alias("time_to"))
    at = lambda name, *times: F.struct(name.alias("hospital"), F.array(F.struct(F.lit("k").alias("clinic_name"), F.array(*times).alias("schedules"))).alias("clinics"))
    plain, loud = F.concat(F.lit("RS "), "place", F.lit(" Bintaro")), F.concat(F.upper("place"), F.lit(" Bintaro Hospital"))
    one, two = (session("Senin", "08:00", "10:00"),), (session("Selasa", "09:00", "11:30"), session("Kamis", "13:00", "15:00"))
    other = at(F.lit("Quite Another Bintaro"), *one)
    branches = F.when(k % 4 == 0, F.array(at(loud, *two))).when(k % 4 == 1, F.array(at(plain, *one), at(loud, *two))).when(k % 4 == 2, F.array(other)).otherwise(F.array(at(plain, *one), other))
    skin = k % 5 != 0
    name = F.concat(F.lit("dr. "), "s_name", F.when(skin, ", Sp.KK").otherwise(", Sp.JP"))
    record = F.struct(name.alias("fullname_doctor"), k.cast("string").alias("doctor_code"), F.when(skin, "Kulit dan Kelamin").otherwise("Jantung").alias("specialty"), branches.alias("doctor_schedule"))
    listing = read(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.to_json(F.struct(F.array(record).alias("data"))).alias("payload"))
    return listing, n.select(F.col("n_nationkey").cast("long").alias("id"), plain.alias("name"), F.lit(None).cast("string").alias("grp"))


def _loaded(spark, d):
    listing, facilities = practice(spark, d)
    return adapters.REGISTRY["rs_pondok_indah"](listing), facilities


def o02_practitioners(spark, d):
    return ingest.load(*_loaded(spark, d))[0].select("record", "facility", "raw_name", "person", "clean_name", "practitioner")


def o02_sessions(spark, d):
    return ingest.load(*_loaded(spark, d))[1].select("practitioner", "facility", "day", "start_time", "end_time", "confidence")


def e18_outcomes(spark, d):
    raw, facilities = _loaded(spark, d)
    return ingest.outcomes(raw, ingest.resolve(raw, facilities)).select("record", "outcome", F.array_join("unmatched_names", "|").alias("names"))


def m13_legend(spark, d):
    s = classify.scales(places._values(spark, d))
    return classify.legend(s).join(s, "metric").select("metric", "legend", rounded(F.col("upper"), 4).alias("upper"))


QUERIES = {f.__name__: f for f in (t15_local_days, t13_week_times, s15_formats, a20_geocodes, a24_embedded_json, a18_speciality_ids, a25_array_under, o02_practitioners, o02_sessions, e18_outcomes, m13_legend)}

_PRACTICE = """p AS (SELECT s_suppkey AS k, s_suppkey::VARCHAR AS record, s_name, n_nationkey::BIGINT AS facility, 'RS ' || trim(n_name) || ' Bintaro' AS plain, upper(trim(n_name)) || ' Bintaro Hospital' AS loud, s_suppkey % 5 <> 0 AS skin
    FROM supplier JOIN nation ON s_nationkey = n_nationkey),
  hit AS (SELECT *, 'rs_pondok_indah|' || record || '|' || facility AS practitioner FROM p WHERE skin AND k % 4 <> 2)"""

ORACLES = {
    "a25_array_under": """SELECT id, CASE id % 6 WHEN 3 THEN '[]' WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE '[{"id":' || id || '}]' END AS found, found AS in_blocks FROM (SELECT p_partkey AS id FROM part)""",
    "o02_practitioners": f"""WITH {_PRACTICE} SELECT record, facility, 'dr. ' || s_name || ', Sp.KK' AS raw_name, lower(replace(s_name, '#', ' ')) AS person, replace(s_name, '#', ' ') AS clean_name, practitioner FROM hit""",
    "o02_sessions": f"""WITH {_PRACTICE}, t(early, day, start_time, end_time) AS (VALUES (true, 0, '08:00', '10:00'), (false, 1, '09:00', '11:30'), (false, 3, '13:00', '15:00'))
      SELECT practitioner, facility, day, start_time, end_time, 'high' AS confidence FROM hit JOIN t ON early = (k % 4 = 3 OR (k % 4 = 1 AND plain < loud))""",
    "e18_outcomes": f"""WITH {_PRACTICE} SELECT record, CASE WHEN NOT skin THEN 'not specialist' WHEN k % 4 = 2 THEN 'unmatched' ELSE 'loaded' END AS outcome, CASE WHEN skin AND k % 4 >= 2 THEN 'Quite Another Bintaro' ELSE '' END AS names FROM p""",
    "t15_local_days": "SELECT event_id, strftime(ts + INTERVAL 7 HOUR, '%d-%m-%Y') AS day FROM events",
    "t13_week_times": "SELECT event_id, (date_trunc('week', ts) + INTERVAL 7 DAY)::DATE AS monday, date_trunc('week', ts) + INTERVAL 7 DAY + to_days((event_id % 7)::INTEGER) + to_minutes(event_id % 1440) AS at FROM events",
    "s15_formats": "SELECT o_orderkey, 'Rp ' || replace(format('{:,}', floor(o_totalprice)::BIGINT), ',', '.') AS price, printf('%02d:%02d', o_orderkey % 1440 // 60, o_orderkey % 60) AS clock FROM orders",
    "a20_geocodes": "SELECT c_custkey AS id, CASE WHEN c_custkey % 9 <> 0 THEN sha256(c_name)[1:24] END AS key, CASE WHEN c_custkey % 9 = 0 OR c_custkey % 7 = 0 THEN 'unknown' WHEN c_custkey % 4 = 1 THEN 'medium' ELSE 'low' END AS confidence FROM customer",
    "a24_embedded_json": "SELECT s_suppkey, '{\"id\":' || s_suppkey || '}|[1,2]' AS found FROM supplier",
    "a18_speciality_ids": "SELECT p_partkey % 20 AS page, count(*) FILTER (p_partkey % 3 < 2) AS n FROM part GROUP BY 1",
}
