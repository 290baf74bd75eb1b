"""Queries of names, credentials, schedule text and nested payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.functions import similarity, timeparse
from rosterlake.functions import text as tx
from rosterlake.functions.rounding import rounded
from rosterlake.operators import matching
from rosterlake.plans.views import read
from rosterlake.sources import html, payloads


def raw_names(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p_name")
    v = F.col("p_partkey") % 6
    raw = (
        F.when(v == 0, F.concat(F.lit("RSUD "), p)).when(v == 1, F.concat(F.lit("RS. "), p, F.lit(" Hospital"))).when(v == 2, F.concat(F.lit("Rumah Sakit Umum Daerah  "), p))
        .when(v == 3, F.concat(F.lit("dr. "), p, F.lit(", Sp.KK"))).when(v == 4, F.concat(F.lit("Prof. Dr. dr. "), p, F.lit(", Sp. D.V(K)"))).otherwise(F.concat(F.upper(p), F.lit(" - Clinic,  Sp.PK, Sp.KKLP")))
    )
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), raw.alias("raw"))


def schedule_texts(spark: SparkSession, d: str) -> DataFrame:
    a = timeparse.clock((F.hour("ts") * 60 + F.minute("ts")).cast("int"))
    b = timeparse.clock(((F.hour("ts") * 60 + F.minute("ts") + 90) % 1440).cast("int"))
    v = F.col("event_id") % 8
    t = (
        F.when(v == 0, F.concat(a, F.lit(" - "), b)).when(v == 1, F.concat(a, F.lit("-"), b, F.lit(" dan "), b, F.lit("-"), a)).when(v == 2, F.concat(a, F.lit(" - selesai")))
        .when(v == 3, F.lit("Dengan Perjanjian")).when(v == 4, F.concat(a, F.lit("-"), b, F.lit(" "), b, F.lit("-"), a)).when(v == 5, F.lit("  ")).when(v == 6, F.concat(F.translate(a, ":", "."), F.lit(" s/d "), F.translate(b, ":", "."))).otherwise(F.concat(a, F.lit(" dan tutup")))
    )
    w = F.col("event_id") % 5
    names = F.array(*[F.lit(x) for x in ("Senin", "selasa", "Rabu", "KAMIS", "Jum'at", "sabtu", "minggu")])
    english = F.array(*[F.lit(x) for x in ("Monday", "tuesday", "Wed", "Thursday", "friday", "Saturday", "sunday")])
    i = (F.col("event_id") % 7).cast("int")
    day = F.when(w == 0, F.get(names, i)).when(w == 1, F.get(english, i)).when(w == 2, F.substring(F.get(names, i), 1, 3)).when(w == 3, (i + 1).cast("string")).otherwise("??")
    source = F.when(F.col("event_id") % 3 == 0, "siloam").when(F.col("event_id") % 3 == 1, "emc").otherwise("other")
    return read(spark, d, "events").select("event_id", "user_id", t.alias("text"), day.alias("day_text"), source.alias("source"))


def s01_facility_names(spark, d):
    return raw_names(spark, d).select("id", tx.facility_name(F.col("raw")).alias("name"))


def s02_person_keys(spark, d):
    return raw_names(spark, d).select("id", tx.person_key(F.col("raw")).alias("person"))


def s14_specialists(spark, d):
    return raw_names(spark, d).select("id", tx.is_specialist(F.col("raw")).alias("specialist"))


def s04_same_person(spark, d):
    n = raw_names(spark, d).select("id", tx.person_key(F.col("raw")).alias("k"))
    m = n.select((F.col("id") + 1).alias("id"), F.col("k").alias("k2"))
    return n.join(m, "id").select("id", tx.same_person(F.col("k"), F.col("k2")).alias("s")).select("id", "s.is_match", "s.confidence", "s.reason")


def s07_similarity(spark, d):
    n = raw_names(spark, d).select("id", F.lower("raw").alias("a"))
    m = n.select((F.col("id") + 6).alias("id"), F.col("a").alias("b"))
    a, b = F.col("a"), F.col("b")
    return n.join(m, "id").select("id", rounded(similarity.many_ratios(a, b), 4).alias("ratio"), rounded(similarity.many_scores(a, b), 4).alias("score"))


def t01_days(spark, d):
    return schedule_texts(spark, d).select("event_id", timeparse.day_of(F.col("source"), F.col("day_text")).alias("day"))


def t03_time_ranges(spark, d):
    got = schedule_texts(spark, d).select("event_id", F.posexplode(timeparse.time_ranges(F.col("text"))).alias("n", "s"))
    return got.select("event_id", "n", "s.start_time", "s.end_time", "s.confidence")


def t06_structured(spark, d):
    """Structured entries: no day or a missing time is low, numbers are written as HH:MM."""
    e = read(spark, d, "events")
    hour, minute = F.hour("ts"), F.when(F.col("event_id") % 9 != 0, F.minute("ts"))
    day = timeparse.day_number(F.lit("brawijaya"), (F.col("event_id") % 8).cast("int"))
    start = timeparse.split_clock(hour, minute)
    end = F.when(F.col("event_id") % 4 != 0, timeparse.prefix_clock(F.concat(hour.cast("string"), F.lit(":59:00"))))
    conf = F.when(day.isNull() | start.isNull() | end.isNull(), "low").otherwise("high")
    return e.select("event_id", day.alias("day"), F.when(day.isNotNull(), start).alias("start_time"), F.when(day.isNotNull(), end).alias("end_time"), timeparse.capped(conf).alias("confidence"))


def f04_weekly_pattern(spark, d):
    s = schedule_texts(spark, d).select("event_id", F.col("user_id").alias("record"), timeparse.day_of(F.col("source"), F.col("day_text")).alias("day"), F.explode(timeparse.time_ranges(F.col("text"))).alias("s"))
    rows = s.select("record", F.col("event_id").alias("position"), "day", "s.start_time", "s.end_time")
    return matching.weekly_pattern(rows).select("record", "position", "day", "start_time", "end_time")


def f03_first_wins(spark, d):
    e = read(spark, d, "events").select("user_id", "event_type", "event_id")
    return matching.first_wins(e, ["user_id", "event_type"], "event_id")


def a17_last_write_wins(spark, d):
    o = read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return payloads.last_write_wins(o, "o_custkey", ["o_orderkey"])


def _payload(spark, d, shape: str) -> DataFrame:
    e = read(spark, d, "events").select(F.col("event_id").alias("record"), F.col("event_type").alias("t"), (F.col("user_id") % 4).cast("string").alias("u"))
    if shape == "map":
        j = F.concat(F.lit('{"RS '), F.col("u"), F.lit('":{"'), F.col("t"), F.lit('":[{"day":"Senin","from_time":"08:00","to_time":"10:00"},{"day":"Rabu","from_time":"13:00","to_time":null}]}}'))
    elif shape == "clinics":
        j = F.concat(F.lit('[{"hospital":"RS '), F.col("u"), F.lit('","clinics":[{"clinic_name":"'), F.col("t"), F.lit('","schedules":[{"day":"Jumat","time_from":"09:00","time_to":"11:30"}]},{"clinic_name":"none","schedules":[]}]}]'))
    else:
        j = F.concat(F.lit('[{"polyclinic_name":"'), F.col("t"), F.lit('","hospitals":[{"hospital_name":"RS '), F.col("u"), F.lit('","schedules":[{"day":"Kamis","shifts":[{"start_time":"07:00","end_time":"09:00"},{"start_time":"15:00","end_time":"17:00"}]}]}]}]'))
    return e.select("record", F.when(F.col("record") % 50 == 0, F.lit("{broken")).otherwise(j).alias("payload"))


def j03_nested_map(spark, d):
    return payloads.nested_map(_payload(spark, d, "map"))


def j04_nested_clinics(spark, d):
    return payloads.nested_clinics(_payload(spark, d, "clinics"))


def j05_nested_shifts(spark, d):
    return payloads.nested_shifts(_payload(spark, d, "shifts"))


def j01_branch_names(spark, d):
    parts = [_payload(spark, d, s).select("record", F.lit(s).alias("source"), F.array_join(payloads.branch_names(F.lit(s), F.col("payload")), "|").alias("branches")) for s in ("map", "clinics", "shifts")]
    return parts[0].union(parts[1]).union(parts[2])


def j06_html_items(spark, d):
    return html.extract(read(spark, d, "pages"), "page_id").filter("kind IN ('a', 'title', 'h1', 'td', 'th', 'option')")


def a16_page_links(spark, d):
    p = read(spark, d, "pages")
    return p.select("page_id", F.array_join(F.transform(payloads.page_numbers(F.concat("url", "html")), lambda x: x.cast("string")), ",").alias("pages"))


def s17_url_parts(spark, d):
    p = read(spark, d, "pages")
    return p.select("page_id", F.regexp_extract("url", r"[?&]page=(\d+)", 1).alias("page"), F.regexp_extract(F.regexp_replace("url", r"[?#].*$", ""), r"([^/]+)/?$", 1).alias("slug"))


def s12_composite_keys(spark, d):
    s = read(spark, d, "supplier")
    k = F.col("s_suppkey")
    raw = F.when(k % 3 == 0, F.concat_ws("|", "s_name", (k / F.lit(8.0)).cast("string"), (k / F.lit(4.0)).cast("string"))).when(k % 3 == 1, F.concat_ws("|", "s_name", F.lit("x"), F.lit("1.5"))).otherwise(F.col("s_name"))
    return s.select(k.alias("id"), tx.composite_key(raw).alias("c")).filter("c IS NOT NULL").select("id", "c.name", "c.lat", "c.lon")


QUERIES = {f.__name__: f for f in (s01_facility_names, s02_person_keys, s14_specialists, s04_same_person, s07_similarity, t01_days, t03_time_ranges, t06_structured, f04_weekly_pattern, f03_first_wins, a17_last_write_wins, j03_nested_map, j04_nested_clinics, j05_nested_shifts, j01_branch_names, j06_html_items, a16_page_links, s17_url_parts, s12_composite_keys)}

_RAW = """raw_names AS (SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'RSUD ' || p_name WHEN 1 THEN 'RS. ' || p_name || ' Hospital' WHEN 2 THEN 'Rumah Sakit Umum Daerah  ' || p_name
  WHEN 3 THEN 'dr. ' || p_name || ', Sp.KK' WHEN 4 THEN 'Prof. Dr. dr. ' || p_name || ', Sp. D.V(K)' ELSE upper(p_name) || ' - Clinic,  Sp.PK, Sp.KKLP' END AS raw FROM part)"""
_CLEAN = r"trim(regexp_replace(regexp_replace({}, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_NAME = _CLEAN.format(r"regexp_replace(regexp_replace(lower(trim(raw)), '^(?:rumah sakit umum daerah|rumah sakit umum pusat|rumah sakit umum|rumah sakit khusus|rumah sakit ibu dan anak|rumah sakit|rsud|rsup|rsia|rsu|rs)\b\.?\s*', ''), '\bhospitals?\b', ' ', 'g')")
_PERSON = "lower(" + _CLEAN.format(r"regexp_replace(trim(split_part(trim(raw), ',', 1)), '(?i)^(?:(?:prof|dr|rd)\.?\s*)+', '')") + ")"
_TEXTS = """texts AS (SELECT event_id, user_id, strftime(ts, '%H:%M') AS a, strftime(ts + INTERVAL 90 MINUTE, '%H:%M') AS b,
    CASE event_id % 3 WHEN 0 THEN 'siloam' WHEN 1 THEN 'emc' ELSE 'other' END AS source,
    CASE event_id % 5 WHEN 0 THEN ['Senin', 'selasa', 'Rabu', 'KAMIS', 'Jum''at', 'sabtu', 'minggu'][event_id % 7 + 1] WHEN 1 THEN ['Monday', 'tuesday', 'Wed', 'Thursday', 'friday', 'Saturday', 'sunday'][event_id % 7 + 1]
      WHEN 2 THEN ['Sen', 'sel', 'Rab', 'KAM', 'Jum', 'sab', 'min'][event_id % 7 + 1] WHEN 3 THEN (event_id % 7 + 1)::VARCHAR ELSE '??' END AS day_text,
    CASE event_id % 5 WHEN 0 THEN event_id % 7 WHEN 1 THEN CASE WHEN event_id % 7 = 2 THEN NULL ELSE event_id % 7 END WHEN 2 THEN event_id % 7
      WHEN 3 THEN CASE event_id % 3 WHEN 0 THEN event_id % 7 WHEN 1 THEN CASE WHEN event_id % 7 < 6 THEN event_id % 7 END END END::INTEGER AS day
  FROM events),
ranges AS (SELECT event_id, user_id, day, x.n, x.start_time, x.end_time, x.confidence FROM (SELECT *, unnest(CASE event_id % 8
    WHEN 0 THEN [{'n': 0, 'start_time': a, 'end_time': b, 'confidence': 'high'}]
    WHEN 1 THEN [{'n': 0, 'start_time': a, 'end_time': b, 'confidence': 'high'}, {'n': 1, 'start_time': b, 'end_time': a, 'confidence': 'high'}]
    WHEN 2 THEN [{'n': 0, 'start_time': a, 'end_time': NULL, 'confidence': 'high'}] WHEN 3 THEN [{'n': 0, 'start_time': NULL, 'end_time': NULL, 'confidence': 'medium'}]
    ELSE [{'n': 0, 'start_time': NULL, 'end_time': NULL, 'confidence': 'low'}] END) AS x FROM texts))"""
_U = "(user_id % 4)::VARCHAR"

ORACLES = {
    "s01_facility_names": f"WITH {_RAW} SELECT id, {_NAME} AS name FROM raw_names",
    "s02_person_keys": f"WITH {_RAW} SELECT id, {_PERSON} AS person FROM raw_names",
    "s14_specialists": rf"WITH {_RAW} SELECT id, regexp_matches(raw, '(?i)(^|[^a-z])sp\.?\s*(k\.?\s*k|d\.?\s*v(\.?\s*e)?)(\s*\(k\))?([^a-z]|$)|dermatologi dan venereologi|dermatovenereologi|kulit dan kelamin|dermatology') AS specialist FROM raw_names",
    "s04_same_person": f"""WITH {_RAW}, k AS (SELECT id, {_PERSON} AS k FROM raw_names),
      p AS (SELECT x.id, x.k AS a, y.k AS b, string_split(x.k, ' ') AS ta, string_split(y.k, ' ') AS tb FROM k x JOIN k y ON x.id = y.id + 1),
      s AS (SELECT *, len(list_filter(list_intersect(ta, tb), lambda t: length(t) >= 3)) AS n FROM p)
      SELECT id, CASE WHEN a = b THEN true WHEN len(ta) < 2 OR len(tb) < 2 THEN false ELSE n >= 2 END AS is_match,
        CASE WHEN a = b THEN 'high' WHEN len(ta) < 2 OR len(tb) < 2 THEN NULL WHEN n >= 2 THEN 'medium' WHEN n = 1 THEN 'low' END AS confidence,
        CASE WHEN a = b THEN 'equal' WHEN len(ta) < 2 OR len(tb) < 2 THEN 'one token' WHEN n >= 2 THEN 'shared tokens' WHEN n = 1 THEN 'one shared token' ELSE 'different' END AS reason FROM s""",
    "s07_similarity": f"""WITH RECURSIVE {_RAW}, n AS (SELECT id, lower(raw) AS a FROM raw_names), w AS (SELECT x.id, x.a, y.a AS b FROM n x JOIN n y ON x.id = y.id + 6),
      st AS (SELECT *, array_to_string(list_sort(list_filter(regexp_split_to_array(trim(a), '\\s+'), lambda t: t <> '')), ' ') AS sa, array_to_string(list_sort(list_filter(regexp_split_to_array(trim(b), '\\s+'), lambda t: t <> '')), ' ') AS sb FROM w),
      u AS (SELECT id, 0 AS k, a AS x, b AS y FROM st UNION ALL SELECT id, 1, sa, sb FROM st),
      lcs(id, k, x, y, i, r) AS (SELECT id, k, x, y, 0, list_transform(range(length(y)), lambda j: 0::BIGINT) FROM u
        UNION ALL SELECT id, k, x, y, i + 1, list_transform(range(1, length(y) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda q: CASE WHEN x[i + 1] = y[q] THEN (CASE WHEN q = 1 THEN 0 ELSE r[q - 1] END) + 1 ELSE r[q] END))) FROM lcs WHERE i < length(x)),
      f AS (SELECT id, k, 200.0::DOUBLE * r[-1] / (length(x) + length(y)) AS s FROM lcs WHERE i = length(x))
      SELECT id, decimals(max(CASE WHEN k = 0 THEN s END), 4) AS ratio, decimals(min(s), 4) AS score FROM f GROUP BY 1""",
    "t01_days": f"WITH {_TEXTS} SELECT event_id, day FROM texts",
    "t03_time_ranges": f"WITH {_TEXTS} SELECT event_id, n, start_time, end_time, confidence FROM ranges",
    "t06_structured": """WITH e AS (SELECT event_id, hour(ts) AS h, CASE WHEN event_id % 9 <> 0 THEN minute(ts) ELSE 0 END AS m, CASE WHEN event_id % 8 BETWEEN 1 AND 6 THEN (event_id % 8 - 1)::INTEGER END AS day FROM events),
      f AS (SELECT event_id, day, CASE WHEN day IS NOT NULL THEN printf('%02d:%02d', h, m) END AS start_time, CASE WHEN day IS NOT NULL AND event_id % 4 <> 0 THEN printf('%02d:59', h) END AS end_time FROM e)
      SELECT event_id, day, start_time, end_time, CASE WHEN day IS NULL OR end_time IS NULL THEN 'low' ELSE 'medium' END AS confidence FROM f""",
    "f04_weekly_pattern": f"""WITH {_TEXTS}, s AS (SELECT user_id AS record, event_id AS position, day, start_time, end_time FROM ranges)
      SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY record, day, start_time, end_time ORDER BY position) AS rn FROM s WHERE day IS NOT NULL) WHERE rn = 1 UNION ALL SELECT * FROM s WHERE day IS NULL""",
    "f03_first_wins": "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL",
    "a17_last_write_wins": "SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1",
    "j03_nested_map": f"SELECT event_id AS record, 'RS ' || {_U} AS branch, event_type AS clinic, x.d AS day_text, x.f AS start_text, x.t AS end_text FROM (SELECT *, unnest([{{'d': 'Senin', 'f': '08:00', 't': '10:00'}}, {{'d': 'Rabu', 'f': '13:00', 't': NULL}}]) AS x FROM events WHERE event_id % 50 <> 0)",
    "j04_nested_clinics": f"SELECT event_id AS record, 'RS ' || {_U} AS branch, x.c AS clinic, x.d AS day_text, x.f AS start_text, x.t AS end_text FROM (SELECT *, unnest([{{'c': event_type, 'd': 'Jumat', 'f': '09:00', 't': '11:30'}}, {{'c': 'none', 'd': NULL, 'f': NULL, 't': NULL}}]) AS x FROM events WHERE event_id % 50 <> 0)",
    "j05_nested_shifts": f"SELECT event_id AS record, 'RS ' || {_U} AS branch, event_type AS clinic, 'Kamis' AS day_text, x.f AS start_text, x.t AS end_text FROM (SELECT *, unnest([{{'f': '07:00', 't': '09:00'}}, {{'f': '15:00', 't': '17:00'}}]) AS x FROM events WHERE event_id % 50 <> 0)",
    "j01_branch_names": f"SELECT event_id AS record, s AS source, CASE WHEN event_id % 50 = 0 THEN '' ELSE 'RS ' || {_U} END AS branches FROM events, (VALUES ('map'), ('clinics'), ('shifts')) v(s)",
    "a16_page_links": r"SELECT page_id, coalesce(array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(url || html, '[?&]page=(\d+)', 1), lambda x: x::INTEGER))), ','), '') AS pages FROM pages",
    "s17_url_parts": r"SELECT page_id, regexp_extract(url, '[?&]page=(\d+)', 1) AS page, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]+)/?$', 1) AS slug FROM pages",
    "s12_composite_keys": "SELECT s_suppkey AS id, s_name AS name, s_suppkey / 8.0::DOUBLE AS lat, s_suppkey / 4.0::DOUBLE AS lon FROM supplier WHERE s_suppkey % 3 = 0",
}
