"""Domain tables derived from the star-schema tables, and the same definitions as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def facility(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "nation")
    k = F.col("s_suppkey")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(
        k.alias("id"), F.col("s_name").alias("name"), F.when(F.col("s_nationkey") % 3 != 0, F.col("n_name")).alias("grp"),
        F.when(k % 3 == 0, "swasta").when(k % 3 == 1, "pemerintah").alias("ownership"),
        (F.lit(-6.8) + (k * 37 % 91) / F.lit(100.0)).alias("lat"), (F.lit(106.3) + (k * 53 % 101) / F.lit(100.0)).alias("lon"),
        F.when((k > 0) & (k % 29 == 0), k - 1).alias("duplicate_of"), F.concat(F.lit("KOTA "), F.col("n_regionkey")).alias("city"),
        (k % 4 == 1).alias("preferred"),
    )


def session(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    n = read(spark, sf_dir, "supplier").count()  # from the file's footer; a constant of the plan
    start = (F.hour("ts") * 60 + F.minute("ts")).cast("int")
    end = F.when(~((F.col("event_type") == "error") & (F.col("event_id") % 2 == 0)), start + F.floor("value").cast("int"))
    conf = F.when((F.col("event_type") == "error") & (F.col("event_id") % 3 == 0), "low").when(F.col("event_type") == "view", "medium").otherwise("high")
    return (
        e.withColumn("facility", F.col("user_id") % F.lit(n)).filter(F.col("facility") % 11 != 0)
        .select("event_id", "facility", F.col("user_id").alias("practitioner"), F.weekday("ts").alias("day"), start.alias("start_min"), end.alias("end_min"), conf.alias("confidence"))
    )


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered practitioners: those with sessions, and one without where the id is a multiple of 7."""
    with_sessions = session(spark, sf_dir).select("facility", "practitioner").distinct()
    extra = facility(spark, sf_dir).filter("id % 7 = 0").select(F.col("id").alias("facility"), (-F.col("id")).alias("practitioner"))
    return with_sessions.union(extra)


def person_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, p = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    links = li.select("l_suppkey", "l_partkey").distinct()
    return links.join(p, links.l_partkey == p.p_partkey).select(F.col("l_suppkey").alias("facility"), F.col("p_name").alias("person")).distinct()


VIEWS = """
facility AS (
  SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_nationkey % 3 <> 0 THEN n_name END AS grp,
    CASE s_suppkey % 3 WHEN 0 THEN 'swasta' WHEN 1 THEN 'pemerintah' END AS ownership,
    -6.8::DOUBLE + (s_suppkey * 37 % 91) / 100.0::DOUBLE AS lat, 106.3::DOUBLE + (s_suppkey * 53 % 101) / 100.0::DOUBLE AS lon,
    CASE WHEN s_suppkey > 0 AND s_suppkey % 29 = 0 THEN s_suppkey - 1 END AS duplicate_of, 'KOTA ' || n_regionkey AS city,
    s_suppkey % 4 = 1 AS preferred
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
session AS (
  SELECT event_id, user_id % n AS facility, user_id AS practitioner, (isodow(ts) - 1)::INTEGER AS day,
    (hour(ts) * 60 + minute(ts))::INTEGER AS start_min,
    CASE WHEN NOT (event_type = 'error' AND event_id % 2 = 0) THEN (hour(ts) * 60 + minute(ts) + floor(value)::INTEGER)::INTEGER END AS end_min,
    CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'low' WHEN event_type = 'view' THEN 'medium' ELSE 'high' END AS confidence
  FROM events, (SELECT count(*) AS n FROM supplier) WHERE (user_id % n) % 11 <> 0),
roster AS (
  SELECT DISTINCT facility, practitioner FROM session
  UNION ALL SELECT id, -id FROM facility WHERE id % 7 = 0),
person_link AS (
  SELECT DISTINCT l_suppkey AS facility, p_name AS person FROM lineitem JOIN part ON l_partkey = p_partkey),
usable AS (SELECT * FROM session WHERE confidence <> 'low' AND day IS NOT NULL AND start_min IS NOT NULL),
cells AS (
  SELECT DISTINCT facility, day, (t - 420) // 30 AS slot, practitioner
  FROM (SELECT *, unnest(range(greatest(start_min, 420), least(coalesce(end_min, start_min + 30), 1260), 30)) AS t FROM usable)),
grid AS (SELECT d.d::INTEGER AS day, s.s::BIGINT AS slot FROM range(7) d(d), range(28) s(s)),
prime AS (SELECT * FROM grid WHERE (day <= 4 AND slot BETWEEN 20 AND 27) OR (day = 5 AND slot BETWEEN 2 AND 13)),
weekend AS (SELECT * FROM grid WHERE day >= 5)
"""


def sql(body: str) -> str:
    """A statement over the domain tables."""
    return f"WITH {VIEWS} {body}"


def with_decimals(statement: str) -> str:
    """decimals(x, n) in a statement, as the exact decimal text of the binary value, cut to n places and read again."""
    while (at := statement.find("decimals(")) >= 0:
        depth, end = 1, at + len("decimals(")
        while depth:
            depth += {"(": 1, ")": -1}.get(statement[end], 0)
            end += 1
        x, n = statement[at + len("decimals(") : end - 1].rsplit(",", 1)
        statement = f"{statement[:at]}format('{{:.{int(n)}f}}', ({x})::DOUBLE)::DOUBLE{statement[end:]}"
    return statement
