"""The streaming ingest against the same rows as a batch."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from rosterlake.streaming import ingest

SCHEMA = "ts timestamp, record long, facility long, practitioner long, day int, start_min int, end_min int, confidence string"


def test_duplicates_and_windows(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(minutes=10 * i), i % 7, i % 3, i % 5, i % 7, 480 + 30 * (i % 4), 600, "high" if i % 6 else "low") for i in range(60)]
    again = [(r[0] + timedelta(minutes=1), *r[1:]) for r in rows]
    df = spark.createDataFrame(rows + again, SCHEMA)
    df.orderBy("ts").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = ingest.new_sessions(ingest.read_events(spark, f"{tmp_path}/in", SCHEMA), "1 day")
    q = stream.writeStream.format("memory").queryName("fresh").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    fresh = spark.table("fresh")
    assert fresh.count() == df.select("record", "day", "start_min", "end_min").distinct().count()
    batch = ingest.supply_by_window(df.filter("confidence <> 'low'"))
    assert batch.agg(F.sum("sessions")).first()[0] == df.filter("confidence <> 'low'").count()
