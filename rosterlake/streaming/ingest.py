"""Sessions as a stream: new payload files become deduplicated sessions and running supply.

The batch operators are pure functions of DataFrames, so the same expressions serve both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.operators import coverage


def read_events(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """Event files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def new_sessions(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """A session once per (record, day, start, end) within the lateness bound.

    events: ts timestamp, record, facility, practitioner, day, start_min, end_min, confidence.
    """
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["record", "day", "start_min", "end_min"])


def supply_by_window(sessions: DataFrame, width: str = "1 hour") -> DataFrame:
    """Usable sessions and minutes per facility and time window; a window is given once it is closed."""
    length = F.greatest(F.col("end_min") - F.col("start_min"), F.lit(0))
    return coverage.usable(sessions).groupBy(F.window("ts", width), "facility").agg(F.count("*").alias("sessions"), F.sum(length).alias("minutes")).select(F.col("window.start").alias("start"), "facility", "sessions", "minutes")
