"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a private folder only on a local master without one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="rosterlake-")
        atexit.register(shutil.rmtree, _LOCAL[app], True)
    return f"file://{_LOCAL[app]}"


def stored(df: DataFrame) -> DataFrame:
    """df written once and read back: cuts lineage and keeps its rows when executors are lost."""
    path = f"{folder(df.sparkSession)}/rosterlake/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
