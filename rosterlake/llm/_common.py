"""Shared helpers of the training-data operators: table access, durable intermediates, word splitting."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_SHIPPED: set[str] = set()
_HELD: list = []


def load(spark: SparkSession, sf_dir: str, table: str, spread: bool = False) -> DataFrame:
    """A table; with spread, one of fewer splits than cores is dealt out over them (a layout for small
    files in few row groups; larger tables keep their splits)."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if spread and df.rdd.getNumPartitions() < cores else df


def ship(spark: SparkSession) -> None:
    """Let executors import this package where neither PYTHONPATH nor the working folder has it."""
    app = spark.sparkContext.applicationId
    on_path = _ROOT in os.environ.get("PYTHONPATH", "").split(os.pathsep) or os.getcwd() == _ROOT
    if on_path or app in _SHIPPED:
        return
    into = tempfile.mkdtemp()
    spark.sparkContext.addPyFile(shutil.make_archive(f"{into}/rosterlake", "zip", _ROOT, "rosterlake"))
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a private one only on a local master without one."""
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


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/rosterlake/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, by Spark's own file systems."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a frame that stored() returned, once nothing reads it any more."""
    files = df.inputFiles()
    if files:
        remove(df.sparkSession, files[0].rsplit("/", 1)[0])


def held_out(column: str, modulus: int, remainder: int = 2):
    """crc32 of the id as text, modulo modulus, equals remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus == remainder


def words(text: bytes | None) -> list[bytes]:
    """Lower-cases A-Z and splits on the six ASCII white-space bytes; null text has no words."""
    return text.lower().split() if text else []


def parts(b: pa.RecordBatch, column: int, bytes_at_once: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about so many bytes of a text or binary column, a row at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < b.num_rows:
        hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + bytes_at_once, side="right")))
        yield b.slice(lo, hi - lo)
        lo = hi


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """make()'s value, kept in a worker process for later tasks until another key is asked for.

    Workers outlive a stage, so a model's caches would lie beside those of the next operator. Only one
    value is kept, and the memory of the last one goes back to the system first.
    """
    if not _HELD or _HELD[0] != key:
        release()
        _HELD[:] = [key, make()]
    return _HELD[1]


def release() -> None:
    """Drop what held() keeps and give free memory back to the system, where its C library can."""
    _HELD.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
