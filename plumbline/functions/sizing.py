"""Local relations, a shared working folder, and lineage cuts that survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def local_frame(spark: SparkSession, columns: dict[str, tuple[pa.DataType, list]]) -> DataFrame:
    """A small local relation.  Callers hold one row per column of a table, never data rows."""
    arrays = [pa.array(values, type=kind) for kind, values in columns.values()]
    return spark.createDataFrame(pa.table(arrays, names=list(columns)))


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``.

    Outside a cluster an unset setting falls back to a temporary folder; on a cluster it
    is an error, because a machine-local folder is lost with its machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/plumbline-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: fixed contents, short lineage."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000) -> Iterator[None]:
    """Tables settled inside go to Python in batches of at most so many rows: long texts are held twice on their way."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= rows:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of a table; no data is read."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def ratio(top: Column, bottom: Column) -> Column:
    """Division that gives NULL for a zero denominator."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))
