"""One entry point for every kind of source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.sources import databases, excel, files

SUPPORTED = ("csv", "excel", "snowflake", "oracle", "hdfs")


def supported_types() -> list[str]:
    return list(SUPPORTED)


def read_source(spark: SparkSession, kind: str, **options) -> DataFrame:
    """Read ``csv``, ``excel``, ``snowflake``, ``oracle`` or ``hdfs``; required options are checked."""
    kind = kind.lower()
    if kind in ("csv", "excel", "hdfs"):
        path = options.pop("path", None)
        if not path:
            raise ValueError(f"path is required for {kind}")
        if kind == "csv":
            return files.read_csv(spark, path, **options)
        if kind == "excel":
            return excel.read_sheet(spark, path, **options)
        return files.read_file(spark, path, **options)
    load = {k: options.pop(k) for k in ("table", "query", "limit") if k in options}
    if kind == "snowflake":
        return databases.read_database(spark, "snowflake", databases.snowflake_options(**options), **load)
    if kind == "oracle":
        split = options.pop("split", {})
        if split and "query" in load:  # the reader takes split options only with a table or a bracketed query
            load["table"] = f"({load.pop('query')}) split_query"
        return databases.read_database(spark, "jdbc", {**databases.oracle_options(**options), **split}, **load)
    raise ValueError(f"unsupported source type: {kind}")
