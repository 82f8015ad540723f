"""Quality metrics of a stream, and rows outside a saved baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.functions.columns import as_double, is_missing
from plumbline.functions.sizing import ratio
from plumbline.operators.anomaly import Spread, Thresholds, score


def window_metrics(stream: DataFrame, time_column: str, value: str, width: str = "1 hour",
                   lateness: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Rows, completeness, mean and spread of ``value`` per time window.

    State is one small row per open window; the watermark closes windows and drops late rows.
    """
    field = stream.schema[value]
    shaped = stream.select(F.col(time_column).cast("timestamp").alias("__ts"), as_double(field).alias("__v"),
                           is_missing(field).alias("__missing"))
    return shaped.withWatermark("__ts", lateness).groupBy(F.window("__ts", width, slide)).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("__missing").alias("missing"),
        F.avg("__v").alias("mean"), F.stddev_samp("__v").alias("std"),
        F.min("__v").alias("min_value"), F.max("__v").alias("max_value"),
    ).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "rows",
             (ratio(F.col("rows") - F.col("missing"), F.col("rows")) * 100).alias("completeness"),
             "mean", "std", "min_value", "max_value")


def flag_outside(stream: DataFrame, baseline: list[Spread], methods=("zscore", "iqr"),
                 limits: Thresholds = Thresholds()) -> DataFrame:
    """Rows beyond the saved statistics of any column: the row, the columns and the methods.

    Stateless; the baseline enters as literals, so the stream is only filtered.
    """
    hits = []
    for s in baseline:
        value = as_double(stream.schema[s.column])
        for m in methods:
            expr = score(value, s, m, limits)
            if expr is not None:
                hits.append(F.when(expr.isNotNull(), F.struct(
                    F.lit(s.column).alias("column_name"), F.lit(m).alias("method"), value.alias("value"),
                    expr.alias("score"))))
    if not hits:
        raise ValueError("the baseline has no usable statistics")
    some = hits[0].isNotNull()
    for h in hits[1:]:
        some = some | h.isNotNull()
    return stream.where(some).withColumn("findings", F.array_compact(F.array(*hits)))


def run_to_files(frame: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is available into Parquet files, exactly once, and stop."""
    return (frame.writeStream.outputMode(mode).format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def read_table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder as a stream with the schema of its files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)
