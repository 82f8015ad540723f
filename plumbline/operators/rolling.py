"""Centred rolling z-score over an ordered series.

A window without a partition key would sort the whole series in one task, and a hot series
key would do the same to a third of it.  Above a checked size the rows are therefore range
partitioned by (series, order), numbered by their place in that order, and cut into blocks
of equal length; each block also receives the few neighbouring rows its edge windows need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from plumbline.functions.columns import as_double
from plumbline.functions.sizing import ratio, settle

SINGLE_WINDOW_ROWS = 200_000
BLOCK_ROWS = 100_000
BROADCAST_SERIES = 100_000  # beyond it lengths are joined by a shuffle that adaptive execution splits


def frame(window: int) -> tuple[int, int]:
    """(rows before, rows after) of a centred window; an even one looks back one row more."""
    after = (window - 1) // 2
    return window - 1 - after, after


def rolling_zscore(df: DataFrame, value: str, order_cols: list[str], series_cols: list[str] = (),
                   window: int = 10, keep: list[str] = (), single_window_rows: int | None = None,
                   block_rows: int | None = None) -> DataFrame:
    """Every row with rolling_mean, rolling_std and z; z is NULL where undefined.

    A window needs ``window`` present values; a series shorter than two windows has none; a
    window without spread has none.  ``order_cols`` must order each series uniquely.
    """
    limit = SINGLE_WINDOW_ROWS if single_window_rows is None else single_window_rows
    block = max(BLOCK_ROWS if block_rows is None else block_rows, window)
    series = list(series_cols)
    names = [*series, *order_cols, *[k for k in keep if k not in series and k not in order_cols]]
    slim = df.select(*[F.col(c) for c in names], as_double(df.schema[value]).alias("__v"))
    if slim.count() <= limit:
        measured = _measure(slim, series, [F.col(c) for c in order_cols], window)
        lengths = F.count(F.lit(1)).over(W.partitionBy(*series)) if series else F.count(F.lit(1)).over(W.partitionBy())
        measured = measured.withColumn("__len", lengths)
    else:
        measured = _measure(_blocks(slim, series, list(order_cols), window, block),
                            [*series, "__block"], [F.col("__at")], window).where("__own")
        sizes = slim.groupBy(*series).agg(F.count(F.lit(1)).alias("__len"))
        if series:
            # one row per series: broadcast when they are few, so a hot series never meets in one task
            lengths = settle(sizes.select(*[F.col(c).alias(f"__{c}") for c in series], "__len"))
            lengths = F.broadcast(lengths) if lengths.count() <= BROADCAST_SERIES else lengths
            same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in series]
            measured = measured.join(lengths, same)
        else:
            measured = measured.crossJoin(F.broadcast(sizes))  # one row
    # a window that holds an infinite value has no finite spread and no score
    ok = (F.abs("__std") < float("inf")) & (F.col("__n") == window) & (F.col("__len") >= 2 * window)
    z = F.abs(ratio(F.col("__v") - F.col("__mean"), F.col("__std")))
    return measured.select(*names, F.col("__v").alias(value),
                           F.when(ok, F.col("__mean")).alias("rolling_mean"),
                           F.when(ok, F.col("__std")).alias("rolling_std"), F.when(ok, z).alias("z"))


def _measure(df: DataFrame, by: list[str], order, window: int) -> DataFrame:
    before, after = frame(window)
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(-before, after)
    return df.withColumns({"__n": F.count("__v").over(w), "__mean": F.avg("__v").over(w),
                           "__std": F.stddev_samp("__v").over(w)})


def _blocks(df: DataFrame, series: list[str], order: list[str], window: int, block: int) -> DataFrame:
    before, after = frame(window)
    by = [*series, *order]
    ranged = df.repartitionByRange(*by).sortWithinPartitions(*by)
    # the written copy fixes partition numbers, so every later pass sees the same order
    fixed = settle(ranged.withColumn("__id", F.monotonically_increasing_id()))
    part, place = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = fixed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__rows"))
    # one row per partition; the running sum gives the place of each partition's first row
    offsets = sizes.select("__part", (F.sum("__rows").over(
        W.orderBy("__part").rowsBetween(W.unboundedPreceding, 0)) - F.col("__rows")).alias("__start"))
    placed = fixed.withColumn("__part", part).join(F.broadcast(offsets), "__part").withColumn(
        "__at", F.col("__start") + place).drop("__part", "__start", "__id")
    here = F.floor(F.col("__at") / block)
    offset = F.col("__at") - here * block
    copies = F.array_compact(F.array(
        F.struct(here.alias("b"), F.lit(True).alias("own")),
        F.when(offset < after, F.struct((here - 1).alias("b"), F.lit(False).alias("own"))),
        F.when(offset >= block - before, F.struct((here + 1).alias("b"), F.lit(False).alias("own")))))
    return placed.withColumn("__copy", F.explode(copies)).select(
        *df.columns, "__at", F.col("__copy.b").alias("__block"), F.col("__copy.own").alias("__own"))


def rolling_anomalies(df: DataFrame, value: str, order_cols: list[str], series_cols: list[str] = (),
                      window: int = 10, z_threshold: float = 2.0, keep: list[str] = (), **sizes) -> DataFrame:
    """Rows whose rolling z-score exceeds the threshold."""
    return rolling_zscore(df, value, order_cols, series_cols, window, keep, **sizes).where(
        F.col("z") > z_threshold)


def rolling_summary(scored: DataFrame, z_threshold: float = 2.0) -> DataFrame:
    """One row: rows with a valid z-score, anomalies among them, and their percentage."""
    return scored.agg(F.count("z").alias("valid_rows"),
                      F.count_if(F.col("z") > z_threshold).alias("total_anomalies")).withColumn(
        "anomaly_percentage", F.coalesce(ratio(F.col("total_anomalies"), F.col("valid_rows")) * 100, F.lit(0.0)))
