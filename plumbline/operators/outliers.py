"""Interquartile outliers for reports: per-column counts, bands, priorities, samples, plots.

Unlike the row detector there is no guard for a zero interquartile range: with equal
quartiles every other value counts as an outlier.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from plumbline.functions.columns import as_double, numeric_fields, outside
from plumbline.functions.sizing import local_frame, ratio
from plumbline.operators.profile import numeric_quantiles
from plumbline.operators.scan import TableStats, table_stats

# Upper ends of the rate bands, in percent, with their names and actions.
PRIORITIES = [(10, "Critical", "Immediate investigation required"),
              (5, "High", "Review and validate anomalies"),
              (1, "Medium", "Monitor and document patterns")]
LOWEST = ("Low", "Normal monitoring")
ASSESSMENTS = [(1, "Excellent", "Your data quality is excellent with minimal outliers."),
               (5, "Good", "Your data has some outliers that may need investigation."),
               (10, "Attention Needed", "Several anomalies detected that require attention.")]
WORST = ("Critical", "High number of anomalies detected - data quality review recommended.")
ACTIONS = {
    "critical": "Immediate Action Required: Critical anomaly levels detected - investigate data collection processes",
    "high": "High Priority: Review anomalies to determine if they represent valid edge cases or errors",
    "rate": "Process Review: High overall anomaly rate suggests reviewing data validation procedures",
    "spread": "Data Quality Audit: More than half of numeric columns have anomalies",
}


@dataclass(frozen=True)
class Fence:
    column: str
    lower: float
    upper: float
    q1: float
    q3: float


def fences(df: DataFrame, stats: TableStats, multiplier: float = 1.5, **sizes) -> list[Fence]:
    """Collected bounds of every numeric column with values."""
    found = []
    for name, (q1, q3) in numeric_quantiles(df, stats, [0.25, 0.75], **sizes).items():
        if q1 is not None:
            iqr = q3 - q1
            found.append(Fence(name, q1 - multiplier * iqr, q3 + multiplier * iqr, q1, q3))
    return found


def column_outliers(df: DataFrame, multiplier: float = 1.5, stats: TableStats | None = None,
                    all_columns: bool = False, **sizes) -> DataFrame:
    """Per numeric column with outliers: count, rate, bounds and statistics.

    ``all_columns`` keeps columns without outliers too.
    """
    stats = stats or table_stats(df, constants=False)
    rails = fences(df, stats, multiplier, **sizes)
    fields = {f.name: as_double(f) for f in numeric_fields(df)}
    counted = df.agg(F.array(*[F.struct(
        F.lit(r.column).alias("column_name"),
        F.count_if(outside(fields[r.column], r.lower, r.upper)).alias("outliers"),
    ) for r in rails]).cast("array<struct<column_name:string,outliers:bigint>>").alias("r"))
    f8, cols = pa.float64(), [stats.by_name(r.column) for r in rails]
    meta = local_frame(df.sparkSession, {
        "position": (pa.int32(), [c.position for c in cols]),
        "column_name": (pa.string(), [r.column for r in rails]),
        "total_rows": (pa.int64(), [stats.rows for _ in rails]),
        "data_points": (pa.int64(), [c.present for c in cols]),
        "lower_bound": (f8, [r.lower for r in rails]), "upper_bound": (f8, [r.upper for r in rails]),
        "mean": (f8, [c.mean for c in cols]), "std": (f8, [c.std for c in cols]),
        "min": (f8, [c.low for c in cols]), "max": (f8, [c.high for c in cols]),
        "q1": (f8, [r.q1 for r in rails]), "q3": (f8, [r.q3 for r in rails]),
        "iqr": (f8, [r.q3 - r.q1 for r in rails])})
    counts = counted.select(F.inline("r"))
    kept = counts if all_columns else counts.where(F.col("outliers") > 0)
    # both sides have one row per numeric column
    return kept.join(F.broadcast(meta), "column_name").select(
        "position", "column_name", "outliers", "total_rows",
        (ratio(F.col("outliers"), F.col("total_rows")) * 100).alias("rate"),
        "data_points", "lower_bound", "upper_bound",
        F.lit(f"Configurable IQR (threshold={multiplier})").alias("method"),
        "mean", "std", "min", "max", "q1", "q3", "iqr")


def _band(rate: Column, steps, rest, item: int) -> Column:
    expr = None
    for limit, *texts in steps:
        test = rate > limit
        expr = F.when(test, texts[item]) if expr is None else expr.when(test, texts[item])
    return expr.otherwise(rest[item])


def _low_band(rate: Column, steps, rest, item: int) -> Column:
    expr = None
    for limit, *texts in steps:
        test = rate < limit
        expr = F.when(test, texts[item]) if expr is None else expr.when(test, texts[item])
    return expr.otherwise(rest[item])


def outlier_priority(outliers: DataFrame) -> DataFrame:
    """Columns by outlier rate, highest first, with priority and action."""
    rate = F.col("rate")
    return outliers.select(
        "column_name", "outliers", "rate",
        _band(rate, PRIORITIES, LOWEST, 0).alias("priority"),
        _band(rate, PRIORITIES, LOWEST, 1).alias("action")).orderBy(F.desc("rate"), "column_name")


def outlier_overview(outliers: DataFrame, rows: int, numeric_columns: int) -> DataFrame:
    """One row: totals, rate over rows (all columns together), severity, assessment, reliability."""
    rate = F.col("rate")
    return outliers.agg(
        F.coalesce(F.sum("outliers"), F.lit(0)).alias("total_outliers"),
        F.count(F.lit(1)).alias("affected_columns"),
    ).withColumn("numeric_columns", F.lit(numeric_columns).cast("bigint")).withColumn(
        "rate", ratio(F.col("total_outliers"), F.lit(rows)) * 100
    ).withColumn(
        "severity", F.when(rate > 5, "High").when(rate > 1, "Medium").otherwise("Low")
    ).withColumn("assessment", _low_band(rate, ASSESSMENTS, WORST, 0)).withColumn(
        "message", _low_band(rate, ASSESSMENTS, WORST, 1)
    ).withColumn("reliability", F.greatest(F.lit(0.0), 100 - rate * 3))


def outlier_actions(outliers: DataFrame, rows: int, numeric_columns: int) -> DataFrame:
    """Recommended actions, most urgent first: rank, action."""
    facts = outliers.agg(
        F.coalesce(F.max("rate"), F.lit(0.0)).alias("worst"),
        F.coalesce(F.max((F.col("rate") > 5) & (F.col("rate") <= 10)), F.lit(False)).alias("high"),
        (ratio(F.coalesce(F.sum("outliers"), F.lit(0)), F.lit(rows)) * 100).alias("overall"),
        F.count(F.lit(1)).alias("affected"))
    tests = [(F.col("worst") > 10, "critical"), (F.col("high"), "high"), (F.col("overall") > 5, "rate"),
             (F.col("affected") > numeric_columns * 0.5, "spread")]
    return facts.select(F.inline(F.array_compact(F.array(*[
        F.when(test, F.struct(F.lit(i + 1).alias("rank"), F.lit(ACTIONS[key]).alias("action")))
        for i, (test, key) in enumerate(tests)]))))


def priority_counts(priorities: DataFrame) -> DataFrame:
    """One row: columns needing immediate attention and columns needing review."""
    return priorities.agg(F.count_if(F.col("priority") == "Critical").alias("critical_columns"),
                          F.count_if(F.col("priority") == "High").alias("high_columns"))


def outlier_rows(df: DataFrame, key_cols: list[str], multiplier: float = 1.5,
                 stats: TableStats | None = None, **sizes) -> DataFrame:
    """Every outlying cell: keys, column_name, value, direction, distance beyond the bound."""
    stats = stats or table_stats(df, constants=False)
    rails = fences(df, stats, multiplier, **sizes)
    fields = {f.name: as_double(f) for f in numeric_fields(df)}
    if not rails:
        return df.where(F.lit(False)).select(
            *[F.col(k) for k in key_cols], F.lit("").alias("column_name"), F.lit(0.0).alias("value"),
            F.lit("").alias("direction"), F.lit(0.0).alias("beyond"))
    tests = [outside(fields[r.column], r.lower, r.upper) for r in rails]
    some = F.lit(False)
    for test in tests:
        some = some | test
    parts = []
    for r, test in zip(rails, tests):
        v = fields[r.column]
        beyond = F.when(v < r.lower, r.lower - v).when(v > r.upper, v - r.upper)
        parts += [F.lit(r.column), v, F.when(v > r.upper, "above").otherwise("below"), beyond]
    return df.where(some).select(*[F.col(k) for k in key_cols], F.stack(
        F.lit(len(rails)), *parts).alias("column_name", "value", "direction", "beyond")
    ).where(F.col("beyond").isNotNull())


def outlier_samples(df: DataFrame, key_cols: list[str], k: int = 8, multiplier: float = 1.5,
                    **sizes) -> DataFrame:
    """The ``k`` farthest outliers per column.  The rank limit runs before the shuffle too."""
    order = W.partitionBy("column_name").orderBy(F.desc("beyond"), *key_cols)
    return outlier_rows(df, key_cols, multiplier, **sizes).withColumn(
        "rank", F.row_number().over(order)).where(F.col("rank") <= k)


def split_by_fence(df: DataFrame, column: str, multiplier: float = 1.5, **sizes) -> DataFrame:
    """``df`` with ``is_anomaly`` for one column: the data behind a scatter or box plot."""
    slim = df.select(column)
    rail = fences(slim, table_stats(slim, constants=False), multiplier, **sizes)
    v = as_double(df.schema[column])
    flag = outside(v, rail[0].lower, rail[0].upper) if rail else F.lit(False)
    return df.withColumn("is_anomaly", F.coalesce(flag, F.lit(False)))


def box_plot(df: DataFrame, columns: list[str] | None = None, multiplier: float = 1.5, **sizes) -> DataFrame:
    """Box-plot figures per column: quartiles, whisker ends, bounds, points in and out.

    Whiskers end at the farthest values inside the bounds.
    """
    fields = [f for f in numeric_fields(df) if columns is None or f.name in columns]
    slim = df.select(*[f.name for f in fields])
    stats = table_stats(slim, constants=False)
    rails = fences(slim, stats, multiplier, **sizes)
    if not rails:
        raise ValueError("no numeric column with values")
    medians = {n: q[0] for n, q in numeric_quantiles(slim, stats, [0.5], **sizes).items()}
    col = {f.name: as_double(f) for f in fields}
    structs = []
    for r in rails:
        v = col[r.column]
        inside = F.when(~outside(v, r.lower, r.upper), v)
        structs.append(F.struct(
            F.lit(r.column).alias("column_name"), F.lit(r.q1).alias("q1"), F.lit(medians[r.column]).alias("median"),
            F.lit(r.q3).alias("q3"), F.lit(r.lower).alias("lower_bound"), F.lit(r.upper).alias("upper_bound"),
            F.min(inside).alias("whisker_low"), F.max(inside).alias("whisker_high"),
            F.count(inside).alias("normal_points"),
            F.count_if(outside(v, r.lower, r.upper)).alias("anomaly_points")))
    return slim.agg(F.array(*structs).alias("r")).select(F.inline("r"))
