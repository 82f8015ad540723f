"""Statistical outliers of numeric columns, by row.

Statistics are collected once (a handful of numbers per column) and enter the row filter as
literals, so flagging rows is a scan without a shuffle.  Rows are named by the caller's key
columns; there is no row index.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, fields

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.functions.columns import as_double, numeric_fields
from plumbline.functions.sizing import local_frame, ratio
from plumbline.operators.quantiles import exact_quantiles, median_abs_deviation
from plumbline.operators.scan import table_stats

METHODS = ("zscore", "iqr", "modified_zscore", "isolation")
DEFAULT_METHODS = ("zscore", "iqr", "modified_zscore")
# Normal-consistency factor of the modified z-score and the tail share.
MODIFIED_Z_FACTOR = 0.6745
TAIL_SHARE = 0.02


@dataclass(frozen=True)
class Thresholds:
    z: float = 2.0
    iqr_multiplier: float = 1.5
    modified_z: float = 3.5

    def of(self, method: str) -> float:
        return {"zscore": self.z, "iqr": self.iqr_multiplier,
                "modified_zscore": self.modified_z, "isolation": TAIL_SHARE}[method]


@dataclass(frozen=True)
class Spread:
    """Statistics of one column; None where undefined."""
    column: str
    n: int
    mean: float | None
    std: float | None
    low: float | None
    high: float | None
    q1: float | None
    median: float | None
    q3: float | None
    p_low: float | None
    p_high: float | None
    mad: float | None

    def bounds(self, multiplier: float) -> tuple[float, float]:
        width = multiplier * (self.q3 - self.q1)
        return self.q1 - width, self.q3 + width


def save_baseline(spark: SparkSession, baseline: list[Spread], path: str) -> None:
    """Store the spreads of a table, one row per column, for later comparison."""
    kinds = {"column": pa.string(), "n": pa.int64()}
    local_frame(spark, {f.name: (kinds.get(f.name, pa.float64()), [getattr(s, f.name) for s in baseline])
                        for f in fields(Spread)}).write.mode("overwrite").parquet(path)


def load_baseline(spark: SparkSession, path: str) -> list[Spread]:
    """The stored spreads: a few numbers per column."""
    return [Spread(**r.asDict()) for r in spark.read.parquet(path).select(*[f.name for f in fields(Spread)]).collect()]


def known_methods(methods) -> list[str]:
    for m in methods:
        if m not in METHODS:
            warnings.warn(f"unknown anomaly method skipped: {m}", stacklevel=3)
    return [m for m in methods if m in METHODS]


def spreads(df: DataFrame, columns: list[str] | None = None, methods=METHODS, **sizes) -> list[Spread]:
    """Collect what the methods need for each numeric column that has values."""
    chosen = [f for f in numeric_fields(df) if columns is None or f.name in columns]
    slim = df.select(*[as_double(f).alias(f.name) for f in chosen])
    stats = [c for c in table_stats(slim, constants=False).columns if c.present] if chosen else []
    values = {c.name: F.col(f"`{c.name}`") for c in stats}
    known = {c.name: (c.present, c.low, c.high) for c in stats}
    probs = ([0.25, 0.75] if "iqr" in methods else []) \
        + ([0.5] if "modified_zscore" in methods else []) \
        + ([TAIL_SHARE, 1 - TAIL_SHARE] if "isolation" in methods else [])
    got = exact_quantiles(slim, values, probs, known=known, **sizes) if probs else {}
    q = {n: dict(zip(probs, v)) for n, v in got.items()}
    mads = median_abs_deviation(slim, values, {n: q[n][0.5] for n in values}, **sizes) \
        if "modified_zscore" in methods else {}
    return [Spread(c.name, c.present, c.mean, c.std, c.low, c.high,
                   *[q.get(c.name, {}).get(p) for p in (0.25, 0.5, 0.75, TAIL_SHARE, 1 - TAIL_SHARE)],
                   mads.get(c.name)) for c in stats]


def _spread(width: float | None) -> bool:
    """Whether a width can measure distances: there, not zero, and finite (infinite values leave none)."""
    return width is not None and width != 0 and math.isfinite(width)


def score(value: Column, s: Spread, method: str, limits: Thresholds) -> Column | None:
    """The anomaly score, NULL for normal values; None when the method finds no spread."""
    if method == "zscore":
        if not _spread(s.std) or not math.isfinite(s.mean):
            return None
        z = F.abs((value - s.mean) / s.std)
        return F.when(z > limits.z, z)
    if method == "modified_zscore":
        if not _spread(s.mad):
            return None
        z = F.abs(MODIFIED_Z_FACTOR * (value - s.median) / s.mad)
        return F.when(z > limits.modified_z, z)
    if method == "iqr":
        if not _spread(s.q3 - s.q1):
            return None
        low, high = s.bounds(limits.iqr_multiplier)
        unit = s.q3 - s.q1
    else:
        if s.high == s.low:
            return None
        low, high, unit = s.p_low, s.p_high, s.high - s.low
    return F.when(value < low, (low - value) / unit).when(value > high, (value - high) / unit)


def statistical_summary(df: DataFrame, columns: list[str] | None = None,
                        iqr_multiplier: float = 1.5, **sizes) -> DataFrame:
    """mean, median, std, mad, quartiles, iqr and bounds of each numeric column."""
    rows = spreads(df, columns, DEFAULT_METHODS, **sizes)
    f8 = pa.float64()
    return local_frame(df.sparkSession, {
        "column_name": (pa.string(), [s.column for s in rows]),
        "mean": (f8, [s.mean for s in rows]), "median": (f8, [s.median for s in rows]),
        "std": (f8, [s.std for s in rows]), "mad": (f8, [s.mad for s in rows]),
        "q1": (f8, [s.q1 for s in rows]), "q3": (f8, [s.q3 for s in rows]),
        "iqr": (f8, [s.q3 - s.q1 for s in rows]),
        "lower_bound": (f8, [s.bounds(iqr_multiplier)[0] for s in rows]),
        "upper_bound": (f8, [s.bounds(iqr_multiplier)[1] for s in rows])})


def _scored(df: DataFrame, stats: list[Spread], methods: list[str], limits: Thresholds):
    """(column, method, value, score) expressions of every pair that can flag a row."""
    cells = {f.name: as_double(f) for f in numeric_fields(df)}
    for s in stats:
        for m in methods:
            expr = score(cells[s.column], s, m, limits)
            if expr is not None:
                yield s.column, m, cells[s.column], expr


def detect_anomalies(df: DataFrame, key_cols: list[str], methods=DEFAULT_METHODS,
                     columns: list[str] | None = None, limits: Thresholds = Thresholds(),
                     **sizes) -> DataFrame:
    """Long table of anomalies: keys, column_name, method, value, score, threshold."""
    methods = known_methods(methods)
    parts = list(_scored(df, spreads(df, columns, methods, **sizes), methods, limits))
    keys = [F.col(k) for k in key_cols]
    if not parts:
        return df.where(F.lit(False)).select(
            *keys, F.lit("").alias("column_name"), F.lit("").alias("method"),
            F.lit(0.0).alias("value"), F.lit(0.0).alias("score"), F.lit(0.0).alias("threshold"))
    some = parts[0][3].isNotNull()
    for p in parts[1:]:
        some = some | p[3].isNotNull()
    # filter first: only flagged rows are unpivoted
    long = df.where(some).select(*keys, F.stack(
        F.lit(len(parts)),
        *[e for c, m, v, sc in parts for e in (F.lit(c), F.lit(m), v, sc, F.lit(float(limits.of(m))))]
    ).alias("column_name", "method", "value", "score", "threshold"))
    return long.where(F.col("score").isNotNull())


def anomaly_summary(df: DataFrame, methods=DEFAULT_METHODS, columns: list[str] | None = None,
                    limits: Thresholds = Thresholds(), **sizes) -> DataFrame:
    """Per column and method: total_anomalies, anomaly_percentage, threshold."""
    methods = known_methods(methods)
    stats = spreads(df, columns, methods, **sizes)
    flagged = {(c, m): sc for c, m, _, sc in _scored(df, stats, methods, limits)}
    structs = []
    for s in stats:
        for m in methods:
            sc = flagged.get((s.column, m))
            total = F.count(sc) if sc is not None else F.lit(0).cast("bigint")
            structs.append(F.struct(F.lit(s.column).alias("column_name"), F.lit(m).alias("method"),
                                    total.alias("total_anomalies"), F.lit(s.n).cast("bigint").alias("n"),
                                    F.lit(float(limits.of(m))).alias("threshold")))
    shape = "array<struct<column_name:string,method:string,total_anomalies:bigint,n:bigint,threshold:double>>"
    one = df.agg(F.array(*structs).cast(shape).alias("r"))
    return one.select(F.inline("r")).select(
        "column_name", "method", "total_anomalies",
        (ratio(F.col("total_anomalies"), F.col("n")) * 100).alias("anomaly_percentage"), "threshold")


def anomaly_consensus(df: DataFrame, key_cols: list[str], methods=DEFAULT_METHODS,
                      columns: list[str] | None = None, limits: Thresholds = Thresholds(),
                      **sizes) -> DataFrame:
    """Rows flagged by at least one method, with how many agree.

    ``by_all_methods`` marks the intersection over all methods; ``by_majority`` marks rows
    flagged by at least n // 2 + 1 of n.  One method alone gives neither.  The count is an
    expression over the row, so nothing is shuffled.
    """
    methods = known_methods(methods)
    n = len(methods)
    flags: dict[str, list[Column]] = {}
    values: dict[str, Column] = {}
    for c, _, v, sc in _scored(df, spreads(df, columns, methods, **sizes), methods, limits):
        flags.setdefault(c, []).append(sc.isNotNull().cast("int"))
        values[c] = v
    keys = [F.col(k) for k in key_cols]
    if not flags:
        return df.where(F.lit(False)).select(
            *keys, F.lit("").alias("column_name"), F.lit(0.0).alias("value"), F.lit(0).alias("methods"),
            F.lit(False).alias("by_all_methods"), F.lit(False).alias("by_majority"))
    sums = {c: sum(parts[1:], parts[0]) for c, parts in flags.items()}
    some = None
    for total in sums.values():
        some = total > 0 if some is None else some | (total > 0)
    long = df.where(some).select(*keys, F.stack(
        F.lit(len(sums)), *[e for c, total in sums.items() for e in (F.lit(c), values[c], total)]
    ).alias("column_name", "value", "methods"))
    several = F.lit(n > 1)
    return long.where(F.col("methods") > 0).select(
        *keys, "column_name", "value", "methods",
        (several & (F.col("methods") == n)).alias("by_all_methods"),
        (several & (F.col("methods") >= n // 2 + 1)).alias("by_majority"))
