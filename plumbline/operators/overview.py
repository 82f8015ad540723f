"""Dataset-level quality figures, column status tables and dataset summaries."""

from __future__ import annotations

from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.sizing import estimated_bytes, local_frame, ratio
from plumbline.functions.text import fixed, grouped
from plumbline.operators.frequency import duplicate_rows, frequency_facts
from plumbline.operators.readiness import mixed_types
from plumbline.operators.scan import TableStats, stats_frame, table_stats

# Lowest score of each grade.
GRADES = [(90, "A"), (80, "B"), (70, "C"), (60, "D")]


def _completeness(stats: TableStats) -> Column:
    return F.lit((stats.cells - stats.missing_cells) / stats.cells * 100 if stats.cells else 0.0)


def _uniqueness() -> Column:
    share = ratio(F.col("total_rows") - F.col("duplicate_rows"), F.col("total_rows")) * 100
    return F.coalesce(share, F.lit(100.0))


def _grade(score: Column) -> Column:
    expr = None
    for low, grade in GRADES:
        test = score >= low
        expr = F.when(test, grade) if expr is None else expr.when(test, grade)
    return expr.otherwise("F")


def _weighted() -> Column:
    return F.col("completeness") * 0.4 + F.col("consistency") * 0.3 + F.col("validity") * 0.3


def dataset_overview(df: DataFrame, name: str, source_type: str = "file", **mixed) -> DataFrame:
    """One row: completeness, consistency, validity (mixed text columns), score and grade."""
    stats = table_stats(df, moments=False, constants=False)
    width = len(stats.columns)
    bad = mixed_types(df, stats, min_sample=mixed.pop("min_sample", 10), **mixed).agg(
        F.count_if("is_mixed").alias("invalid_columns"))
    return duplicate_rows(df).crossJoin(F.broadcast(bad)).select(  # one row each
        F.lit(name).alias("dataset_name"), F.upper(F.lit(source_type)).alias("source_type"),
        F.col("total_rows").alias("rows"), F.lit(width).cast("bigint").alias("columns"),
        _completeness(stats).alias("completeness"), _uniqueness().alias("consistency"),
        F.greatest(F.lit(0.0), 100 - F.col("invalid_columns") / F.lit(width) * 100).alias("validity"),
    ).withColumn("quality_score", _weighted()).withColumn("grade", _grade(F.col("quality_score")))


def header_score(df: DataFrame) -> DataFrame:
    """One row: 0.6 completeness + 0.4 consistency."""
    stats = table_stats(df, moments=False, constants=False)
    return duplicate_rows(df).select(
        F.col("total_rows").alias("rows"), F.lit(len(stats.columns)).cast("bigint").alias("columns"),
        (_completeness(stats) * 0.6 + _uniqueness() * 0.4).alias("data_quality"))


def overview_detail(df: DataFrame) -> DataFrame:
    """One row: structural validity (empty and constant columns), weighted score, alerts.

    An empty column counts as empty and as constant.
    """
    stats = table_stats(df, moments=False)
    width = len(stats.columns)
    empty = sum(1 for c in stats.columns if c.present == 0)
    flat = sum(1 for c in stats.columns if c.constant or c.present == 0)
    base = duplicate_rows(df).select(
        _completeness(stats).alias("completeness"), _uniqueness().alias("consistency"),
        F.lit(max(0.0, 100 - (empty + flat) / width * 100) if width else 100.0).alias("validity"),
        F.lit(stats.missing_cells).cast("bigint").alias("missing_cells"), "duplicate_rows",
        F.lit(empty).cast("bigint").alias("empty_columns"), F.lit(flat).cast("bigint").alias("constant_columns"))
    return base.withColumn("overall_quality", _weighted()).withColumn("alerts", F.array_compact(F.array(
        F.when(F.col("completeness") < 90, F.concat(
            F.lit("Low completeness: "), grouped(F.col("missing_cells")), F.lit(" missing values"))),
        F.when(F.col("duplicate_rows") > 0, F.concat(
            F.lit("Data duplicates: "), grouped(F.col("duplicate_rows")), F.lit(" duplicate rows"))),
        F.when(F.col("empty_columns") > 0, F.concat(
            F.lit("Empty columns: "), F.col("empty_columns").cast("string"), F.lit(" columns with no data"))),
        F.when(F.col("constant_columns") > 0, F.concat(
            F.lit("Constant columns: "), F.col("constant_columns").cast("string"),
            F.lit(" columns with only one value"))))))


def column_quality(df: DataFrame) -> DataFrame:
    """Per column: counts, missing share, distinct values and a status."""
    stats = table_stats(df, moments=False)
    facts = frequency_facts(df, stats, modes=False).select("position", "distinct")
    miss, unique = F.col("missing_percentage"), F.col("unique_values")
    return stats_frame(df.sparkSession, stats).join(F.broadcast(facts), "position", "left").select(
        "position", "column_name", F.col("dtype").alias("type"), F.col("present_count").alias("non_null"),
        F.col("null_count").alias("missing"),
        F.coalesce(ratio(F.col("null_count"), F.col("total_count")) * 100, F.lit(0.0)).alias("missing_percentage"),
        F.coalesce("distinct", F.lit(0)).alias("unique_values"),
    ).withColumn("quality", F.when(miss == 100, "Empty").when(unique <= 1, "Constant").when(miss > 50, "Poor")
                 .when(miss > 20, "Fair").when(miss > 5, "Good").otherwise("Excellent"))


def column_overview(df: DataFrame) -> DataFrame:
    """Per column: type, non-null and null counts, null share to two digits.  No shuffle."""
    stats = table_stats(df, moments=False, constants=False)
    return stats_frame(df.sparkSession, stats).select(
        "position", "column_name", F.col("dtype").alias("type"), F.col("present_count").alias("non_null_count"),
        "null_count",
        F.round(F.coalesce(ratio(F.col("null_count"), F.col("total_count")) * 100, F.lit(0.0)), 2)
        .alias("null_percentage"))


def type_counts(df: DataFrame) -> DataFrame:
    """Columns per data type, from the schema alone."""
    dtypes = F.array(*[F.lit(t) for _, t in df.dtypes])
    return df.sparkSession.range(1).select(F.explode(dtypes).alias("type")).groupBy("type").agg(
        F.count(F.lit(1)).alias("columns"))


def dataset_summary(df: DataFrame, name: str, source_type: str = "file", **facts: str) -> DataFrame:
    """One row: size, missing cells and share, estimated bytes, columns per type, extra facts."""
    stats = table_stats(df, moments=False, constants=False)
    per_type: dict[str, int] = {}
    for _, t in df.dtypes:
        per_type[t] = per_type.get(t, 0) + 1
    text, count = pa.string(), pa.int64()
    return local_frame(df.sparkSession, {
        "name": (text, [name]), "source_type": (text, [source_type]), "rows": (count, [stats.rows]),
        "columns": (count, [len(stats.columns)]), "missing_values": (count, [stats.missing_cells]),
        "missing_percentage": (pa.float64(), [stats.missing_cells / stats.cells * 100 if stats.cells else 0.0]),
        "estimated_bytes": (pa.decimal128(38, 0), [Decimal(estimated_bytes(df))]),
        "data_types": (pa.map_(text, count), [sorted(per_type.items())]),
        **{k: (text, [v]) for k, v in facts.items()}})


def dataset_totals(summaries: DataFrame) -> DataFrame:
    """One row over several dataset summaries: how many, rows, estimated bytes."""
    return summaries.agg(F.count(F.lit(1)).alias("total_datasets"), F.sum("rows").alias("total_rows"),
                         F.sum("estimated_bytes").alias("total_bytes"))


def snapshot_score(df: DataFrame) -> DataFrame:
    """One row: 0.7 completeness + 0.3 row uniqueness, two digits; 0 for a table without rows."""
    stats = table_stats(df, moments=False, constants=False)
    score = _completeness(stats) * 0.7 + _uniqueness() * 0.3
    return duplicate_rows(df).select(
        F.round(F.when(F.col("total_rows") > 0, score).otherwise(0.0), 2).alias("data_quality_score"))


def preview(df: DataFrame, rows: int = 10, order_by: list[str] = ()) -> DataFrame:
    """The first rows, by the given order when there is one."""
    return (df.orderBy(*order_by) if order_by else df).limit(rows)
