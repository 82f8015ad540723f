"""Is a table fit for analytics: seven structural checks, a strict score, a verdict."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.columns import as_double, outside, string_fields, numeric_fields
from plumbline.functions.sizing import ratio
from plumbline.functions.text import fixed
from plumbline.operators.frequency import duplicate_rows, frequency_facts
from plumbline.operators.outliers import fences
from plumbline.operators.scan import TableStats, stats_frame, table_stats

SEVERITY_ORDER = ("critical", "high", "medium")
# The checks in reporting order, as (flag, title, severity, text, recommendation).
CHECKS = [
    ("is_empty", "Empty Columns Detected", "critical",
     " completely empty columns will break SQL queries and analytics",
     "Remove empty columns before running analytics"),
    ("extreme_missing", "Extreme Missing Data", "critical",
     " columns with >80% missing data will cause analytics to fail",
     "Remove or impute missing data before analytics"),
    ("duplicated", "High Duplicate Rate", "high", "",
     "Remove duplicate records to ensure accurate analytics"),
    ("is_constant", "Constant Columns", "medium",
     " columns with only one value provide no analytical value",
     "Remove constant columns to improve model performance"),
    ("high_cardinality", "High Cardinality Categorical Columns", "medium",
     " categorical columns with very high cardinality may cause memory issues",
     "Consider grouping rare categories or using embedding techniques"),
    ("high_outliers", "High Outlier Rate", "medium",
     " numeric columns have >5% outliers which may affect ML models",
     "Consider outlier treatment (removal, capping, or transformation)"),
    ("mixed_types", "Mixed Data Types", "high",
     " columns contain mixed data types which will cause analytics errors",
     "Clean and standardize data types before analytics"),
]
# Lowest score of each verdict.
VERDICTS = [
    (85, "Excellent", "Excellent data quality - Ready for advanced analytics with minimal preprocessing."),
    (70, "Good", "Good data quality - Suitable for most analytics with minor cleanup."),
    (50, "Fair", "Fair data quality - Requires moderate cleanup before reliable analytics."),
    (30, "Poor", "Poor data quality - Significant preprocessing needed before analytics."),
]
LOWEST_VERDICT = ("Critical", "Critical data quality issues - Major remediation required before any analytics.")


def mixed_types(df: DataFrame, stats: TableStats | None = None, sample_rows: int | None = None,
                order_col: str | None = None, min_sample: int = 0) -> DataFrame:
    """Text columns whose values are partly numbers: column_name, numeric_share, is_mixed.

    Mixed means a numeric share strictly between 10 % and 90 % over more than ``min_sample``
    values.  The share covers the whole column, or the first ``sample_rows`` present values
    by ``order_col``.
    """
    stats = stats or table_stats(df, moments=False, constants=False)
    names = [f.name for f in string_fields(df)]
    if sample_rows is None:
        facts = frequency_facts(df, stats, columns=names, modes=False)
    else:
        facts = None
        for name in names:
            head = df.where(F.col(f"`{name}`").isNotNull()).orderBy(order_col).limit(sample_rows).select(name)
            part = frequency_facts(head, table_stats(head, moments=False, constants=False)).withColumn(
                "position", F.lit(stats.by_name(name).position))
            facts = part if facts is None else facts.unionByName(part)
        if facts is None:
            facts = frequency_facts(df, stats, columns=[], modes=False)
    frame = stats_frame(df.sparkSession, stats).where(F.col("kind") == "string")
    share = ratio(F.col("numeric_cells"), F.col("text_cells"))
    return frame.join(F.broadcast(facts), "position", "left").select(
        "position", "column_name", F.coalesce("distinct", F.lit(0)).alias("distinct"), share.alias("numeric_share"),
        F.coalesce((share > 0.1) & (share < 0.9) & (F.col("text_cells") > min_sample), F.lit(False)).alias("is_mixed"))


def column_checks(df: DataFrame, stats: TableStats | None = None, **sizes) -> DataFrame:
    """One row per column with a flag for each per-column check."""
    stats = stats or table_stats(df)
    rails = fences(df, stats, 1.5, **sizes)
    fields = {f.name: as_double(f) for f in numeric_fields(df)}
    high: dict[str, bool] = {}
    if rails and stats.rows:
        row = df.agg(*[F.count_if(outside(fields[r.column], r.lower, r.upper)) for r in rails]).first()
        high = {r.column: row[i] / stats.rows > 0.05 for i, r in enumerate(rails)}
    texts = mixed_types(df, stats).select("position", F.col("distinct").alias("text_distinct"), "is_mixed")
    frame = stats_frame(df.sparkSession, stats, {"high_outliers": (pa.bool_(), high)})
    rows = F.col("total_count")
    return frame.join(F.broadcast(texts), "position", "left").select(
        "position", "column_name", "total_count",
        ((F.col("present_count") == 0) & (rows > 0)).alias("is_empty"),
        F.coalesce(ratio(F.col("null_count"), rows) > 0.8, F.lit(False)).alias("extreme_missing"),
        F.col("is_constant"),
        F.coalesce((ratio(F.col("text_distinct"), rows) > 0.95) & (F.col("text_distinct") > 100),
                   F.lit(False)).alias("high_cardinality"),
        F.coalesce("high_outliers", F.lit(False)).alias("high_outliers"),
        F.coalesce("is_mixed", F.lit(False)).alias("mixed_types"))


def readiness_issues(df: DataFrame, **sizes) -> DataFrame:
    """One row per issue, worst first: rank, title, severity, description,
    affected_columns, recommendation."""
    checks = column_checks(df, **sizes)
    flags = [c[0] for c in CHECKS if c[0] != "duplicated"]

    def listed(test: Column) -> Column:
        found = F.array_sort(F.collect_list(F.when(test, F.struct("position", "column_name"))))
        return F.transform(found, lambda s: s["column_name"])

    # lists of column names, never of data
    lists = checks.agg(*[listed(F.col(f)).alias(f) for f in flags], listed(F.lit(True)).alias("all_columns"))
    both = lists.crossJoin(F.broadcast(duplicate_rows(df)))  # one row each
    dup, rows = F.col("duplicate_rows"), F.col("total_rows")
    found = []
    for flag, title, severity, text, advice in CHECKS:
        if flag == "duplicated":
            test, cols = dup > rows * 0.1, F.col("all_columns")
            told = F.concat(dup.cast("string"), F.lit(" duplicate records ("),
                            fixed(ratio(dup, rows) * 100, 1), F.lit("%) will skew analytics results"))
        else:
            cols = F.col(flag)
            test, told = F.size(cols) > 0, F.concat(F.size(cols).cast("string"), F.lit(text))
        found.append(F.when(test, F.struct(
            F.lit(SEVERITY_ORDER.index(severity)).alias("severity_rank"), F.lit(len(found)).alias("check_order"),
            F.lit(title).alias("title"), F.lit(severity).alias("severity"), told.alias("description"),
            cols.alias("affected_columns"), F.lit(advice).alias("recommendation"))))
    issues = both.select(F.inline(F.array_sort(F.array_compact(F.array(*found)))))
    return issues.drop("check_order")


def readiness_score(issues: DataFrame) -> DataFrame:
    """One row: issue counts, score 0-100, verdict and its text."""
    counts = issues.agg(*[F.count_if(F.col("severity") == s).alias(f"{s}_issues") for s in SEVERITY_ORDER],
                        F.count(F.lit(1)).alias("total_issues"))
    crit, high, med, total = (F.col(c) for c in ("critical_issues", "high_issues", "medium_issues", "total_issues"))

    def lowered(score: Column, by: Column) -> Column:
        return F.greatest(F.lit(0), score - by)

    score = lowered(F.lit(100), crit * 70)
    score = lowered(score, high * 40)
    score = lowered(score, med * 20)
    score = lowered(score, F.greatest(F.lit(0), total - 3) * 10)
    cap = (F.when(crit > 0, 40).when(high >= 2, 60).when(high > 0, 75).otherwise(100))
    scored = counts.withColumn("quality_score", F.least(score, cap).cast("bigint"))

    def verdict(item: int) -> Column:
        expr = None
        for low, *texts in VERDICTS:
            test = F.col("quality_score") >= low
            expr = F.when(test, texts[item]) if expr is None else expr.when(test, texts[item])
        return expr.otherwise(LOWEST_VERDICT[item])

    return scored.withColumns({"verdict": verdict(0), "assessment": verdict(1)})
