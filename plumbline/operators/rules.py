"""Quality rules over a column profile: issues, scores, critical findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.sizing import ratio
from plumbline.functions.text import first_names, fixed, percent


def column_issues() -> Column:
    """Array of issue texts for one profile row; all thresholds are strict."""
    nulls = F.col("null_percentage")
    unique_share = ratio(F.col("unique_count"), F.col("total_count"))
    outlier_share = ratio(F.col("outliers_count"), F.col("present_count"))
    is_id = (F.col("kind") == "integer") & (F.col("unique_count") == F.col("total_count"))
    return F.array_compact(F.array(
        F.when(nulls > 50, F.concat(F.lit("HIGH_NULL_RATE: "), fixed(nulls, 1), F.lit("% null values")))
        .when(nulls > 10, F.concat(F.lit("MODERATE_NULL_RATE: "), fixed(nulls, 1), F.lit("% null values"))),
        F.when((unique_share < 0.01) & (F.col("data_type") != "categorical"),
               F.concat(F.lit("LOW_UNIQUENESS: Only "), percent(unique_share, 2), F.lit(" unique values"))),
        F.when(outlier_share > 0.05,
               F.concat(F.lit("HIGH_OUTLIER_RATE: "), percent(outlier_share, 2), F.lit(" outliers detected"))),
        F.when(F.col("mixed_case"), F.lit("INCONSISTENT_CASING: Mixed case values detected")),
        F.when(F.col("edge_space"), F.lit("WHITESPACE_ISSUES: Leading/trailing whitespace detected")),
        F.when(is_id & (F.col("present_count") > 1) & (F.col("span") != F.col("unique_count")),
               F.lit("ID_GAPS: Potential gaps in ID sequence")),
    ))


def column_score(nulls: Column, issues: Column) -> Column:
    return F.greatest(F.lit(0.0), 100 - nulls * 0.5 - F.size(issues) * 10)


def critical_issues(profile: DataFrame) -> DataFrame:
    """One row: the critical findings of a profile, in fixed order."""
    def named(test: Column) -> Column:
        found = F.array_sort(F.collect_list(F.when(test, F.struct("position", "column_name"))))
        return F.transform(found, lambda s: s["column_name"])

    nulls = named(F.col("null_percentage") > 50)
    many = named(F.size("data_quality_issues") >= 2)
    lists = profile.agg(nulls.alias("nulls"), many.alias("many"))

    def text(names: str, lead: str) -> Column:
        return F.when(F.size(names) > 0, F.concat(
            F.lit(lead), F.size(names).cast("string"), F.lit(" columns: "), first_names(F.col(names))))

    return lists.select(F.array_compact(F.array(
        text("nulls", "High null rate in "), text("many", "Multiple issues in "))).alias("critical_issues"))


def quality_score(profile: DataFrame) -> DataFrame:
    """One row: overall_quality_score, the mean column score (NULL for a table without rows)."""
    return profile.agg(F.avg("quality_score").alias("overall_quality_score"))
