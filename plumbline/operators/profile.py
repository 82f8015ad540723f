"""Column profiles, the quality report, and the summary tables drawn from them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.columns import as_double, numeric_fields
from plumbline.functions.sizing import ratio
from plumbline.functions.text import first_names, fixed
from plumbline.operators import rules
from plumbline.operators.frequency import duplicate_rows, frequency_facts
from plumbline.operators.quantiles import exact_quantiles
from plumbline.operators.scan import TableStats, stats_frame, table_stats

# Distinct values up to which a text column counts as categorical.
CATEGORICAL_MAX_DISTINCT = 50


def numeric_quantiles(df: DataFrame, stats: TableStats, probs: list[float],
                      **sizes) -> dict[str, list[float | None]]:
    """Exact quantiles of every numeric column."""
    known = {c.name: (c.present, c.low, c.high) for c in stats.numeric()}
    return exact_quantiles(df, {f.name: as_double(f) for f in numeric_fields(df)}, probs,
                           known=known, **sizes)


def profile_columns(df: DataFrame, categorical: tuple[str, ...] = (),
                    z_threshold: float = 2.0, **sizes) -> DataFrame:
    """One row per column: counts, moments, median, mode, outliers, issues and score."""
    stats = table_stats(df, constants=False, categorical=categorical)
    medians = {n: q[0] for n, q in numeric_quantiles(df, stats, [0.5], **sizes).items()}
    facts = frequency_facts(df, stats, z_threshold=z_threshold)
    frame = stats_frame(df.sparkSession, stats, {"median": (pa.float64(), medians)})
    # facts has one row per column of the table
    joined = frame.join(F.broadcast(facts), "position", "left")
    whole = F.col("total_count") > 0
    shaped = joined.select(
        "position", "column_name", "data_type", "kind", "total_count", "null_count", "present_count",
        F.coalesce(ratio(F.col("null_count"), F.col("total_count")) * 100, F.lit(0.0)).alias("null_percentage"),
        F.coalesce("distinct", F.lit(0)).alias("unique_count"),
        (F.col("total_count") - F.coalesce("distinct", F.lit(0))).alias("duplicate_count"),
        "mean", "median", "std", "min_value", "max_value", "mode",
        F.coalesce("outliers", F.lit(0)).alias("outliers_count"),
        F.coalesce("mixed_case", F.lit(False)).alias("mixed_case"),
        F.coalesce("edge_space", F.lit(False)).alias("edge_space"),
        "span")
    issued = shaped.withColumn("data_quality_issues", F.when(whole, rules.column_issues())
                               .otherwise(F.array().cast("array<string>")))
    return issued.withColumn("quality_score", F.when(
        whole, rules.column_score(F.col("null_percentage"), F.col("data_quality_issues"))))


def quality_report(profile: DataFrame, dataset_name: str = "Unknown") -> DataFrame:
    """One row per dataset: size, overall score and critical issues."""
    size = profile.agg(
        F.lit(dataset_name).alias("dataset_name"), F.max("total_count").alias("total_rows"),
        F.count(F.lit(1)).alias("total_columns"), F.current_timestamp().alias("profiled_at"),
        F.avg("quality_score").alias("overall_quality_score"))
    return size.crossJoin(F.broadcast(rules.critical_issues(profile)))  # one row each


def variable_types(df: DataFrame, stats: TableStats | None = None,
                   categorical_max_distinct: int = CATEGORICAL_MAX_DISTINCT) -> DataFrame:
    """One row per column with its profiling type and the facts shown beside it."""
    stats = stats or table_stats(df)
    facts = frequency_facts(df, stats)
    kind = F.col("kind")
    var_type = (F.when(F.col("present_count") == 0, "Unsupported")
                .when(kind.isin("integer", "float", "decimal"), "Numeric")
                .when(kind == "datetime", "DateTime").when(kind == "boolean", "Boolean")
                .when(kind.isin("nested", "interval"), "Unsupported")
                .when(F.col("distinct") <= categorical_max_distinct, "Categorical").otherwise("Text"))
    return stats_frame(df.sparkSession, stats).join(F.broadcast(facts), "position", "left").select(
        "position", "column_name", var_type.alias("var_type"), "total_count", "null_count",
        F.coalesce(ratio(F.col("null_count"), F.col("total_count")) * 100, F.lit(0.0)).alias("missing_percentage"),
        "present_count", "is_constant", F.coalesce("distinct", F.lit(0)).alias("distinct"),
        F.coalesce("single", F.lit(0)).alias("n_unique"), "first_time", "last_time", "mean", "std", "min_value", "max_value", "mode",
        "min_length", "max_length",
        ratio(F.col("total_length"), F.col("text_cells")).alias("mean_length"),
        ratio(F.col("total_words"), F.col("text_cells")).alias("mean_words"))


def variable_status(types: DataFrame) -> DataFrame:
    """Per variable: type, key statistic by type, status by missing share."""
    miss = F.col("missing_percentage")
    dash = F.lit("-")
    key = (F.when(F.col("var_type") == "Numeric",
                  F.coalesce(F.concat(F.lit("Mean: "), fixed(F.col("mean"), 2)), dash))
           .when(F.col("var_type") == "Categorical",
                 F.concat(F.lit("Categories: "), F.coalesce("distinct", F.lit(0)).cast("string")))
           .when(F.col("var_type") == "Text",
                 F.coalesce(F.concat(F.lit("Max Length: "), F.col("max_length").cast("string")), dash))
           .otherwise(dash))
    status = (F.when(miss > 50, "Critical").when(miss > 20, "Warning")
              .when(miss > 5, "Attention").otherwise("Good"))
    return types.select("position", "column_name", "var_type", key.alias("key_statistic"),
                        status.alias("status"))


def type_distribution(types: DataFrame) -> DataFrame:
    """Number and share of columns per variable type."""
    counts = types.groupBy("var_type").agg(F.count(F.lit(1)).alias("columns"))
    total = types.agg(F.count(F.lit(1)).alias("all"))
    return counts.crossJoin(F.broadcast(total)).select(
        "var_type", "columns", (ratio(F.col("columns"), F.col("all")) * 100).alias("percentage"))


def table_summary(df: DataFrame, stats: TableStats | None = None) -> DataFrame:
    """One row: size, missing cells, duplicate rows, constant variables and alerts."""
    stats = stats or table_stats(df, moments=False)
    constants = sum(1 for c in stats.columns if c.constant)
    base = duplicate_rows(df).select(
        F.lit(len(stats.columns)).cast("bigint").alias("n_var"), F.col("total_rows").alias("n"),
        F.lit(stats.missing_cells).cast("bigint").alias("n_cells_missing"),
        F.coalesce(ratio(F.lit(stats.missing_cells), F.lit(stats.cells)) * 100, F.lit(0.0)).alias("missing_percentage"),
        F.col("duplicate_rows").alias("n_duplicates"),
        F.coalesce(ratio(F.col("duplicate_rows"), F.col("total_rows")) * 100, F.lit(0.0)).alias("duplicate_percentage"),
        F.lit(constants).cast("bigint").alias("n_constant"))
    miss, dup = F.col("missing_percentage"), F.col("duplicate_percentage")
    return base.withColumn("alerts", F.array_compact(F.array(
        F.when(miss > 10, F.concat(F.lit("High missing data: "), fixed(miss, 1), F.lit("% of cells are missing"))),
        F.when(dup > 5, F.concat(F.lit("Duplicate rows detected: "), fixed(dup, 1), F.lit("% of rows are duplicates"))),
        F.when(F.col("n_constant") > 0, F.concat(
            F.lit("Constant variables: "), F.col("n_constant").cast("string"),
            F.lit(" variables have only one unique value"))))))


def report_issues(df: DataFrame, stats: TableStats | None = None) -> DataFrame:
    """Issue texts of the detailed report: missing variables, duplicates, constants."""
    stats = stats or table_stats(df, moments=False)
    high = [c.name for c in stats.columns if stats.rows and c.missing / stats.rows > 0.1]
    flat = [c.name for c in stats.columns if stats.rows and (c.constant or c.present == 0)]

    def names(items: list[str]) -> Column:
        return F.array(*[F.lit(i) for i in items]).cast("array<string>")

    dup = ratio(F.col("duplicate_rows"), F.col("total_rows")) * 100
    return duplicate_rows(df).select(F.explode(F.array_compact(F.array(
        F.when(F.size(names(high)) > 0, F.concat(
            F.lit(f"High missing data in {len(high)} variables: "), first_names(names(high)))),
        F.when(dup > 5, F.concat(F.lit("Duplicate rows detected: "), fixed(dup, 1), F.lit("% of the dataset"))),
        F.when(F.size(names(flat)) > 0, F.concat(
            F.lit("Constant variables found: "), F.concat_ws(", ", names(flat)))),
    ))).alias("issue"))


def profile_detail(df: DataFrame, histogram_bins: int = 10, **sizes) -> DataFrame:
    """Per numeric column: spread, shape, exact quantiles, zero/negative counts, histogram.

    The histogram counts present values in equal-width bins between min and max.
    """
    stats = table_stats(df, constants=False)
    probs = [0.05, 0.25, 0.5, 0.75, 0.95]
    quants = numeric_quantiles(df, stats, probs, **sizes)
    fields = {f.name: as_double(f) for f in numeric_fields(df)}
    aggs = []
    for i, (name, v) in enumerate(fields.items()):
        c = stats.by_name(name)
        width = None if c.low is None else (c.high - c.low) / histogram_bins
        bins = []
        for b in range(histogram_bins):
            if not width:
                bins.append(F.count_if(v.isNotNull()) if b == 0 else F.lit(0).cast("bigint"))
                continue
            above = v >= c.low + b * width
            under = v <= c.high if b == histogram_bins - 1 else v < c.low + (b + 1) * width
            bins.append(F.count_if(above & under))
        aggs.append(F.struct(
            F.lit(name).alias("column_name"), F.count(v).alias("n"),
            F.count_if(v == 0).alias("n_zeros"), F.count_if(v < 0).alias("n_negative"),
            F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
            F.skewness(v).alias("skewness"), F.kurtosis(v).alias("kurtosis"),
            *[F.lit(quants[name][k]).cast("double").alias(f"q{int(p * 100):02d}") for k, p in enumerate(probs)],
            F.array(*bins).alias("histogram")).alias(f"c{i}"))
    if not aggs:
        raise ValueError("no numeric column")
    one = df.agg(*aggs)
    return one.select(F.inline(F.array(*[F.col(f"c{i}") for i in range(len(aggs))])))


def describe_numeric(df: DataFrame, **sizes) -> DataFrame:
    """count, mean, std, min, exact quartiles and max of every numeric column."""
    stats = table_stats(df, constants=False)
    q = numeric_quantiles(df, stats, [0.25, 0.5, 0.75], **sizes)
    frame = stats_frame(df.sparkSession, stats, {
        f"p{p}": (pa.float64(), {n: v[k] for n, v in q.items()}) for k, p in enumerate((25, 50, 75))})
    return frame.where(F.col("kind").isin("integer", "float", "decimal")).select(
        "column_name", F.col("present_count").alias("count"), "mean", "std",
        F.col("min_value").alias("min"), "p25", "p50", "p75", F.col("max_value").alias("max"))
