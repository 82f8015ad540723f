"""Recommendations by rule, and the fact texts a reviewer reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.sizing import ratio
from plumbline.functions.text import fixed, grouped

# Recommendation texts (category, priority, title, description, actions, impact).
MISSING = ("data_validation", "high", "Address High Missing Value Rates",
           "Several columns have significant missing values that could impact analysis accuracy.",
           ["Investigate root causes of missing values", "Implement data validation at source",
            "Consider imputation strategies for critical fields"],
           "Improved data completeness and analysis reliability")
OUTLIERS = ("data_cleaning", "medium", "Review and Handle Outliers",
            "Statistical outliers detected that may indicate data quality issues or legitimate extreme values.",
            ["Review outlier values for legitimacy", "Implement automated outlier detection",
             "Create business rules for outlier handling"],
            "More accurate statistical analysis and modeling")
MONITORING = ("data_monitoring", "high", "Implement Comprehensive Data Quality Monitoring",
              "Overall data quality score indicates need for systematic monitoring and controls.",
              ["Set up automated data quality checks", "Create data quality dashboards",
               "Establish data quality SLAs", "Implement data validation pipelines"],
              "Proactive data quality management and issue prevention")


def recommendations(profile: DataFrame) -> DataFrame:
    """Recommendations that a column profile calls for, in rule order."""
    def named(test: Column) -> Column:
        found = F.array_sort(F.collect_list(F.when(test, F.struct("position", "column_name"))))
        return F.transform(found, lambda s: s["column_name"])

    outlying = F.exists("data_quality_issues", lambda i: i.contains("OUTLIER"))
    facts = profile.agg(named(F.col("null_percentage") > 20).alias("missing"), named(outlying).alias("outlying"),
                        F.avg("quality_score").alias("score"))  # lists of column names

    def row(rank: int, test: Column, texts, columns: Column) -> Column:
        category, priority, title, description, actions, impact = texts
        return F.when(test, F.struct(
            F.lit(rank).alias("rank"), F.lit(category).alias("category"), F.lit(priority).alias("priority"),
            F.lit(title).alias("title"), F.lit(description).alias("description"),
            F.array(*[F.lit(a) for a in actions]).alias("action_items"),
            columns.cast("array<string>").alias("affected_columns"), F.lit(impact).alias("estimated_impact")))

    return facts.select(F.inline(F.array_compact(F.array(
        row(1, F.size("missing") > 0, MISSING, F.col("missing")),
        row(2, F.size("outlying") > 0, OUTLIERS, F.col("outlying")),
        row(3, F.col("score") < 80, MONITORING, F.array())))))


def recommendation_summary(recs: DataFrame) -> DataFrame:
    """Counts by priority and by category plus the high-priority titles: facet, name, count."""
    def counted(facet: str, column: str) -> DataFrame:
        return recs.groupBy(F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("count")).select(
            F.lit(facet).alias("facet"), "name", "count")

    total = recs.agg(F.count(F.lit(1)).alias("count")).select(
        F.lit("total").alias("facet"), F.lit("recommendations").alias("name"), "count")
    return (total.unionByName(counted("priority", "priority")).unionByName(counted("category", "category"))
            .unionByName(counted("high_priority_title", "title").join(
                recs.where(F.col("priority") == "high").select(F.col("title").alias("name")).distinct(),
                "name", "left_semi")))


def column_facts_text(types: DataFrame) -> DataFrame:
    """One fact text per column from ``variable_types`` output: position, column_name, facts."""
    rows, miss = F.col("total_count"), F.col("missing_percentage")
    distinct = F.col("distinct")
    unique_pct = F.coalesce(ratio(distinct, rows) * 100, F.lit(0.0))
    kind = F.col("var_type")

    def line(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    numeric, textual = kind == "Numeric", kind.isin("Categorical", "Text")
    lines = F.array_compact(F.array(
        line("Column: ", F.col("column_name")),
        line("  - Data Type: ", kind),
        line("  - Missing Values: ", F.col("null_count").cast("string"), " (", fixed(miss, 1), "%)"),
        line("  - Unique Values: ", distinct.cast("string"), " (", fixed(unique_pct, 1), "%)"),
        F.when(numeric, line("  - Range: ", fixed(F.col("min_value"), 2), " to ", fixed(F.col("max_value"), 2))),
        F.when(numeric, line("  - Mean: ", fixed(F.col("mean"), 2))),
        F.when(numeric, line("  - Std Dev: ", fixed(F.col("std"), 2))),
        F.when(textual, line("  - Most Frequent: ", F.col("mode"))),
        F.when(textual, line("  - Avg Length: ", fixed(F.col("mean_words"), 2))),
        F.when(kind == "DateTime", line("  - Date Range: ", F.col("first_time"), " to ", F.col("last_time"))),
        F.when(miss > 10, line("  ! HIGH MISSING RATE (", fixed(miss, 1), "%)")),
        F.when(unique_pct > 90, line("  ! HIGH CARDINALITY (", fixed(unique_pct, 1), "% unique)")),
        F.when(kind == "Unsupported", F.lit("  ! UNSUPPORTED DATA TYPE"))))
    return types.select("position", "column_name", F.concat_ws("\n", lines).alias("facts"))


def dataset_facts_text(types: DataFrame, name: str) -> DataFrame:
    """One row: the dataset's facts, column by column, and the summary of key issues."""
    texts = column_facts_text(types).select("position", "facts")
    both = types.join(F.broadcast(texts), "position")  # one row per column of the table
    miss = F.col("missing_percentage")

    def listed(test: Column, text: Column) -> Column:
        found = F.array_sort(F.collect_list(F.when(test, F.struct(F.col("position"), text.alias("t")))))
        return F.transform(found, lambda s: s["t"])

    share = ratio(F.col("distinct"), F.col("total_count"))
    lists = both.agg(
        F.max("total_count").alias("rows"), F.count(F.lit(1)).alias("columns"),
        listed(F.lit(True), F.col("facts")).alias("facts"),
        listed(miss > 10, F.concat("column_name", F.lit(" ("), fixed(miss, 1), F.lit("% missing)"))).alias("missing"),
        listed(share > 0.9, F.concat("column_name", F.lit(" ("), F.col("distinct").cast("string"),
                                     F.lit(" unique values)"))).alias("cardinal"),
        listed(F.col("var_type") == "Unsupported", F.concat(
            F.lit("Unsupported data type in column: "), "column_name")).alias("unsupported"))

    def block(title: str, items: str) -> Column:
        return F.when(F.size(items) > 0, F.concat(F.lit(title + "\n- "), F.concat_ws("\n- ", items)))

    none = (F.size("missing") + F.size("cardinal") + F.size("unsupported")) == 0
    return lists.select(F.lit(name).alias("dataset_name"), F.concat_ws(
        "\n\n",
        F.concat(F.lit("Total Rows: "), grouped(F.col("rows")), F.lit("\nTotal Columns: "), F.col("columns").cast("string")),
        F.concat_ws("\n\n", "facts"),
        block("Missing Data Issues:", "missing"), block("High Cardinality Columns:", "cardinal"),
        block("Other Column Issues:", "unsupported"),
        F.when(none, F.lit("- No major data quality issues detected"))).alias("facts"))


def profile_context(summary: DataFrame, distribution: DataFrame) -> DataFrame:
    """One row: the short profile text from ``table_summary`` and ``type_distribution``."""
    types = distribution.agg(F.concat_ws(", ", F.array_sort(F.collect_list(  # one entry per type
        F.concat("var_type", F.lit(": "), F.col("columns").cast("string"))))).alias("types"))
    return summary.crossJoin(F.broadcast(types)).select(F.concat(  # one row each
        F.lit("Variables: "), F.col("n_var").cast("string"), F.lit("\nObservations: "), grouped(F.col("n")),
        F.lit("\nMissing data: "), fixed(F.col("missing_percentage"), 1), F.lit("% of cells\nDuplicate rows: "),
        fixed(F.col("duplicate_percentage"), 1), F.lit("%\nVariable types: "), F.col("types")).alias("context"))


def detailed_context(types: DataFrame, summary: DataFrame, distribution: DataFrame, shown: int = 5) -> DataFrame:
    """One row: the dataset header of ``profile_context`` and a line for each of the first variables."""
    line = F.concat(F.lit("- "), "column_name", F.lit(": "), "var_type", F.lit(", "), F.col("null_count").cast("string"),
                    F.lit(" missing, "), F.col("distinct").cast("string"), F.lit(" unique values"))
    lines = types.where(F.col("position") < shown).agg(F.transform(  # at most ``shown`` entries
        F.array_sort(F.collect_list(F.struct("position", line.alias("t")))), lambda s: s["t"]).alias("lines"))
    return profile_context(summary, distribution).crossJoin(F.broadcast(lines)).select(  # one row each
        F.concat_ws("\n", "context", "lines").alias("context"))


def outlier_context(outliers: DataFrame, rows: int) -> DataFrame:
    """One row: totals and a line per column with outliers."""
    line = F.concat(F.lit("- "), "column_name", F.lit(": "), F.col("outliers").cast("string"), F.lit(" outliers ("),
                    fixed(F.col("rate"), 2), F.lit("%), method: "), "method")
    lines = outliers.agg(  # one line per numeric column
        F.coalesce(F.sum("outliers"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("columns"),
        F.transform(F.array_sort(F.collect_list(F.struct("position", line.alias("t")))), lambda s: s["t"]).alias("lines"))
    return lines.select(F.concat_ws(
        "\n", F.concat(F.lit("Total Outliers Detected: "), F.col("total").cast("string")),
        F.concat(F.lit("Overall Outlier Rate: "), fixed(ratio(F.col("total"), F.lit(rows)) * 100, 2), F.lit("%")),
        F.concat(F.lit("Columns with Outliers: "), F.col("columns").cast("string")),
        F.concat(F.lit("Dataset Size: "), grouped(F.lit(rows)), F.lit(" rows")),
        F.concat_ws("\n", "lines")).alias("context"))


def readiness_context(issues: DataFrame, score: DataFrame) -> DataFrame:
    """One row: issue counts and a line per issue."""
    line = F.concat(F.lit("- "), "title", F.lit(" ("), "severity", F.lit("): "), "description")
    lines = issues.agg(F.transform(  # at most one line per check
        F.array_sort(F.collect_list(F.struct("severity_rank", line.alias("t")))), lambda s: s["t"]).alias("lines"))
    return score.crossJoin(F.broadcast(lines)).select(F.concat_ws(  # one row each
        "\n", *[F.concat(F.lit(f"{label}: "), F.col(c).cast("string")) for label, c in (
            ("Total Issues Found", "total_issues"), ("Critical Issues", "critical_issues"),
            ("High Priority Issues", "high_issues"), ("Medium Priority Issues", "medium_issues"))],
        F.when(F.size("lines") > 0, F.concat_ws("\n", "lines")).otherwise(
            F.lit("No significant issues detected"))).alias("context"))


def lineage_context(facts: DataFrame) -> DataFrame:
    """One line per lineage fact."""
    return facts.select("fact", F.concat("fact", F.lit(": "), "value", F.lit(" ("), F.col("count").cast("string"),
                                         F.lit(")")).alias("line"))
