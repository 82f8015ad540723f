"""Profiles, rules, readiness, overviews and recommendations over the derived views."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.functions.text import fixed
from plumbline.operators import frequency, overview, profile, readiness, recommend, rules, sketches
from plumbline.plans import profile_sql as S
from plumbline.plans.catalog import query
from plumbline.plans.fixtures import base, sql, view


def rounded(df: DataFrame, digits: int = 4, **special: int) -> DataFrame:
    """Doubles to a fixed number of digits, so that summation order does not show.

    ``special`` names columns whose values can sit half-way between two such numbers.
    Adding zero turns a negative zero into zero.
    """
    return df.selectExpr(*[f"round(`{n}`, {special.get(n, digits)}) + 0.0D AS `{n}`" if t == "double" else f"`{n}`"
                           for n, t in df.dtypes])


def profile_view(df: DataFrame) -> DataFrame:
    """The comparable columns of a profile."""
    mode = F.when(F.col("data_type") == "float", fixed(F.col("mode").try_cast("double"), 4)).otherwise(F.col("mode"))
    return rounded(df.select("position", "column_name", "data_type", "total_count", "null_count", "null_percentage",
                             "unique_count", "duplicate_count", "mean", "median", "std", "min_value", "max_value",
                             mode.alias("mode"), "outliers_count"))


PROFILE_SELECT = """
SELECT position, column_name, data_type, total_count, null_count, round(null_percentage, 4) AS null_percentage,
  unique_count, total_count - unique_count AS duplicate_count, round(mean, 4) AS mean, round(median, 4) AS median,
  round(std, 4) AS std, round(min_value, 4) AS min_value, round(max_value, 4) AS max_value, mode,
  CAST(outliers_count AS BIGINT) AS outliers_count FROM facts"""


def _profiled(spark, sf_dir, name="dirty_lineitem"):
    return profile.profile_columns(view(spark, sf_dir, name))


@query("profile_columns", S.facts("dirty_lineitem", S.DIRTY_LINEITEM) + PROFILE_SELECT)
def profile_columns(spark, sf_dir):
    return profile_view(_profiled(spark, sf_dir))


@query("profile_events", S.facts("events", S.EVENTS) + PROFILE_SELECT)
def profile_events(spark, sf_dir):
    return profile_view(_profiled(spark, sf_dir, "events"))


@query("column_issues", S.scored("dirty_lineitem", S.DIRTY_LINEITEM)
       + " SELECT position, column_name, issue FROM issues")
def column_issues(spark, sf_dir):
    return _profiled(spark, sf_dir).select("position", "column_name", F.explode("data_quality_issues").alias("issue"))


@query("id_gaps", S.scored("dirty_customer", S.DIRTY_CUSTOMER) + " SELECT position, column_name, issue FROM issues")
def id_gaps(spark, sf_dir):
    return _profiled(spark, sf_dir, "dirty_customer").select(
        "position", "column_name", F.explode("data_quality_issues").alias("issue"))


@query("quality_score", S.scored("dirty_lineitem", S.DIRTY_LINEITEM)
       + " SELECT round(avg(quality_score), 4) AS overall_quality_score FROM scored")
def quality_score(spark, sf_dir):
    return rounded(rules.quality_score(_profiled(spark, sf_dir)))


@query("column_scores", S.scored("dirty_lineitem", S.DIRTY_LINEITEM) + """
SELECT position, column_name, CAST(issue_count AS INTEGER) AS issue_count, round(quality_score, 4) AS quality_score FROM scored""")
def column_scores(spark, sf_dir):
    return rounded(_profiled(spark, sf_dir).select(
        "position", "column_name", F.size("data_quality_issues").alias("issue_count"), "quality_score"))


CRITICAL = """
, named AS (
  SELECT 'High null rate in ' AS lead, 1 AS k, list(column_name ORDER BY position) AS cols FROM scored WHERE null_percentage > 50
  UNION ALL
  SELECT 'Multiple issues in ', 2, list(column_name ORDER BY position) FROM scored WHERE issue_count >= 2)
SELECT lead || CAST(len(cols) AS VARCHAR) || ' columns: ' || array_to_string(cols[1:3], ', ')
  || CASE WHEN len(cols) > 3 THEN '...' ELSE '' END AS issue FROM named WHERE len(cols) > 0"""


@query("critical_issues", S.scored("dirty_lineitem", S.DIRTY_LINEITEM) + CRITICAL)
def critical_issues(spark, sf_dir):
    return rules.critical_issues(_profiled(spark, sf_dir)).select(F.explode("critical_issues").alias("issue"))


@query("quality_report", S.scored("dirty_lineitem", S.DIRTY_LINEITEM) + """
SELECT 'lineitem' AS dataset_name, max(total_count) AS total_rows, count(*) AS total_columns,
  round(avg(quality_score), 4) AS overall_quality_score FROM scored""")
def quality_report(spark, sf_dir):
    return rounded(profile.quality_report(_profiled(spark, sf_dir), "lineitem").select(
        "dataset_name", "total_rows", "total_columns", "overall_quality_score"))


SAMPLES = "WITH v AS (SELECT * FROM part) " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(row_number() OVER (ORDER BY {c}) AS INTEGER) AS rank, CAST({c} AS VARCHAR) AS value "
    f"FROM (SELECT DISTINCT {c} FROM v WHERE {c} IS NOT NULL ORDER BY {c} LIMIT 5)"
    for c, k in S.PART if k != "float")


@query("sample_values", SAMPLES)
def sample_values(spark, sf_dir):
    return frequency.sample_values(base(spark, sf_dir, "part").drop("p_retailprice"), 5)


@query("first_values", """
SELECT column_name, rank, value FROM (
  SELECT 'event_id' AS column_name, CAST(row_number() OVER (ORDER BY ts) AS INTEGER) AS rank, CAST(event_id AS VARCHAR) AS value FROM events
  UNION ALL SELECT 'event_type', CAST(row_number() OVER (ORDER BY ts) AS INTEGER), event_type FROM events)
WHERE rank <= 5""")
def first_values(spark, sf_dir):
    got = frequency.sample_values(base(spark, sf_dir, "events").select("event_id", "event_type", "ts"), 5, "ts")
    return got.where(F.col("column_name") != "ts")


@query("duplicate_rows", f"""
SELECT (SELECT count(*) FROM {sql('dirty_lineitem')} a) AS total_rows, {S.duplicates('dirty_lineitem')} AS duplicate_rows""")
def duplicate_rows(spark, sf_dir):
    return frequency.duplicate_rows(view(spark, sf_dir, "dirty_lineitem"))


SUMMARY = S.facts("dirty_lineitem", S.DIRTY_LINEITEM) + f""", summary AS (
SELECT count(*) AS n_var, max(total_count) AS n, CAST(sum(null_count) AS BIGINT) AS n_cells_missing,
  CAST(sum(null_count) AS DOUBLE) / CAST(sum(total_count) AS DOUBLE) * 100 AS missing_percentage,
  {S.duplicates('dirty_lineitem')} AS n_duplicates,
  CAST({S.duplicates('dirty_lineitem')} AS DOUBLE) / max(total_count) * 100 AS duplicate_percentage,
  count(*) FILTER (WHERE is_constant) AS n_constant FROM facts)"""


@query("table_summary", SUMMARY + """
SELECT n_var, n, n_cells_missing, round(missing_percentage, 4) AS missing_percentage, n_duplicates,
  round(duplicate_percentage, 4) AS duplicate_percentage, n_constant FROM summary""")
def table_summary(spark, sf_dir):
    return rounded(profile.table_summary(view(spark, sf_dir, "dirty_lineitem")).drop("alerts"))


@query("summary_alerts", SUMMARY + """
SELECT 'High missing data: ' || printf('%.1f', missing_percentage) || '% of cells are missing' AS alert FROM summary WHERE missing_percentage > 10
UNION ALL SELECT 'Duplicate rows detected: ' || printf('%.1f', duplicate_percentage) || '% of rows are duplicates' FROM summary WHERE duplicate_percentage > 5
UNION ALL SELECT 'Constant variables: ' || n_constant || ' variables have only one unique value' FROM summary WHERE n_constant > 0""")
def summary_alerts(spark, sf_dir):
    return profile.table_summary(view(spark, sf_dir, "dirty_lineitem")).select(F.explode("alerts").alias("alert"))


@query("report_issues", SUMMARY + """
, high AS (SELECT list(column_name ORDER BY position) AS cols FROM facts WHERE null_percentage > 10),
flat AS (SELECT list(column_name ORDER BY position) AS cols FROM facts WHERE is_constant OR present_count = 0)
SELECT 'High missing data in ' || len(cols) || ' variables: ' || array_to_string(cols[1:3], ', ')
  || CASE WHEN len(cols) > 3 THEN '...' ELSE '' END AS issue FROM high WHERE len(cols) > 0
UNION ALL SELECT 'Duplicate rows detected: ' || printf('%.1f', duplicate_percentage) || '% of the dataset' FROM summary WHERE duplicate_percentage > 5
UNION ALL SELECT 'Constant variables found: ' || array_to_string(cols, ', ') FROM flat WHERE len(cols) > 0""")
def report_issues(spark, sf_dir):
    return profile.report_issues(view(spark, sf_dir, "dirty_lineitem"))


VAR_TYPE = """CASE WHEN present_count = 0 THEN 'Unsupported' WHEN data_type IN ('integer', 'float') THEN 'Numeric'
  WHEN data_type = 'datetime' THEN 'DateTime' WHEN unique_count <= 50 THEN 'Categorical' ELSE 'Text' END"""


@query("type_distribution", S.facts("dirty_lineitem", S.DIRTY_LINEITEM) + f"""
SELECT var_type, count(*) AS columns, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS percentage
FROM (SELECT {VAR_TYPE} AS var_type FROM facts) GROUP BY var_type""")
def type_distribution(spark, sf_dir):
    return rounded(profile.type_distribution(profile.variable_types(view(spark, sf_dir, "dirty_lineitem"))))


@query("variable_status", S.facts("dirty_lineitem", S.DIRTY_LINEITEM) + f"""
SELECT position, column_name, var_type, CASE var_type WHEN 'Numeric' THEN 'Mean: ' || printf('%.2f', mean)
    WHEN 'Categorical' THEN 'Categories: ' || unique_count WHEN 'Text' THEN 'Max Length: ' || max_length ELSE '-' END AS key_statistic,
  CASE WHEN null_percentage > 50 THEN 'Critical' WHEN null_percentage > 20 THEN 'Warning'
    WHEN null_percentage > 5 THEN 'Attention' ELSE 'Good' END AS status
FROM (SELECT *, {VAR_TYPE} AS var_type FROM facts)""")
def variable_status(spark, sf_dir):
    return profile.variable_status(profile.variable_types(view(spark, sf_dir, "dirty_lineitem")))


TEXT_LENGTHS = "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, max(length({c})) AS max_length, min(length({c})) AS min_length, "
    f"round(avg(length({c})), 4) AS mean_length, "
    f"round(avg(len(list_filter(regexp_split_to_array({c}, '[\\s\\p{{Z}}\\x0b\\x1c-\\x1f\\x85]+'), lambda x: x <> ''))), 4) AS mean_words "
    f"FROM documents" for c in ("text", "lang", "source")) + ")"


@query("text_profile", TEXT_LENGTHS)
def text_profile(spark, sf_dir):
    types = profile.variable_types(base(spark, sf_dir, "documents").select("text", "lang", "source"))
    return rounded(types.select("column_name", F.col("max_length").cast("bigint").alias("max_length"),
                                F.col("min_length").cast("bigint").alias("min_length"), "mean_length", "mean_words"))


DETAIL_QUANTILES = (5, 25, 50, 75, 95)
DETAIL = " UNION ALL ".join(f"""SELECT '{c}' AS column_name, count({c}) AS n, count(*) FILTER (WHERE {c} = 0) AS n_zeros,
  count(*) FILTER (WHERE {c} < 0) AS n_negative, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
  CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max,
  round(sum(power({c} - m, 3)) / count(*) / power(var_pop({c}), 1.5), 4) + 0.0 AS skewness,
  round(sum(power({c} - m, 4)) / count(*) / power(var_pop({c}), 2) - 3, 4) + 0.0 AS kurtosis,
  {', '.join(f"round(quantile_cont({c}, {q / 100}), 4) AS q{q:02d}" for q in DETAIL_QUANTILES)}
FROM part, (SELECT avg({c}) AS m FROM part)""" for c in S.numeric(S.PART))


@query("profile_detail", DETAIL)
def profile_detail(spark, sf_dir):
    return rounded(profile.profile_detail(base(spark, sf_dir, "part")).drop("histogram"))


@query("value_histogram", """
SELECT CAST(least(9, floor((value - lo) / ((hi - lo) / 10))) AS INTEGER) AS bin, count(*) AS cells
FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events) GROUP BY 1""")
def value_histogram(spark, sf_dir):
    detail = profile.profile_detail(base(spark, sf_dir, "events").select("value"))
    return detail.select(F.posexplode("histogram").alias("bin", "cells")).where(F.col("cells") > 0)


@query("describe_numeric", " UNION ALL ".join(f"""SELECT '{c}' AS column_name, count({c}) AS count, round(avg({c}), 4) AS mean,
  round(stddev_samp({c}), 4) AS std, round(CAST(min({c}) AS DOUBLE), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS p25,
  round(quantile_cont({c}, 0.5), 4) AS p50, round(quantile_cont({c}, 0.75), 4) AS p75, round(CAST(max({c}) AS DOUBLE), 4) AS max
FROM {sql('dirty_lineitem')} v""" for c in S.numeric(S.DIRTY_LINEITEM)))
def describe_numeric(spark, sf_dir):
    return rounded(profile.describe_numeric(view(spark, sf_dir, "dirty_lineitem")))


@query("top_values", """
SELECT user_id, count(*) AS count FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def top_values(spark, sf_dir):
    return frequency.top_values(base(spark, sf_dir, "events"), "user_id", 10)


@query("group_counts", "SELECT event_type, user_id, count(*) AS count FROM events GROUP BY 1, 2")
def group_counts(spark, sf_dir):
    return frequency.value_counts(base(spark, sf_dir, "events"), "event_type", "user_id")


MIXED = S.facts("dirty_lineitem", S.DIRTY_LINEITEM) + """, mixed AS (SELECT position, column_name, unique_count AS distinct_values,
  CAST(numeric_cells AS DOUBLE) / nullif(present_count, 0) AS numeric_share,
  coalesce(CAST(numeric_cells AS DOUBLE) / nullif(present_count, 0) > 0.1
    AND CAST(numeric_cells AS DOUBLE) / nullif(present_count, 0) < 0.9, FALSE) AS is_mixed
  FROM facts WHERE data_type = 'string')"""


@query("mixed_types", MIXED + """
SELECT position, column_name, distinct_values, round(numeric_share, 4) AS numeric_share, is_mixed FROM mixed""")
def mixed_types(spark, sf_dir):
    return rounded(readiness.mixed_types(view(spark, sf_dir, "dirty_lineitem")).withColumnRenamed("distinct", "distinct_values"))


@query("mixed_types_sample", f"""
WITH head AS (SELECT mixed_col FROM (SELECT *, concat(CAST(l_orderkey AS STRING), '/', CAST(l_linenumber AS STRING), '/', CAST(l_partkey AS STRING), '/', CAST(l_suppkey AS STRING), '/', CAST(l_extendedprice AS STRING)) AS k
   FROM {sql('dirty_lineitem')} v) ORDER BY l_shipdate, l_partkey, l_orderkey, l_suppkey, l_linenumber LIMIT 100)
SELECT 'mixed_col' AS column_name,
  round(CAST(count(*) FILTER (WHERE regexp_matches(mixed_col, '{S.NUMBER_TEXT}')) AS DOUBLE) / count(*), 4) AS numeric_share
FROM head""")
def mixed_types_sample(spark, sf_dir):
    df = view(spark, sf_dir, "dirty_lineitem").select(
        "mixed_col", F.struct("l_shipdate", "l_partkey", "l_orderkey", "l_suppkey", "l_linenumber").alias("at"))
    return rounded(readiness.mixed_types(df, sample_rows=100, order_col="at").select("column_name", "numeric_share"))


def fences(cols, view_name: str, multiplier: float = 1.5) -> str:
    """SQL: one row per numeric column with the number of values outside the fences."""
    return " UNION ALL ".join(f"""SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} < q1 - {multiplier} * (q3 - q1) OR {c} > q3 + {multiplier} * (q3 - q1)) AS outliers
FROM {sql(view_name)} v, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {sql(view_name)} w)""" for c in S.numeric(cols))


def readiness_sql(view_name: str, cols) -> str:
    return S.facts(view_name, cols) + f""", fence AS ({fences(cols, view_name)}),
flags AS (SELECT f.*, coalesce(CAST(o.outliers AS DOUBLE) / total_count > 0.05, FALSE) AS high_outliers,
  data_type = 'string' AND CAST(unique_count AS DOUBLE) / total_count > 0.95 AND unique_count > 100 AS high_cardinality,
  data_type = 'string' AND coalesce(CAST(numeric_cells AS DOUBLE) / nullif(present_count, 0) > 0.1
    AND CAST(numeric_cells AS DOUBLE) / nullif(present_count, 0) < 0.9, FALSE) AS mixed_types
  FROM facts f LEFT JOIN fence o ON f.column_name = o.column_name),
dup AS (SELECT {S.duplicates(view_name)} AS d, (SELECT count(*) FROM v) AS n),
listed AS (
  SELECT 1 AS k, list(column_name ORDER BY position) AS cols FROM flags WHERE present_count = 0
  UNION ALL SELECT 2, list(column_name ORDER BY position) FROM flags WHERE null_percentage > 80
  UNION ALL SELECT 3, (SELECT list(column_name ORDER BY position) FROM flags) FROM dup WHERE d > n * 0.1
  UNION ALL SELECT 4, list(column_name ORDER BY position) FROM flags WHERE is_constant
  UNION ALL SELECT 5, list(column_name ORDER BY position) FROM flags WHERE high_cardinality
  UNION ALL SELECT 6, list(column_name ORDER BY position) FROM flags WHERE high_outliers
  UNION ALL SELECT 7, list(column_name ORDER BY position) FROM flags WHERE mixed_types),
named(k, title, severity, told, recommendation) AS (VALUES
  (1, 'Empty Columns Detected', 'critical', ' completely empty columns will break SQL queries and analytics', 'Remove empty columns before running analytics'),
  (2, 'Extreme Missing Data', 'critical', ' columns with >80% missing data will cause analytics to fail', 'Remove or impute missing data before analytics'),
  (3, 'High Duplicate Rate', 'high', '', 'Remove duplicate records to ensure accurate analytics'),
  (4, 'Constant Columns', 'medium', ' columns with only one value provide no analytical value', 'Remove constant columns to improve model performance'),
  (5, 'High Cardinality Categorical Columns', 'medium', ' categorical columns with very high cardinality may cause memory issues', 'Consider grouping rare categories or using embedding techniques'),
  (6, 'High Outlier Rate', 'medium', ' numeric columns have >5% outliers which may affect ML models', 'Consider outlier treatment (removal, capping, or transformation)'),
  (7, 'Mixed Data Types', 'high', ' columns contain mixed data types which will cause analytics errors', 'Clean and standardize data types before analytics')),
found AS (SELECT title, severity, CASE WHEN k = 3 THEN (SELECT d || ' duplicate records (' || printf('%.1f', CAST(d AS DOUBLE) / n * 100) || '%) will skew analytics results' FROM dup)
    ELSE len(cols) || told END AS description, array_to_string(cols, ', ') AS affected_columns, recommendation
  FROM listed JOIN named USING (k) WHERE len(cols) > 0),
counts AS (SELECT count(*) FILTER (WHERE severity = 'critical') AS c, count(*) FILTER (WHERE severity = 'high') AS h,
  count(*) FILTER (WHERE severity = 'medium') AS m, count(*) AS t FROM found),
score AS (SELECT *, least(greatest(0, greatest(0, greatest(0, greatest(0, 100 - c * 70) - h * 40) - m * 20) - greatest(0, t - 3) * 10),
  CASE WHEN c > 0 THEN 40 WHEN h >= 2 THEN 60 WHEN h > 0 THEN 75 ELSE 100 END) AS s FROM counts)"""


READINESS_SCORE = """
SELECT c AS critical_issues, h AS high_issues, m AS medium_issues, t AS total_issues, CAST(s AS BIGINT) AS quality_score,
  CASE WHEN s >= 85 THEN 'Excellent' WHEN s >= 70 THEN 'Good' WHEN s >= 50 THEN 'Fair' WHEN s >= 30 THEN 'Poor' ELSE 'Critical' END AS verdict
FROM score"""


@query("readiness_issues", readiness_sql("dirty_lineitem", S.DIRTY_LINEITEM) + " SELECT * FROM found")
def readiness_issues(spark, sf_dir):
    return readiness.readiness_issues(view(spark, sf_dir, "dirty_lineitem")).select(
        "title", "severity", "description", F.concat_ws(", ", "affected_columns").alias("affected_columns"), "recommendation")


@query("readiness_score", readiness_sql("dirty_lineitem", S.DIRTY_LINEITEM) + READINESS_SCORE)
def readiness_score(spark, sf_dir):
    return readiness.readiness_score(readiness.readiness_issues(view(spark, sf_dir, "dirty_lineitem"))).drop("assessment")


@query("readiness_customer", readiness_sql("dirty_customer", S.DIRTY_CUSTOMER) + " SELECT * FROM found")
def readiness_customer(spark, sf_dir):
    return readiness.readiness_issues(view(spark, sf_dir, "dirty_customer")).select(
        "title", "severity", "description", F.concat_ws(", ", "affected_columns").alias("affected_columns"), "recommendation")


@query("readiness_orders", readiness_sql("skewed_orders", S.SKEWED_ORDERS) + READINESS_SCORE)
def readiness_orders(spark, sf_dir):
    return readiness.readiness_score(readiness.readiness_issues(view(spark, sf_dir, "skewed_orders"))).drop("assessment")


def overview_sql(view_name: str, cols) -> str:
    return S.facts(view_name, cols) + f""", o AS (SELECT max(total_count) AS n, count(*) AS w,
  (sum(total_count) - sum(null_count)) / CAST(sum(total_count) AS DOUBLE) * 100 AS completeness,
  CAST(sum(null_count) AS BIGINT) AS missing_cells, {S.duplicates(view_name)} AS d,
  count(*) FILTER (WHERE present_count = 0) AS empties, count(*) FILTER (WHERE unique_count <= 1) AS flats,
  count(*) FILTER (WHERE data_type = 'string' AND present_count > 10
    AND CAST(numeric_cells AS DOUBLE) / nullif(present_count, 0) > 0.1 AND CAST(numeric_cells AS DOUBLE) / nullif(present_count, 0) < 0.9) AS mixed
  FROM facts), p AS (SELECT *, CAST(n - d AS DOUBLE) / n * 100 AS consistency FROM o)"""


@query("dataset_overview", overview_sql("dirty_lineitem", S.DIRTY_LINEITEM) + """,
q AS (SELECT *, greatest(0.0, 100 - CAST(mixed AS DOUBLE) / w * 100) AS validity FROM p),
r AS (SELECT *, completeness * 0.4 + consistency * 0.3 + validity * 0.3 AS quality_score FROM q)
SELECT 'lineitem' AS dataset_name, 'FILE' AS source_type, n AS rows, w AS columns, round(completeness, 4) AS completeness,
  round(consistency, 4) AS consistency, round(validity, 4) AS validity, round(quality_score, 4) AS quality_score,
  CASE WHEN quality_score >= 90 THEN 'A' WHEN quality_score >= 80 THEN 'B' WHEN quality_score >= 70 THEN 'C' WHEN quality_score >= 60 THEN 'D' ELSE 'F' END AS grade FROM r""")
def dataset_overview(spark, sf_dir):
    return rounded(overview.dataset_overview(view(spark, sf_dir, "dirty_lineitem"), "lineitem"))


@query("overview_score", overview_sql("dirty_customer", S.DIRTY_CUSTOMER) + """
SELECT n AS rows, w AS columns, round(completeness * 0.6 + consistency * 0.4, 4) AS data_quality FROM p""")
def overview_score(spark, sf_dir):
    return rounded(overview.header_score(view(spark, sf_dir, "dirty_customer")))


OVERVIEW_DETAIL = overview_sql("dirty_lineitem", S.DIRTY_LINEITEM) + """,
q AS (SELECT *, greatest(0.0, 100 - CAST(empties + flats AS DOUBLE) / w * 100) AS validity FROM p)"""


@query("overview_detail", OVERVIEW_DETAIL + """
SELECT round(completeness, 4) AS completeness, round(consistency, 4) AS consistency, round(validity, 4) AS validity,
  missing_cells, d AS duplicate_rows, empties AS empty_columns, flats AS constant_columns,
  round(completeness * 0.4 + consistency * 0.3 + validity * 0.3, 4) AS overall_quality FROM q""")
def overview_detail(spark, sf_dir):
    return rounded(overview.overview_detail(view(spark, sf_dir, "dirty_lineitem")).drop("alerts"))


@query("overview_alerts", OVERVIEW_DETAIL + """
SELECT 'Low completeness: ' || format('{:,}', missing_cells) || ' missing values' AS alert FROM q WHERE completeness < 90
UNION ALL SELECT 'Data duplicates: ' || format('{:,}', d) || ' duplicate rows' FROM q WHERE d > 0
UNION ALL SELECT 'Empty columns: ' || empties || ' columns with no data' FROM q WHERE empties > 0
UNION ALL SELECT 'Constant columns: ' || flats || ' columns with only one value' FROM q WHERE flats > 0""")
def overview_alerts(spark, sf_dir):
    return overview.overview_detail(view(spark, sf_dir, "dirty_lineitem")).select(F.explode("alerts").alias("alert"))


@query("column_quality", S.facts("dirty_lineitem", S.DIRTY_LINEITEM) + """
SELECT position, column_name, dtype AS type, present_count AS non_null, null_count AS missing,
  round(null_percentage, 4) AS missing_percentage, unique_count AS unique_values,
  CASE WHEN null_percentage = 100 THEN 'Empty' WHEN unique_count <= 1 THEN 'Constant' WHEN null_percentage > 50 THEN 'Poor'
    WHEN null_percentage > 20 THEN 'Fair' WHEN null_percentage > 5 THEN 'Good' ELSE 'Excellent' END AS quality FROM facts""")
def column_quality(spark, sf_dir):
    return rounded(overview.column_quality(view(spark, sf_dir, "dirty_lineitem")))


@query("column_overview", S.facts("dirty_customer", S.DIRTY_CUSTOMER) + """
SELECT position, column_name, dtype AS type, present_count AS non_null_count, null_count, round(null_percentage, 2) AS null_percentage FROM facts""")
def column_overview(spark, sf_dir):
    return overview.column_overview(view(spark, sf_dir, "dirty_customer"))


@query("snapshot_score", overview_sql("dirty_lineitem", S.DIRTY_LINEITEM) + """
SELECT round(completeness * 0.7 + consistency * 0.3, 2) AS data_quality_score FROM p""")
def snapshot_score(spark, sf_dir):
    return overview.snapshot_score(view(spark, sf_dir, "dirty_lineitem"))


RECOMMEND = S.scored("dirty_lineitem", S.DIRTY_LINEITEM) + """, recs AS (
SELECT 1 AS rank, 'data_validation' AS category, 'high' AS priority, 'Address High Missing Value Rates' AS title,
  (SELECT string_agg(column_name, ', ' ORDER BY position) FROM scored WHERE null_percentage > 20) AS affected_columns
WHERE EXISTS (SELECT 1 FROM scored WHERE null_percentage > 20)
UNION ALL SELECT 2, 'data_cleaning', 'medium', 'Review and Handle Outliers',
  (SELECT string_agg(DISTINCT column_name, ', ') FROM issues WHERE issue LIKE '%OUTLIER%')
WHERE EXISTS (SELECT 1 FROM issues WHERE issue LIKE '%OUTLIER%')
UNION ALL SELECT 3, 'data_monitoring', 'high', 'Implement Comprehensive Data Quality Monitoring', ''
WHERE (SELECT avg(quality_score) FROM scored) < 80)"""


@query("recommendations", RECOMMEND + " SELECT * FROM recs")
def recommendations(spark, sf_dir):
    return recommend.recommendations(_profiled(spark, sf_dir)).select(
        "rank", "category", "priority", "title", F.concat_ws(", ", "affected_columns").alias("affected_columns"))


@query("recommendation_summary", RECOMMEND + """
SELECT 'total' AS facet, 'recommendations' AS name, count(*) AS count FROM recs
UNION ALL SELECT 'priority', priority, count(*) FROM recs GROUP BY 2
UNION ALL SELECT 'category', category, count(*) FROM recs GROUP BY 2
UNION ALL SELECT 'high_priority_title', title, count(*) FROM recs WHERE priority = 'high' GROUP BY 2""")
def recommendation_summary(spark, sf_dir):
    return recommend.recommendation_summary(recommend.recommendations(_profiled(spark, sf_dir)))


FACT_LINES = S.facts("dirty_lineitem", S.DIRTY_LINEITEM) + f""", t AS (SELECT *, {VAR_TYPE} AS var_type, data_type = 'string' AND present_count > 0 AS textual,
  CAST(unique_count AS DOUBLE) / total_count * 100 AS unique_pct FROM facts),
dates AS (SELECT 'l_shipdate' AS column_name, strftime(min(l_shipdate), '%Y-%m-%d %H:%M:%S') AS first_time, strftime(max(l_shipdate), '%Y-%m-%d %H:%M:%S') AS last_time FROM v),
words AS ({' UNION ALL '.join(f"SELECT '{c}' AS column_name, avg(len(list_filter(regexp_split_to_array({c}, '[ ]+'), lambda x: x <> ''))) AS w FROM v" for c, k in S.DIRTY_LINEITEM if k == 'string')}),
lines AS (SELECT position, t.column_name, total_count, null_percentage, unique_count, unique_pct, var_type,
  concat_ws(chr(10), 'Column: ' || t.column_name, '  - Data Type: ' || var_type,
  '  - Missing Values: ' || null_count || ' (' || printf('%.1f', null_percentage) || '%)',
  '  - Unique Values: ' || unique_count || ' (' || printf('%.1f', unique_pct) || '%)',
  CASE WHEN var_type = 'Numeric' THEN '  - Range: ' || printf('%.2f', min_value) || ' to ' || printf('%.2f', max_value) END,
  CASE WHEN var_type = 'Numeric' THEN '  - Mean: ' || printf('%.2f', mean) END,
  CASE WHEN var_type = 'Numeric' THEN '  - Std Dev: ' || printf('%.2f', std) END,
  CASE WHEN textual THEN '  - Most Frequent: ' || mode END,
  CASE WHEN textual THEN '  - Avg Length: ' || printf('%.2f', w) END,
  CASE WHEN var_type = 'DateTime' THEN '  - Date Range: ' || first_time || ' to ' || last_time END,
  CASE WHEN null_percentage > 10 THEN '  ! HIGH MISSING RATE (' || printf('%.1f', null_percentage) || '%)' END,
  CASE WHEN unique_pct > 90 THEN '  ! HIGH CARDINALITY (' || printf('%.1f', unique_pct) || '% unique)' END,
  CASE WHEN var_type = 'Unsupported' THEN '  ! UNSUPPORTED DATA TYPE' END) AS facts
FROM t LEFT JOIN words USING (column_name) LEFT JOIN dates USING (column_name))"""


@query("analysis_facts", FACT_LINES + " SELECT position, column_name, facts FROM lines")
def analysis_facts(spark, sf_dir):
    return recommend.column_facts_text(profile.variable_types(view(spark, sf_dir, "dirty_lineitem")))


def _block(title: str, item: str, test: str) -> str:
    return f"'{title}:' || chr(10) || '- ' || string_agg({item}, chr(10) || '- ' ORDER BY position) FILTER (WHERE {test})"


@query("dataset_facts", FACT_LINES + f"""
SELECT 'lineitem' AS dataset_name, concat_ws(chr(10) || chr(10),
  'Total Rows: ' || format('{{:,}}', max(total_count)) || chr(10) || 'Total Columns: ' || count(*),
  string_agg(facts, chr(10) || chr(10) ORDER BY position),
  {_block('Missing Data Issues', "column_name || ' (' || printf('%.1f', null_percentage) || '% missing)'", 'null_percentage > 10')},
  {_block('High Cardinality Columns', "column_name || ' (' || unique_count || ' unique values)'", 'unique_pct > 90')},
  {_block('Other Column Issues', "'Unsupported data type in column: ' || column_name", "var_type = 'Unsupported'")},
  CASE WHEN count(*) FILTER (WHERE null_percentage > 10 OR unique_pct > 90 OR var_type = 'Unsupported') = 0
    THEN '- No major data quality issues detected' END) AS facts FROM lines""")
def dataset_facts(spark, sf_dir):
    return recommend.dataset_facts_text(profile.variable_types(view(spark, sf_dir, "dirty_lineitem")), "lineitem")


CONTEXT = SUMMARY + f""", types AS (
  SELECT string_agg(x, ', ' ORDER BY x) AS t FROM (SELECT var_type || ': ' || count(*) AS x FROM (SELECT {VAR_TYPE} AS var_type FROM facts) GROUP BY var_type)),
context AS (SELECT 'Variables: ' || n_var || chr(10) || 'Observations: ' || format('{{:,}}', n) || chr(10) || 'Missing data: ' || printf('%.1f', missing_percentage)
  || '% of cells' || chr(10) || 'Duplicate rows: ' || printf('%.1f', duplicate_percentage) || '%' || chr(10) || 'Variable types: ' || t AS context
FROM summary, types)"""


@query("profile_context", CONTEXT + " SELECT context FROM context")
def profile_context(spark, sf_dir):
    df = view(spark, sf_dir, "dirty_lineitem")
    return recommend.profile_context(profile.table_summary(df), profile.type_distribution(profile.variable_types(df)))


@query("detailed_context", CONTEXT + f"""
SELECT context || chr(10) || (SELECT string_agg('- ' || column_name || ': ' || {VAR_TYPE} || ', ' || null_count || ' missing, ' || unique_count || ' unique values',
  chr(10) ORDER BY position) FROM facts WHERE position < 5) AS context FROM context""")
def detailed_context(spark, sf_dir):
    """The header and the first five of fifteen variables."""
    df = view(spark, sf_dir, "dirty_lineitem")
    types = profile.variable_types(df)
    return recommend.detailed_context(types, profile.table_summary(df), profile.type_distribution(types))


@query("readiness_context", readiness_sql("dirty_lineitem", S.DIRTY_LINEITEM) + """
SELECT 'Total Issues Found: ' || t || chr(10) || 'Critical Issues: ' || c || chr(10) || 'High Priority Issues: ' || h || chr(10)
  || 'Medium Priority Issues: ' || m || chr(10) || (SELECT string_agg('- ' || title || ' (' || severity || '): ' || description, chr(10)
    ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 ELSE 2 END, '- ' || title || ' (' || severity || '): ' || description) FROM found) AS context
FROM counts""")
def readiness_context(spark, sf_dir):
    issues = readiness.readiness_issues(view(spark, sf_dir, "dirty_lineitem"))
    return recommend.readiness_context(issues, readiness.readiness_score(issues))


TOP = """
SELECT {c}, count(*) AS count FROM {t} t WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT {k}"""


@query("top_values_sketched", TOP.format(c="user_id", t="events", k=10))
def top_values_sketched(spark, sf_dir):
    """Few values: the sketch holds them all."""
    return sketches.top_values_sketched(base(spark, sf_dir, "events"), "user_id", 10)


@query("top_values_proven", TOP.format(c="mixed_col", t=f"(SELECT CASE WHEN l_linenumber < 4 THEN 'n' || l_linenumber ELSE mixed_col END AS mixed_col FROM {sql('dirty_lineitem')} d)", k=3))
def top_values_proven(spark, sf_dir):
    """Three frequent values among very many: the sketch is small and the exact counts prove the answer."""
    lines = view(spark, sf_dir, "dirty_lineitem").selectExpr(
        "CASE WHEN l_linenumber < 4 THEN concat('n', l_linenumber) ELSE mixed_col END AS mixed_col")
    counted, proven = sketches.heavy_hitters(lines, "mixed_col", 3, tracked=150)
    if not proven:
        raise ValueError("the sketch should prove three values of a seventh of the rows each")
    return counted.orderBy(F.desc("count"), "value").limit(3).select(F.col("value").alias("mixed_col"), "count")


@query("top_values_unproven", TOP.format(c="l_partkey", t="lineitem", k=10))
def top_values_unproven(spark, sf_dir):
    """Values about equally frequent: all are counted."""
    return sketches.top_values_sketched(base(spark, sf_dir, "lineitem"), "l_partkey", 10, tracked=100)


DISTINCT = " UNION ALL ".join(f"SELECT {i} AS position, '{c}' AS column_name, count(DISTINCT {c}) AS distinct_values, TRUE AS is_near, TRUE AS is_mergeable FROM t"
                              for i, (c, _) in enumerate(S.DIRTY_LINEITEM))


@query("distinct_estimates", f"WITH t AS (SELECT * FROM {sql('dirty_lineitem')} d) {DISTINCT}")
def distinct_estimates(spark, sf_dir):
    """Exact distinct counts; whether one pass, and states merged from two divisions into parts, come within 3 % of them.

    Estimates of merged states vary a little with the parts, so they are held against the exact count, not one another.
    """
    lines = view(spark, sf_dir, "dirty_lineitem")
    exact, near = sketches.distinct_counts(lines), sketches.distinct_counts(lines, approximate=True)
    merged = [sketches.merged_states(sketches.distinct_states(lines.withColumn("part", F.expr(part)), ["part"])).select(
        "position", F.hll_sketch_estimate("state").alias(f"m{i}")) for i, part in enumerate(("l_orderkey % 7", "l_suppkey % 3"))]
    # one row per column of the table in each
    joined = exact.join(F.broadcast(near.select("position", F.col("distinct").alias("e"))), "position")
    for m in merged:
        joined = joined.join(F.broadcast(m), "position")
    within = {c: F.abs(F.col(c) - F.col("distinct")) <= 0.03 * F.col("distinct") for c in ("e", "m0", "m1")}
    return joined.select("position", "column_name", F.col("distinct").alias("distinct_values"), within["e"].alias("is_near"),
                         (within["m0"] & within["m1"]).alias("is_mergeable"))
