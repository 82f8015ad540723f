"""Row-level anomalies, outlier reports, rolling scores and the stream monitors."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.sizing import shared_folder
from plumbline.operators import anomaly, outliers, recommend, rolling
from plumbline.operators.scan import table_stats
from plumbline.plans import profile_sql as S
from plumbline.plans.catalog import query
from plumbline.plans.fixtures import base, sql, view
from plumbline.plans.profile_queries import fences, rounded
from plumbline.streaming import monitor


def stats_cte(column: str, source: str) -> str:
    """One row: everything the four methods need for one column."""
    return f"""(SELECT count({column}) AS n, avg({column}) AS mean, stddev_samp({column}) AS sd, min({column}) AS lo, max({column}) AS hi,
  quantile_cont({column}, 0.25) AS q1, quantile_cont({column}, 0.5) AS med, quantile_cont({column}, 0.75) AS q3,
  quantile_cont({column}, 0.02) AS p2, quantile_cont({column}, 0.98) AS p98, mad({column}) AS md FROM {source} x)"""


SCORES = {
    "zscore": ("2.0", "CASE WHEN sd > 0 AND abs(({c} - mean) / sd) > 2 THEN abs(({c} - mean) / sd) END"),
    "iqr": ("1.5", "CASE WHEN q3 > q1 AND {c} < q1 - 1.5 * (q3 - q1) THEN (q1 - 1.5 * (q3 - q1) - {c}) / (q3 - q1) "
                   "WHEN q3 > q1 AND {c} > q3 + 1.5 * (q3 - q1) THEN ({c} - (q3 + 1.5 * (q3 - q1))) / (q3 - q1) END"),
    "modified_zscore": ("3.5", "CASE WHEN md > 0 AND abs(0.6745 * ({c} - med) / md) > 3.5 THEN abs(0.6745 * ({c} - med) / md) END"),
    "isolation": ("0.02", "CASE WHEN {c} < p2 THEN (p2 - {c}) / (hi - lo) WHEN {c} > p98 THEN ({c} - p98) / (hi - lo) END"),
}


def scored_sql(cols, source: str, keys: str, methods) -> str:
    """Long SQL of (keys, column_name, method, value, score, threshold, n) for every value."""
    return " UNION ALL ".join(
        f"SELECT {keys}, '{c}' AS column_name, '{m}' AS method, CAST({c} AS DOUBLE) AS value, "
        f"{SCORES[m][1].format(c=c)} AS score, {SCORES[m][0]} AS threshold, n FROM {source} v, {stats_cte(c, source)} s"
        for c in cols for m in methods)


def one_method(method: str):
    text = scored_sql(["value"], "events", "event_id", [method])
    return f"SELECT event_id, value, round(score, 4) AS score FROM ({text}) WHERE score IS NOT NULL"


def _detect(spark, sf_dir, method):
    got = anomaly.detect_anomalies(base(spark, sf_dir, "events"), ["event_id"], [method], ["value"])
    return rounded(got.select("event_id", "value", "score"))


@query("zscore", one_method("zscore"))
def zscore(spark, sf_dir):
    return _detect(spark, sf_dir, "zscore")


@query("iqr", one_method("iqr"))
def iqr(spark, sf_dir):
    return _detect(spark, sf_dir, "iqr")


@query("modified_zscore", one_method("modified_zscore"))
def modified_zscore(spark, sf_dir):
    return _detect(spark, sf_dir, "modified_zscore")


@query("percentile_tail", one_method("isolation"))
def percentile_tail(spark, sf_dir):
    return _detect(spark, sf_dir, "isolation")


@query("stats_summary", " UNION ALL ".join(f"""
SELECT '{c}' AS column_name, round(mean, 4) AS mean, round(med, 4) AS median, round(sd, 4) AS std, round(md, 4) AS mad,
  round(q1, 4) AS q1, round(q3, 4) AS q3, round(q3 - q1, 4) AS iqr, round(q1 - 1.5 * (q3 - q1), 5) AS lower_bound,
  round(q3 + 1.5 * (q3 - q1), 5) AS upper_bound FROM {stats_cte(c, sql('skewed_orders'))}""" for c in S.numeric(S.SKEWED_ORDERS)))
def stats_summary(spark, sf_dir):
    return rounded(anomaly.statistical_summary(view(spark, sf_dir, "skewed_orders")), lower_bound=5, upper_bound=5)


@query("stats_summary_bracketed", " UNION ALL ".join(f"""
SELECT '{c}' AS column_name, round(mean, 4) AS mean, round(med, 4) AS median, round(md, 4) AS mad, round(q1, 4) AS q1, round(q3, 4) AS q3
FROM {stats_cte(c, sql('skewed_orders'))}""" for c in S.numeric(S.SKEWED_ORDERS)))
def stats_summary_bracketed(spark, sf_dir):
    """The way of large tables: sketches, counted brackets, ranking inside them; the view holds hot values."""
    return rounded(anomaly.statistical_summary(view(spark, sf_dir, "skewed_orders"), direct_rows=0, bracket_rows=200).select(
        "column_name", "mean", "median", "mad", "q1", "q3"))


ALL_ORDERS = scored_sql(S.numeric(S.SKEWED_ORDERS), sql("skewed_orders"), "o_orderkey", list(SCORES))
THREE = scored_sql(S.numeric(S.SKEWED_ORDERS), sql("skewed_orders"), "o_orderkey", list(anomaly.DEFAULT_METHODS))


@query("anomaly_all_columns", f"""
SELECT o_orderkey, column_name, method, round(value, 4) AS value, round(score, 4) AS score, threshold FROM ({ALL_ORDERS}) WHERE score IS NOT NULL""")
def anomaly_all_columns(spark, sf_dir):
    return rounded(anomaly.detect_anomalies(view(spark, sf_dir, "skewed_orders"), ["o_orderkey"], anomaly.METHODS))


@query("anomaly_summary", f"""
SELECT column_name, method, count(score) AS total_anomalies, round(count(score) * 100.0 / max(n), 4) AS anomaly_percentage,
  max(threshold) AS threshold FROM ({ALL_ORDERS}) GROUP BY 1, 2""")
def anomaly_summary(spark, sf_dir):
    return rounded(anomaly.anomaly_summary(view(spark, sf_dir, "skewed_orders"), anomaly.METHODS))


@query("anomaly_consensus", f"""
SELECT o_orderkey, column_name, round(max(value), 4) AS value, CAST(count(score) AS INTEGER) AS methods,
  count(score) = 3 AS by_all_methods, count(score) >= 2 AS by_majority FROM ({THREE}) GROUP BY 1, 2 HAVING count(score) > 0""")
def anomaly_consensus(spark, sf_dir):
    return rounded(anomaly.anomaly_consensus(view(spark, sf_dir, "skewed_orders"), ["o_orderkey"]))


@query("normal_rows", f"""
SELECT event_id, ts, event_type, value FROM events WHERE event_id NOT IN (
  SELECT event_id FROM ({scored_sql(['value'], 'events', 'event_id', ['iqr'])}) WHERE score IS NOT NULL)""")
def normal_rows(spark, sf_dir):
    return outliers.split_by_fence(base(spark, sf_dir, "events"), "value").where("NOT is_anomaly").select(
        "event_id", "ts", "event_type", "value")


def report_sql(view_name: str, cols) -> str:
    """CTEs o (columns with outliers and statistics) and t (rows, numeric columns)."""
    stats = " UNION ALL ".join(
        f"SELECT {[c for c, _ in cols].index(c)} AS position, '{c}' AS column_name, n, mean, sd, CAST(lo AS DOUBLE) AS lo, "
        f"CAST(hi AS DOUBLE) AS hi, q1, q3 FROM {stats_cte(c, sql(view_name))}" for c in S.numeric(cols))
    return f"""WITH t AS (SELECT count(*) AS total_rows, {len(S.numeric(cols))} AS numeric_columns FROM {sql(view_name)} v),
fence AS ({fences(cols, view_name)}), stats AS ({stats}),
o AS (SELECT s.*, outliers, total_rows, CAST(outliers AS DOUBLE) / total_rows * 100 AS rate
  FROM stats s JOIN fence USING (column_name), t WHERE outliers > 0)"""


ORDERS = report_sql("skewed_orders", S.SKEWED_ORDERS)
PRIORITY = "CASE WHEN rate > 10 THEN 'Critical' WHEN rate > 5 THEN 'High' WHEN rate > 1 THEN 'Medium' ELSE 'Low' END"


def _report(spark, sf_dir):
    df = view(spark, sf_dir, "skewed_orders")
    stats = table_stats(df, constants=False)
    return outliers.column_outliers(df, stats=stats), stats


@query("iqr_outliers", ORDERS + """
SELECT position, column_name, outliers, total_rows, round(rate, 4) AS rate, n AS data_points,
  round(q1 - 1.5 * (q3 - q1), 5) AS lower_bound, round(q3 + 1.5 * (q3 - q1), 5) AS upper_bound, round(mean, 4) AS mean,
  round(sd, 4) AS std, round(lo, 4) AS min, round(hi, 4) AS max, round(q1, 4) AS q1, round(q3, 4) AS q3, round(q3 - q1, 4) AS iqr,
  'Configurable IQR (threshold=1.5)' AS method FROM o""")
def iqr_outliers(spark, sf_dir):
    return rounded(_report(spark, sf_dir)[0], lower_bound=5, upper_bound=5)


@query("outlier_overview", ORDERS + """, s AS (SELECT coalesce(sum(outliers), 0) AS k, count(*) AS a, max(t.numeric_columns) AS w,
  coalesce(sum(outliers), 0) * 100.0 / max(t.total_rows) AS rate FROM t LEFT JOIN o ON TRUE)
SELECT CAST(k AS BIGINT) AS total_outliers, a AS affected_columns, CAST(w AS BIGINT) AS numeric_columns, round(rate, 4) AS rate,
  CASE WHEN rate > 5 THEN 'High' WHEN rate > 1 THEN 'Medium' ELSE 'Low' END AS severity,
  CASE WHEN rate < 1 THEN 'Excellent' WHEN rate < 5 THEN 'Good' WHEN rate < 10 THEN 'Attention Needed' ELSE 'Critical' END AS assessment,
  round(greatest(0.0, 100 - rate * 3), 4) AS reliability FROM s""")
def outlier_overview(spark, sf_dir):
    report, stats = _report(spark, sf_dir)
    return rounded(outliers.outlier_overview(report, stats.rows, len(stats.numeric())).drop("message"))


@query("outlier_priority", ORDERS + f"""
SELECT column_name, outliers, round(rate, 4) AS rate, {PRIORITY} AS priority,
  CASE {PRIORITY} WHEN 'Critical' THEN 'Immediate investigation required' WHEN 'High' THEN 'Review and validate anomalies'
    WHEN 'Medium' THEN 'Monitor and document patterns' ELSE 'Normal monitoring' END AS action FROM o""")
def outlier_priority(spark, sf_dir):
    return rounded(outliers.outlier_priority(_report(spark, sf_dir)[0]))


@query("priority_counts", ORDERS + f"""
SELECT count(*) FILTER (WHERE {PRIORITY} = 'Critical') AS critical_columns, count(*) FILTER (WHERE {PRIORITY} = 'High') AS high_columns FROM o""")
def priority_counts(spark, sf_dir):
    return outliers.priority_counts(outliers.outlier_priority(_report(spark, sf_dir)[0]))


@query("outlier_actions", ORDERS + """, s AS (SELECT max(rate) AS worst, bool_or(rate > 5 AND rate <= 10) AS high, sum(rate) AS overall, count(*) AS a FROM o)
SELECT 1 AS rank, 'Immediate Action Required: Critical anomaly levels detected - investigate data collection processes' AS action FROM s WHERE worst > 10
UNION ALL SELECT 2, 'High Priority: Review anomalies to determine if they represent valid edge cases or errors' FROM s WHERE high
UNION ALL SELECT 3, 'Process Review: High overall anomaly rate suggests reviewing data validation procedures' FROM s WHERE overall > 5
UNION ALL SELECT 4, 'Data Quality Audit: More than half of numeric columns have anomalies' FROM s, t WHERE a > numeric_columns * 0.5""")
def outlier_actions(spark, sf_dir):
    report, stats = _report(spark, sf_dir)
    return outliers.outlier_actions(report, stats.rows, len(stats.numeric()))


@query("outlier_samples", " UNION ALL ".join(f"""
SELECT * FROM (SELECT o_orderkey, '{c}' AS column_name, round(value, 4) AS value, direction, round(beyond, 5) AS beyond,
  CAST(row_number() OVER (ORDER BY beyond DESC, o_orderkey) AS INTEGER) AS rank FROM (
  SELECT o_orderkey, CAST({c} AS DOUBLE) AS value, CASE WHEN {c} > q3 + 1.5 * (q3 - q1) THEN 'above' ELSE 'below' END AS direction,
    CASE WHEN {c} < q1 - 1.5 * (q3 - q1) THEN q1 - 1.5 * (q3 - q1) - {c} WHEN {c} > q3 + 1.5 * (q3 - q1) THEN {c} - (q3 + 1.5 * (q3 - q1)) END AS beyond
  FROM {sql('skewed_orders')} v, {stats_cte(c, sql('skewed_orders'))} s) WHERE beyond IS NOT NULL) WHERE rank <= 8""" for c in S.numeric(S.SKEWED_ORDERS)))
def outlier_samples(spark, sf_dir):
    return rounded(outliers.outlier_samples(view(spark, sf_dir, "skewed_orders"), ["o_orderkey"]), beyond=5)


@query("boxplot_data", f"""
SELECT 'value' AS column_name, q1, med AS median, q3, q1 - 1.5 * (q3 - q1) AS lower_bound, q3 + 1.5 * (q3 - q1) AS upper_bound,
  (SELECT min(value) FROM events WHERE value >= q1 - 1.5 * (q3 - q1)) AS whisker_low,
  (SELECT max(value) FROM events WHERE value <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
  (SELECT count(*) FROM events WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS normal_points,
  (SELECT count(*) FROM events WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS anomaly_points
FROM {stats_cte('value', 'events')}""".replace("SELECT 'value' AS column_name, q1,", "SELECT 'value' AS column_name, round(q1, 4) AS q1,")
       .replace("med AS median, q3, q1 - 1.5 * (q3 - q1) AS lower_bound, q3 + 1.5 * (q3 - q1) AS upper_bound",
                "round(med, 4) AS median, round(q3, 4) AS q3, round(q1 - 1.5 * (q3 - q1), 5) AS lower_bound, round(q3 + 1.5 * (q3 - q1), 5) AS upper_bound"))
def boxplot_data(spark, sf_dir):
    return rounded(outliers.box_plot(base(spark, sf_dir, "events"), ["value"]), lower_bound=5, upper_bound=5)


@query("outlier_context", ORDERS + """
SELECT 'Total Outliers Detected: ' || CAST(sum(outliers) AS BIGINT) || chr(10) || 'Overall Outlier Rate: ' || printf('%.2f', sum(outliers) / CAST(max(total_rows) AS DOUBLE) * 100)
  || '%' || chr(10) || 'Columns with Outliers: ' || count(*) || chr(10) || 'Dataset Size: ' || format('{:,}', max(total_rows)) || ' rows' || chr(10)
  || string_agg('- ' || column_name || ': ' || outliers || ' outliers (' || printf('%.2f', rate) || '%), method: Configurable IQR (threshold=1.5)', chr(10) ORDER BY position) AS context FROM o""")
def outlier_context(spark, sf_dir):
    report, stats = _report(spark, sf_dir)
    return recommend.outlier_context(report, stats.rows)


def rolling_sql(partition: str, window: int) -> str:
    before, after = rolling.frame(window)
    by = f"PARTITION BY {partition} " if partition else ""
    return f"""(SELECT *, CASE WHEN k = {window} AND len >= {2 * window} AND sd > 0 THEN abs((value - m) / sd) END AS z FROM (
  SELECT event_id, ts, event_type, value, count(value) OVER w AS k, avg(value) OVER w AS m, stddev_samp(value) OVER w AS sd,
    count(*) OVER ({by}) AS len FROM events
  WINDOW w AS ({by}ORDER BY ts ROWS BETWEEN {before} PRECEDING AND {after} FOLLOWING)))"""


@query("rolling_zscore", f"SELECT event_id, round(z, 4) AS z FROM {rolling_sql('', 10)}")
def rolling_zscore(spark, sf_dir):
    return rounded(rolling.rolling_zscore(base(spark, sf_dir, "events"), "value", ["ts"], keep=["event_id"]).select("event_id", "z"))


@query("rolling_zscore_series", f"SELECT event_id, round(z, 4) AS z FROM {rolling_sql('event_type', 7)} WHERE z > 1.5")
def rolling_zscore_series(spark, sf_dir):
    return rounded(rolling.rolling_anomalies(base(spark, sf_dir, "events"), "value", ["ts"], ["event_type"], 7, 1.5,
                                             keep=["event_id"]).select("event_id", "z"))


@query("rolling_blocks", f"SELECT event_id, round(z, 4) AS z FROM {rolling_sql('event_type', 10)} WHERE z > 2")
def rolling_blocks(spark, sf_dir):
    """The block-wise form that large series take, on whatever size is given."""
    return rounded(rolling.rolling_anomalies(base(spark, sf_dir, "events"), "value", ["ts"], ["event_type"],
                                             keep=["event_id"], single_window_rows=0).select("event_id", "z"))


@query("rolling_zscore_blocks", f"SELECT event_id, round(z, 4) AS z FROM {rolling_sql('', 10)}")
def rolling_zscore_blocks(spark, sf_dir):
    """One series without a key, cut into blocks as a large one is."""
    return rounded(rolling.rolling_zscore(base(spark, sf_dir, "events"), "value", ["ts"], keep=["event_id"], single_window_rows=0,
                                          block_rows=300).select("event_id", "z"))


@query("rolling_summary", f"""
SELECT count(z) AS valid_rows, count(*) FILTER (WHERE z > 2) AS total_anomalies,
  round(count(*) FILTER (WHERE z > 2) * 100.0 / count(z), 4) AS anomaly_percentage FROM {rolling_sql('', 10)}""")
def rolling_summary(spark, sf_dir):
    return rounded(rolling.rolling_summary(rolling.rolling_zscore(base(spark, sf_dir, "events"), "value", ["ts"])))


def _stamp(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


@query("stream_window_metrics", """
SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS rows,
  round(count(value) * 100.0 / count(*), 4) AS completeness, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std
FROM events GROUP BY time_bucket(INTERVAL '1 hour', ts)
HAVING time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' <= (SELECT max(ts) FROM events) - INTERVAL '10 minutes'""")
def stream_window_metrics(spark, sf_dir):
    stream = monitor.read_table_stream(spark, sf_dir, "events")
    folder = shared_folder(spark)
    monitor.run_to_files(monitor.window_metrics(stream, "ts", "value"), f"{folder}/out", f"{folder}/state").awaitTermination()
    return rounded(spark.read.parquet(f"{folder}/out").select(_stamp("window_start"), "rows", "completeness", "mean", "std"))


EARLY = "ts < TIMESTAMP '2024-01-16 00:00:00'"


@query("stream_flag", f"""
SELECT event_id, method, round(value, 4) AS value, round(score, 4) AS score FROM (
  SELECT event_id, 'zscore' AS method, value, {SCORES['zscore'][1].format(c='value')} AS score FROM events, {stats_cte('value', f'(SELECT value FROM events WHERE {EARLY})')} WHERE NOT ({EARLY})
  UNION ALL SELECT event_id, 'iqr', value, {SCORES['iqr'][1].format(c='value')} FROM events, {stats_cte('value', f'(SELECT value FROM events WHERE {EARLY})')} WHERE NOT ({EARLY})
) WHERE score IS NOT NULL""")
def stream_flag(spark, sf_dir):
    """Later events against the stored baseline of the earlier ones."""
    folder = shared_folder(spark)
    early = base(spark, sf_dir, "events").where("ts < timestamp_ntz'2024-01-16 00:00:00'")
    anomaly.save_baseline(spark, anomaly.spreads(early, ["value"], ("zscore", "iqr")), f"{folder}/baseline")
    later = monitor.read_table_stream(spark, sf_dir, "events").where("ts >= timestamp_ntz'2024-01-16 00:00:00'")
    flagged = monitor.flag_outside(later, anomaly.load_baseline(spark, f"{folder}/baseline"))
    monitor.run_to_files(flagged, f"{folder}/out", f"{folder}/state").awaitTermination()
    found = spark.read.parquet(f"{folder}/out").select("event_id", F.inline("findings"))
    return rounded(found.select("event_id", "method", "value", "score"))
