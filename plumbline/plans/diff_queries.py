"""Metadata snapshots and their differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.sizing import settle
from plumbline.operators import diff, metadata
from plumbline.plans import profile_sql as S
from plumbline.plans.catalog import query
from plumbline.plans.fixtures import base, sql, view
from plumbline.plans.profile_queries import rounded

LINEITEM = [c for c in S.DIRTY_LINEITEM if c[0] not in ("sparse_col", "empty_col", "const_col", "mixed_col")]
RESTATED = [("l_orderkey", "integer"), ("l_partkey", "integer"), ("l_suppkey", "integer"), ("l_linenumber", "string"),
            ("l_quantity", "float"), ("l_extendedprice", "float"), ("l_discount", "float"), ("l_returnflag", "string"),
            ("l_linestatus", "string"), ("l_shipdate", "datetime"), ("l_group", "integer")]


def side(view_name: str, cols) -> str:
    """Facts of one side; the declared types come from the list alone."""
    text = S.facts(view_name, cols)
    return f"({text} SELECT * FROM facts)".replace("'string' AS data_type, 'int' AS dtype", "'string' AS data_type, 'string' AS dtype")


def both(old: str, old_cols, new: str, new_cols) -> str:
    """CTEs a, b (facts), j (columns side by side), t (dataset totals)."""
    return f"""WITH a AS {side(old, old_cols)}, b AS {side(new, new_cols)},
j AS (SELECT coalesce(a.column_name, b.column_name) AS name, a.dtype AS t1, b.dtype AS t2, a.mean AS m1, b.mean AS m2,
  a.unique_count AS u1, b.unique_count AS u2 FROM a FULL JOIN b ON a.column_name = b.column_name),
t AS (SELECT (SELECT max(total_count) FROM a) AS r1, (SELECT max(total_count) FROM b) AS r2,
  (SELECT CAST(sum(null_count) AS BIGINT) FROM a) AS n1, (SELECT CAST(sum(null_count) AS BIGINT) FROM b) AS n2,
  (SELECT count(*) FROM a) AS c1, (SELECT count(*) FROM b) AS c2, {S.duplicates(old)} AS d1, {S.duplicates(new)} AS d2)"""


SIMPLE = """, moved AS (
SELECT 'schema' AS type, 'high' AS severity, 'Added columns: ' || string_agg(name, ', ' ORDER BY name) AS description FROM j WHERE t1 IS NULL HAVING count(*) > 0
UNION ALL SELECT 'schema', 'high', 'Removed columns: ' || string_agg(name, ', ' ORDER BY name) FROM j WHERE t2 IS NULL HAVING count(*) > 0
UNION ALL SELECT 'schema', 'medium', 'Column ''' || name || ''' type changed: ' || t1 || ' → ' || t2 FROM j WHERE t1 <> t2
UNION ALL SELECT 'data', CASE WHEN abs(r2 - r1) > r1 * 0.1 THEN 'high' ELSE 'medium' END,
  'Row count changed: ' || format('{:,}', r1) || ' → ' || format('{:,}', r2) || ' (' || CASE WHEN r2 > r1 THEN '+' ELSE '-' END || format('{:,}', abs(r2 - r1)) || ')' FROM t WHERE r1 <> r2
UNION ALL SELECT 'data', CASE WHEN abs(n2 - n1) > 100 THEN 'high' ELSE 'medium' END,
  'Total null count changed: ' || format('{:,}', n1) || ' → ' || format('{:,}', n2) || ' (' || CASE WHEN n2 > n1 THEN '+' ELSE '-' END || format('{:,}', abs(n2 - n1)) || ')' FROM t WHERE n1 <> n2)"""
DIRTY_PAIR = both("lineitem", LINEITEM, "dirty_lineitem", S.DIRTY_LINEITEM)
RESTATED_PAIR = both("dirty_lineitem", S.DIRTY_LINEITEM, "restated_lineitem", RESTATED)


def _snap(spark, sf_dir, name):
    return metadata.snapshot(view(spark, sf_dir, name), name, "file")


@query("metadata_snapshot", f"WITH a AS {side('dirty_customer', S.DIRTY_CUSTOMER)}" + """
SELECT 'customer' AS name, max(total_count) AS row_count, count(*) AS column_count, CAST(sum(null_count) AS BIGINT) AS total_null_count,
  string_agg(column_name, ', ' ORDER BY position) AS column_names,
  coalesce(string_agg(column_name, ', ' ORDER BY position) FILTER (WHERE data_type IN ('integer', 'float')), '') AS numeric_columns,
  coalesce(string_agg(column_name, ', ' ORDER BY position) FILTER (WHERE data_type = 'string'), '') AS categorical_columns,
  coalesce(string_agg(column_name, ', ' ORDER BY position) FILTER (WHERE data_type = 'datetime'), '') AS datetime_columns FROM a""")
def metadata_snapshot(spark, sf_dir):
    snap = metadata.snapshot(view(spark, sf_dir, "dirty_customer"), "customer", "file")
    return snap.select("name", "row_count", "column_count", "total_null_count", *[
        F.concat_ws(", ", c).alias(c) for c in ("column_names", "numeric_columns", "categorical_columns", "datetime_columns")])


@query("column_metadata", f"WITH a AS {side('dirty_lineitem', S.DIRTY_LINEITEM)}" + """
SELECT position, column_name AS name, dtype AS data_type, present_count AS non_null_count, null_count, round(null_percentage, 2) AS null_percentage FROM a""")
def column_metadata(spark, sf_dir):
    return metadata.column_metadata(view(spark, sf_dir, "dirty_lineitem"))


@query("column_metadata_ext", f"WITH a AS {side('dirty_lineitem', S.DIRTY_LINEITEM)}" + """
SELECT position, column_name AS name, unique_count, total_count - unique_count AS duplicate_count, round(min_value, 4) AS min_value,
  round(max_value, 4) AS max_value, round(mean, 4) AS mean_value, round(std, 4) AS std_value FROM a""")
def column_metadata_ext(spark, sf_dir):
    got = metadata.extended_columns(view(spark, sf_dir, "dirty_lineitem"))
    return rounded(got.select("position", "name", "unique_count", "duplicate_count", "min_value", "max_value", "mean_value", "std_value"))


@query("metadata_changes", DIRTY_PAIR + SIMPLE + " SELECT * FROM moved")
def metadata_changes(spark, sf_dir):
    return diff.simple_changes(_snap(spark, sf_dir, "lineitem"), _snap(spark, sf_dir, "dirty_lineitem")).drop("rank")


@query("metadata_changes_restated", RESTATED_PAIR + SIMPLE + " SELECT * FROM moved")
def metadata_changes_restated(spark, sf_dir):
    return diff.simple_changes(_snap(spark, sf_dir, "dirty_lineitem"), _snap(spark, sf_dir, "restated_lineitem")).drop("rank")


@query("metadata_diff", RESTATED_PAIR + SIMPLE + """
SELECT count(*) FILTER (WHERE type = 'schema') > 0 AS schema_changed, count(*) FILTER (WHERE type = 'data') > 0 AS data_changed, count(*) AS total_changes,
  CAST(least(100, CASE WHEN count(*) FILTER (WHERE type = 'schema') > 0 THEN 50 ELSE 0 END + CASE WHEN count(*) FILTER (WHERE type = 'data') > 0 THEN 30 ELSE 0 END) AS BIGINT) AS change_score,
  max(r2 - r1) AS row_count_change, max(c2 - c1) AS column_count_change,
  'Review schema changes to ensure compatibility|Validate data changes and update downstream processes' AS recommendations
FROM moved, t""")
def metadata_diff(spark, sf_dir):
    got = diff.simple_diff(_snap(spark, sf_dir, "dirty_lineitem"), _snap(spark, sf_dir, "restated_lineitem"))
    return got.withColumn("recommendations", F.concat_ws("|", "recommendations"))


# content digests differ exactly for columns whose set of distinct values differs
def _same_values(old: str, new: str, cols, new_types) -> str:
    parts = []
    for c in cols:
        cast = "VARCHAR" if dict(new_types)[c] == "string" else None
        left = f"SELECT DISTINCT {f'CAST({c} AS {cast})' if cast else c} AS x FROM {sql(old)} o WHERE {c} IS NOT NULL"
        right = f"SELECT DISTINCT {c} AS x FROM {sql(new)} n WHERE {c} IS NOT NULL"
        parts.append(f"SELECT '{c}' AS name, (SELECT count(*) FROM (({left}) EXCEPT ({right}))) + (SELECT count(*) FROM (({right}) EXCEPT ({left}))) AS moved")
    return " UNION ALL ".join(parts)


COMMON = [c for c, _ in S.DIRTY_LINEITEM if c in dict(RESTATED)]
COLUMN_CHANGES = f""", s AS ({_same_values('dirty_lineitem', 'restated_lineitem', COMMON, RESTATED)}),
k AS (SELECT j.*, s.moved, CASE WHEN m1 <> 0 THEN abs((m2 - m1) / m1 * 100) ELSE 0 END AS mp,
  CASE WHEN u1 > 0 THEN abs(CAST(u2 - u1 AS DOUBLE) / u1 * 100) ELSE 0 END AS up FROM j JOIN s ON j.name = s.name),
col AS (SELECT name AS column_name, 'content_changed' AS change_type, 'Content in column ''' || name || ''' has changed' AS description, CAST(u2 - u1 AS DOUBLE) AS amount
    FROM k WHERE moved > 0 OR t1 <> t2
  UNION ALL SELECT name, 'statistical_change', 'Mean value in ''' || name || ''' changed by ' || printf('%.1f', mp) || '%', mp FROM k WHERE m1 IS NOT NULL AND m2 IS NOT NULL AND mp > 10
  UNION ALL SELECT name, 'cardinality_change', 'Unique values in ''' || name || ''' changed by ' || printf('%.1f', up) || '%', up FROM k WHERE up > 20)"""


def _ext(spark, sf_dir, name):
    """A stored snapshot: one row, written once and read by every comparison."""
    return settle(metadata.extended_snapshot(view(spark, sf_dir, name), name, "file"))


@query("column_changes", RESTATED_PAIR + COLUMN_CHANGES + " SELECT column_name, change_type, description, round(amount, 4) AS amount FROM col")
def column_changes(spark, sf_dir):
    return rounded(diff.column_level_changes(_ext(spark, sf_dir, "dirty_lineitem"), _ext(spark, sf_dir, "restated_lineitem")))


EXTENDED = RESTATED_PAIR + COLUMN_CHANGES + """, q AS (SELECT *, CAST(r2 - r1 AS DOUBLE) / r1 * 100 AS rp,
  round((r1 * c1 - n1) / CAST(r1 * c1 AS DOUBLE) * 100 * 0.7 + CAST(r1 - d1 AS DOUBLE) / r1 * 100 * 0.3, 2) AS q1,
  round((r2 * c2 - n2) / CAST(r2 * c2 AS DOUBLE) * 100 * 0.7 + CAST(r2 - d2 AS DOUBLE) / r2 * 100 * 0.3, 2) AS q2 FROM t),
ch AS (
SELECT 'row_count_change' AS type, CASE WHEN abs(rp) > 20 THEN 'high' ELSE 'medium' END AS severity, 'Row count changed by ' || printf('%.1f', rp) || '%' AS description FROM q WHERE abs(rp) > 5
UNION ALL SELECT 'columns_added', 'medium', 'Added ' || count(*) || ' new columns' FROM j WHERE t1 IS NULL HAVING count(*) > 0
UNION ALL SELECT 'columns_removed', 'high', 'Removed ' || count(*) || ' columns' FROM j WHERE t2 IS NULL HAVING count(*) > 0
UNION ALL SELECT 'data_type_changes', 'high', 'Data type changes in ' || count(*) || ' columns' FROM j WHERE t1 <> t2 HAVING count(*) > 0
UNION ALL SELECT 'schema_structure_change', 'medium', 'Overall schema structure has changed' FROM j WHERE t1 IS DISTINCT FROM t2 HAVING count(*) > 0
UNION ALL SELECT 'quality_score_change', CASE WHEN abs(q2 - q1) > 15 THEN 'high' ELSE 'medium' END, 'Data quality ' || CASE WHEN q2 > q1 THEN 'improved' ELSE 'degraded' END || ' by ' || printf('%.1f', abs(q2 - q1)) || ' points' FROM q WHERE abs(q2 - q1) > 5
UNION ALL SELECT 'null_count_change', CASE WHEN abs(n2 - n1) < 100 THEN 'low' ELSE 'medium' END, 'Total null values changed by ' || (n2 - n1) FROM q WHERE n1 <> n2
UNION ALL SELECT 'duplicate_count_change', CASE WHEN abs(d2 - d1) < 10 THEN 'low' ELSE 'medium' END, 'Duplicate rows changed by ' || (d2 - d1) FROM q WHERE d1 <> d2
UNION ALL SELECT 'column_level_changes', 'medium', 'Changes detected in ' || count(*) || ' columns' FROM col HAVING count(*) > 0
UNION ALL SELECT 'fingerprint_changes', 'high', 'Hash-based change detection: 3 changes')"""


@query("metadata_diff_ext", EXTENDED + " SELECT * FROM ch")
def metadata_diff_ext(spark, sf_dir):
    return diff.extended_changes(_ext(spark, sf_dir, "dirty_lineitem"), _ext(spark, sf_dir, "restated_lineitem")).drop("rank")


@query("change_score", EXTENDED + """
SELECT count(*) AS total_changes, round(sum(CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 3 ELSE 5 END) * 100.0 / (count(*) * 5), 4) AS change_score FROM ch""")
def change_score(spark, sf_dir):
    changes = diff.extended_changes(_ext(spark, sf_dir, "dirty_lineitem"), _ext(spark, sf_dir, "restated_lineitem"))
    return rounded(diff.change_score(changes))


@query("change_advice", EXTENDED + """
SELECT rank, advice FROM (VALUES
  (1, 'columns_removed', 'Critical: Column removal detected - verify ETL pipeline integrity'),
  (2, 'columns_removed', 'Review data source schema changes and update mappings'),
  (3, 'data_type_changes', 'Data type changes detected - validate downstream processes'),
  (4, 'data_type_changes', 'Update data validation rules to handle type changes'),
  (5, 'degraded', 'Data quality degradation detected - investigate data sources'),
  (6, 'improved', 'Data quality improvement detected - document successful changes'),
  (7, 'fingerprint_changes', 'Significant data changes detected - perform detailed audit'),
  (8, 'fingerprint_changes', 'Consider implementing change tracking for critical datasets'),
  (9, 'row_count_change', 'Row count changes - verify data loading completeness'),
  (10, 'row_count_change', 'Check if changes align with expected data refresh cycles'),
  (11, 'many', 'Multiple changes detected - consider comprehensive data validation')) v(rank, type, advice)
WHERE type IN (SELECT type FROM ch) OR (type = 'many' AND (SELECT count(*) FROM ch) > 5)
  OR (type IN ('degraded', 'improved') AND EXISTS (SELECT 1 FROM ch WHERE ch.type = 'quality_score_change' AND contains(ch.description, v.type)))""")
def change_advice(spark, sf_dir):
    changes = diff.extended_changes(_ext(spark, sf_dir, "dirty_lineitem"), _ext(spark, sf_dir, "restated_lineitem"))
    return diff.change_advice(changes)


@query("fingerprint")
def fingerprint(spark, sf_dir):
    """Digests of the orders: they do not change with row order."""
    return metadata.extended_snapshot(base(spark, sf_dir, "orders"), "orders", "file").select(
        "schema_hash", "structure_hash", "content_hash", "stats_hash")


def _digest_sql(columns: list[str], table: str, where: str = "TRUE") -> str:
    written = " || ".join(f"coalesce(length({c}) || ':' || {c}, '-')" for c in columns)
    return f"""SELECT count(*) AS row_count, {", ".join(
        f"CAST(coalesce(sum(CAST(CAST('0x' || substr(h, {at}, 16) AS UBIGINT) AS HUGEINT)), 0) AS VARCHAR) AS {name}"
        for name, at in (("high", 1), ("low", 17)))} FROM (SELECT md5({written}) AS h FROM {table} t WHERE {where})"""


ORDER_TEXTS = ["CAST(o_orderkey AS VARCHAR)", "CAST(o_custkey AS VARCHAR)", "o_orderstatus", "CAST(o_totalprice AS VARCHAR)",
               "CAST(epoch_us(o_orderdate) AS VARCHAR)", "o_orderpriority"]
CUSTOMER_TEXTS = ["CAST(c_custkey AS VARCHAR)", "c_name", "CAST(c_nationkey AS VARCHAR)", "CAST(c_acctbal AS VARCHAR)", "c_mktsegment"]


def _shown(digest: DataFrame) -> DataFrame:
    return digest.select("row_count", *[F.col(c).cast("string").alias(c) for c in ("high", "low")])


@query("additive_digest", _digest_sql(CUSTOMER_TEXTS, sql("dirty_customer")))
def additive_digest(spark, sf_dir):
    return _shown(metadata.additive_digest(view(spark, sf_dir, "dirty_customer")))


@query("additive_digest_update", _digest_sql(ORDER_TEXTS, "orders", "o_orderkey % 3 <> 1"))
def additive_digest_update(spark, sf_dir):
    """Orders without a third of them, with another third: from the digests of the parts."""
    orders = base(spark, sf_dir, "orders")
    first, added, removed = (metadata.additive_digest(orders.where(w)) for w in ("o_orderkey % 3 < 2", "o_orderkey % 3 = 2", "o_orderkey % 3 = 1"))
    return _shown(metadata.changed_digest(first, added, removed))


@query("fingerprint_order", "SELECT TRUE AS same_content, count(*) AS row_count FROM orders")
def fingerprint_order(spark, sf_dir):
    """The content digest of the orders equals that of the same rows in another order."""
    orders = base(spark, sf_dir, "orders")
    other = orders.repartition(5, "o_custkey").sortWithinPartitions(F.desc("o_totalprice"))
    a, b = (metadata.content_hash(d) for d in (orders, other))
    count = orders.agg(F.count(F.lit(1)).alias("row_count"))
    pair = a.crossJoin(F.broadcast(b.withColumnRenamed("content_hash", "again")))  # one row each
    return pair.crossJoin(F.broadcast(count)).select(
        (F.col("content_hash") == F.col("again")).alias("same_content"), "row_count")


@query("fingerprint_changes", """
SELECT * FROM (VALUES ('content', 'Dataset content has changed', 'Data values have been modified'),
  ('statistics', 'Statistical properties have changed', 'Data distribution or quality metrics changed')) v(hash_type, description, impact)""")
def fingerprint_changes(spark, sf_dir):
    return diff.fingerprint_changes(_ext(spark, sf_dir, "customer"), _ext(spark, sf_dir, "dirty_customer"))


@query("size_difference", """
SELECT (SELECT count(*) FROM {b} b) - (SELECT count(*) FROM {a} a) AS row_diff, CAST(-4 AS BIGINT) AS column_diff,
  round(CAST((SELECT count(*) FROM {b} b) - (SELECT count(*) FROM {a} a) AS DOUBLE) / (SELECT count(*) FROM {a} a) * 100, 4) AS row_diff_pct"""
       .replace("{a}", sql("dirty_lineitem")).replace("{b}", "lineitem"))
def size_difference(spark, sf_dir):
    got = diff.size_difference(_snap(spark, sf_dir, "dirty_lineitem"), _snap(spark, sf_dir, "lineitem"))
    return rounded(got.drop("size_diff"))
