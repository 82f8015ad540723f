"""Views derived from the given tables, as SQL text that Spark and DuckDB both run.

The given tables are clean, so the dirty views bring in missing values, repeats, case and
white-space faults, mixed types and outliers; query, DDL and dependency logs and model
replies are derived row by row from events, orders, lineitem and conversations.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "dirty_lineitem": """
WITH changed AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
    CASE WHEN l_partkey % 50 = 0 THEN l_extendedprice * 100 ELSE l_extendedprice END AS l_extendedprice,
    CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_discount END AS l_discount,
    CASE WHEN l_orderkey % 100 < 60 THEN NULL ELSE l_tax END AS l_tax,
    CASE WHEN l_suppkey % 2 = 0 THEN lower(l_returnflag) ELSE l_returnflag END AS l_returnflag,
    CASE WHEN l_partkey % 7 = 0 THEN concat(' ', l_linestatus) ELSE l_linestatus END AS l_linestatus,
    l_shipdate,
    CASE WHEN l_orderkey % 100 < 85 THEN NULL ELSE l_quantity END AS sparse_col,
    CAST(NULL AS DOUBLE) AS empty_col,
    'X' AS const_col,
    CASE WHEN l_partkey % 2 = 0 THEN CAST(l_partkey AS STRING)
         ELSE concat('p', CAST(l_partkey AS STRING)) END AS mixed_col
  FROM lineitem)
SELECT * FROM changed UNION ALL SELECT * FROM changed WHERE l_orderkey % 5 = 0""",
    "dirty_customer": """
SELECT c_custkey * 2 AS c_custkey, c_name, c_nationkey,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal, c_mktsegment
FROM customer""",
    # one price in twelve is far off: above the 5 % rules
    "skewed_orders": """
SELECT o_orderkey, o_custkey, o_orderstatus,
  CASE WHEN o_orderkey % 12 = 0 THEN o_totalprice * 50 ELSE o_totalprice END AS o_totalprice,
  CASE WHEN o_custkey % 40 = 0 THEN 1000.0 ELSE CAST(o_custkey % 10 AS DOUBLE) END AS o_weight,
  o_orderdate, o_orderpriority
FROM orders""",
    # a later state of dirty_lineitem: a column gone, one retyped, one new, more rows
    "restated_lineitem": """
SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS STRING) AS l_linenumber, l_quantity,
  l_extendedprice * 1.25 AS l_extendedprice,
  CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_discount END AS l_discount,
  l_returnflag, l_linestatus, l_shipdate, l_suppkey % 3 AS l_group
FROM lineitem
UNION ALL
SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS STRING), l_quantity, l_extendedprice * 1.25,
  NULL, l_returnflag, l_linestatus, l_shipdate, l_suppkey % 3
FROM lineitem WHERE l_orderkey % 5 = 0""",
    "query_log": """
SELECT concat('q', CAST(event_id AS STRING)) AS QUERY_ID, ts AS QUERY_START_TIME,
  concat('user', CAST(user_id AS STRING)) AS USER_NAME,
  CASE event_id % 8
    WHEN 0 THEN concat('INSERT INTO SALES.PUBLIC.FACTS SELECT * FROM staging.raw.part', CAST(user_id % 20 AS STRING), ' WHERE id > 3')
    WHEN 1 THEN concat('create table FACTS as select a, b from "Stage".raw.items_', CAST(user_id % 7 AS STRING), ', other group by a')
    WHEN 2 THEN 'UPDATE SALES.PUBLIC.FACTS SET v = 1 WHERE k = 2'
    WHEN 3 THEN concat('MERGE INTO facts USING (SELECT DISTINCT k FROM deltas', CAST(user_id % 5 AS STRING), ') d ON d.k = facts.k')
    WHEN 4 THEN 'SELECT count(*) FROM facts JOIN dims ON facts.k = dims.k'
    WHEN 5 THEN concat('INSERT INTO FACTS SELECT x FROM (SELECT x FROM base', CAST(user_id % 3 AS STRING), ' ORDER BY x) t')
    WHEN 6 THEN 'ALTER TABLE FACTS ADD COLUMN c INT'
    ELSE 'SELECT 1 FROM unrelated' END AS QUERY_TEXT,
  CASE event_id % 8 WHEN 0 THEN 'INSERT' WHEN 1 THEN 'CREATE_TABLE_AS_SELECT' WHEN 2 THEN 'UPDATE'
    WHEN 3 THEN 'MERGE' WHEN 4 THEN 'SELECT' WHEN 5 THEN 'INSERT' WHEN 6 THEN 'ALTER' ELSE 'SELECT' END AS QUERY_TYPE,
  CASE WHEN event_id % 11 = 0 THEN 'FAIL' ELSE 'SUCCESS' END AS EXECUTION_STATUS,
  event_id % 37 * 1000 AS TOTAL_ELAPSED_TIME,
  'WH' AS WAREHOUSE_NAME, 'SALES' AS DATABASE_NAME, 'PUBLIC' AS SCHEMA_NAME,
  '' AS DIRECT_OBJECTS_ACCESSED, '' AS BASE_OBJECTS_ACCESSED, '' AS OBJECTS_MODIFIED
FROM events""",
    # forms that a search for FROM alone misreads
    "scoped_query_log": """
SELECT concat('s', CAST(event_id AS STRING)) AS QUERY_ID,
  CASE event_id % 9
    WHEN 0 THEN concat('INSERT INTO FACTS SELECT EXTRACT(YEAR FROM order_ts), SUBSTRING(name FROM 2) FROM raw_', CAST(user_id % 6 AS STRING))
    WHEN 1 THEN concat('INSERT INTO FACTS -- copied from backup\nSELECT a FROM live_', CAST(user_id % 4 AS STRING), ' /* not from there, old */, dims')
    WHEN 2 THEN concat('CREATE TABLE FACTS AS SELECT ', chr(39), 'from here', chr(39), ' AS w, b FROM texts_', CAST(user_id % 3 AS STRING), ' WHERE b <> ', chr(39), 'it', chr(39), chr(39), 's from x', chr(39))
    WHEN 3 THEN concat('INSERT INTO FACTS WITH recent AS (SELECT * FROM events_', CAST(user_id % 5 AS STRING), '), best (k) AS (SELECT k FROM recent JOIN ranks ON 1 = 1) SELECT * FROM best, recent')
    WHEN 4 THEN concat('INSERT INTO FACTS WITH audits AS (SELECT * FROM audits WHERE y = ', CAST(user_id AS STRING), ') SELECT * FROM audits')
    WHEN 5 THEN 'INSERT INTO FACTS WITH RECURSIVE tree AS (SELECT 1 FROM roots UNION ALL SELECT 1 FROM tree JOIN leaves ON 1 = 1) SELECT * FROM tree'
    WHEN 6 THEN concat('INSERT INTO FACTS SELECT * FROM (SELECT a FROM inner_', CAST(user_id % 2 AS STRING), ' WHERE a IS DISTINCT FROM b) t, TABLE(flat(t.a)), other o')
    WHEN 7 THEN 'INSERT INTO FACTS SELECT * FROM ((left_side l JOIN "Raw"."right" r ON l.k = TRIM(BOTH FROM r.k)) LEFT JOIN third ON l.k = (SELECT max(k) FROM limits))'
    ELSE concat('INSERT INTO FACTS SELECT coalesce((SELECT max(x) FROM deep_', CAST(user_id % 3 AS STRING), '), OVERLAY(c PLACING d FROM 2)) FROM wide') END AS QUERY_TEXT,
  'INSERT' AS QUERY_TYPE
FROM events""",
    "ddl_log": """
SELECT concat('d', CAST(o_orderkey AS STRING)) AS QUERY_ID,
  CASE o_orderkey % 4 WHEN 0 THEN 'CREATE TABLE facts (k INT)' WHEN 1 THEN 'ALTER TABLE facts ADD c INT'
    WHEN 2 THEN 'DROP TABLE facts' ELSE 'GRANT SELECT ON facts TO r' END AS QUERY_TEXT,
  'sales' AS DATABASE_NAME, 'Public' AS SCHEMA_NAME,
  CASE WHEN o_custkey % 3 = 0 THEN 'facts' ELSE 'other' END AS OBJECT_NAME,
  CASE WHEN o_custkey % 10 = 9 THEN 'VIEW' ELSE 'TABLE' END AS OBJECT_TYPE,
  CASE o_orderkey % 4 WHEN 0 THEN 'CREATE' WHEN 1 THEN 'ALTER' WHEN 2 THEN 'DROP' ELSE 'GRANT' END AS DDL_ACTION,
  concat('user', CAST(o_custkey % 50 AS STRING)) AS EXECUTED_BY, o_orderdate AS EXECUTION_TIME
FROM orders""",
    "dependency_log": """
SELECT 'SALES' AS SOURCE_DATABASE, CASE WHEN l_suppkey % 2 = 0 THEN 'RAW' ELSE 'PUBLIC' END AS SOURCE_SCHEMA,
  CASE WHEN l_linenumber = 7 THEN 'FACTS' ELSE concat('SUPP_', CAST(l_suppkey AS STRING)) END AS SOURCE_TABLE,
  'TABLE' AS SOURCE_TYPE,
  'SALES' AS TARGET_DATABASE, 'public' AS TARGET_SCHEMA,
  CASE WHEN l_linenumber IN (1, 2) THEN 'facts' ELSE concat('MART_', CAST(l_partkey % 100 AS STRING)) END AS TARGET_TABLE,
  CASE WHEN l_linenumber = 2 THEN 'VIEW' ELSE 'TABLE' END AS TARGET_TYPE,
  'DEPENDENCY' AS RELATIONSHIP_TYPE, l_shipdate AS DEPENDENCY_CREATED, 'OBJECT_DEPENDENCIES' AS SOURCE_VIEW
FROM lineitem""",
    "replies": """
SELECT conv_id * 1000 + turn AS reply_id,
  CASE (conv_id + turn) % 7
    WHEN 0 THEN concat('{"summary": "turn ', CAST(turn AS STRING), '", "recommendations": [{"type": "data_cleaning", "priority": "high", "title": "Fix ', role, '", "description": "d', CAST(conv_id AS STRING), '", "suggested_actions": ["a", "b"], "affected_columns": ["c1"], "estimated_impact": "big"}]}')
    WHEN 1 THEN concat('```json\n{"recommendations": [{"category": "data_validation", "action_items": ["x"]}, {"title": "T', CAST(turn AS STRING), '"}]}\n```')
    WHEN 2 THEN concat('Here it is: {"summary": "s", "recommendations": []} from ', role)
    WHEN 3 THEN concat('{"summary": "broken ', CAST(conv_id AS STRING), '", "recommendations": [')
    WHEN 4 THEN concat('{"data_quality_assessment": {"overall_assessment": "fine"}, "data_cleaning_recommendations": ["**High Priority:** Fill c', CAST(turn AS STRING), '", "Low: Rename", "Look again"], "prioritized_action_items": ["Medium: Check ', role, '", "Urgent: Now"]}')
    WHEN 5 THEN concat('```json\n{"analytics_suitability": {"overall_verdict": "', CASE conv_id % 3 WHEN 0 THEN 'SUITABLE' WHEN 1 THEN 'CONDITIONALLY_SUITABLE' ELSE 'NOT_SUITABLE' END, '", "confidence_score": ', CAST(50 + conv_id % 50 AS STRING), ', "readiness_level": "Ready", "key_blockers": ["b1", "b2"], "recommended_actions": ["do"], "analytics_impact": {"machine_learning": "Good - ok", "sql_queries": "Fair - so so", "visualization": "Poor"}, "timeline_estimate": "1-3 days"}}\n```')
    ELSE text END AS text
FROM conversations""",
}
# Views that other views read.
AS_OF = "2024-04-10 00:00:00"
TARGET = ("SALES", "PUBLIC", "FACTS")


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or a derived view."""
    if name in TABLES:
        return base(spark, sf_dir, name)
    text = VIEWS[name].replace("\\", "\\\\")  # Spark reads escapes in string literals
    used = [t for t in TABLES if re.search(rf"\bFROM {t}\b", text)]
    for t in used:
        text = re.sub(rf"\bFROM {t}\b", "FROM {" + t + "}", text)
    return spark.sql(_braces(text, used), **{t: base(spark, sf_dir, t) for t in used})


def _braces(text: str, used: list[str]) -> str:
    """Double the literal braces for str.format and keep the table placeholders."""
    text = text.replace("{", "{{").replace("}", "}}")
    for t in used:
        text = text.replace("{{" + t + "}}", "{" + t + "}")
    return text


def sql(name: str) -> str:
    """The view as a bracketed DuckDB subquery."""
    return f"({VIEWS[name]})" if name in VIEWS else name
