"""Lineage over query, DDL and dependency logs derived from events, orders and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import lineage as L, recommend
from plumbline.plans.catalog import query
from plumbline.plans.fixtures import AS_OF, TARGET, sql, view

DB, SCHEMA, TABLE = TARGET
CENTER = f"'{DB}.{SCHEMA}.{TABLE}'"
UP = "upper(QUERY_TEXT)"
SINCE = f"TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY"

DEPS = f"""(SELECT * FROM {sql('dependency_log')} d WHERE TARGET_TYPE = 'TABLE' AND (
  (upper(SOURCE_DATABASE) = '{DB}' AND upper(SOURCE_SCHEMA) = '{SCHEMA}' AND upper(SOURCE_TABLE) = '{TABLE}')
  OR (upper(TARGET_DATABASE) = '{DB}' AND upper(TARGET_SCHEMA) = '{SCHEMA}' AND upper(TARGET_TABLE) = '{TABLE}')))"""
QUERIES = f"""(SELECT *, 'QUERY_HISTORY' AS SOURCE_VIEW FROM {sql('query_log')} q WHERE QUERY_START_TIME >= {SINCE} AND EXECUTION_STATUS = 'SUCCESS' AND (
  (QUERY_TYPE IN ('INSERT', 'UPDATE', 'MERGE', 'CREATE_TABLE_AS_SELECT', 'CREATE_TABLE') AND ({UP} LIKE '%INTO%{TABLE}%'
     OR {UP} LIKE '%UPDATE%{TABLE}%' OR {UP} LIKE '%TABLE%{TABLE}%' OR {UP} LIKE '%{DB}.{SCHEMA}.{TABLE}%'))
  OR (QUERY_TYPE = 'SELECT' AND TOTAL_ELAPSED_TIME > 10000 AND {UP} LIKE '%FROM%{TABLE}%')))"""
DDL = f"""(SELECT *, 'DDL_HISTORY' AS SOURCE_VIEW FROM {sql('ddl_log')} d WHERE upper(DATABASE_NAME) = '{DB}' AND upper(SCHEMA_NAME) = '{SCHEMA}'
  AND upper(OBJECT_NAME) = '{TABLE}' AND EXECUTION_TIME >= TIMESTAMP '1998-01-01' - INTERVAL 90 DAY
  AND DDL_ACTION IN ('CREATE', 'ALTER', 'DROP') AND OBJECT_TYPE = 'TABLE')"""
DDL_AS_OF = "1998-01-01 00:00:00"

PARTS = f"""(SELECT QUERY_ID, QUERY_TYPE, unnest({{split}}[2:]) AS part FROM {QUERIES} q
    WHERE QUERY_TYPE IN ('CREATE_TABLE_AS_SELECT', 'INSERT', 'MERGE'))"""
NAMED = f"""CASE WHEN contains(w, '.') THEN CASE WHEN length(w) > 3 THEN w END
    WHEN length(w) > 2 AND NOT regexp_matches(w, '^[0-9]+$') THEN '{DB}.{SCHEMA}.' || w END"""
# one row per (query, table in a list after FROM or JOIN)
SOURCES = rf"""(SELECT DISTINCT QUERY_ID, QUERY_TYPE, {NAMED} AS source FROM (
  SELECT QUERY_ID, QUERY_TYPE, regexp_replace(regexp_extract(regexp_replace(item, '[()]', ' ', 'g'), '\S+'), '["'';]', '', 'g') AS w
  FROM (SELECT QUERY_ID, QUERY_TYPE, unnest(string_split(regexp_replace(part, '(?s)\b(WHERE|GROUP|ORDER|HAVING|LIMIT|QUALIFY|WINDOW|UNION|INTERSECT|EXCEPT|ON|USING|WHEN)\b.*$', ''), ',')) AS item
    FROM {PARTS.format(split=rf"regexp_split_to_array({UP}, '\b(?:FROM|JOIN)\b')")} WHERE NOT regexp_matches(part, '^\s*\(\s*SELECT\b')))
  WHERE w NOT IN ('SELECT', 'DISTINCT', 'TOP', 'ALL') AND {NAMED} IS NOT NULL AND {NAMED} <> {CENTER})"""
# one row per (query, first acceptable of three words after a FROM)
FIRST_SOURCES = rf"""(SELECT DISTINCT QUERY_ID, QUERY_TYPE, named[1] AS source FROM (
  SELECT QUERY_ID, QUERY_TYPE, list_filter(list_transform(list_transform(list_filter(list_filter(regexp_split_to_array(
      regexp_replace(regexp_replace(part, '(?s)(WHERE|GROUP|ORDER|JOIN).*$', ''), '[,()]', ' ', 'g'), '\s+'), lambda x: x <> '')[1:3],
      lambda x: x NOT IN ('SELECT', 'DISTINCT', 'TOP', 'ALL')), lambda x: regexp_replace(x, '["'';]', '', 'g')), lambda w: {NAMED}),
      lambda x: x IS NOT NULL AND x <> {CENTER}) AS named
  FROM {PARTS.format(split=f"string_split({UP}, 'FROM')")}) WHERE named[1] IS NOT NULL)"""


def deps(spark, sf_dir):
    return L.object_dependencies(view(spark, sf_dir, "dependency_log"), *TARGET)


def history(spark, sf_dir, limit=None):
    return L.table_queries(view(spark, sf_dir, "query_log"), *TARGET, as_of=AS_OF, limit=limit)


def ddl(spark, sf_dir, limit=None):
    return L.ddl_history(view(spark, sf_dir, "ddl_log"), *TARGET, as_of=DDL_AS_OF, limit=limit)


def everything(spark, sf_dir):
    return L.combine(deps(spark, sf_dir), history(spark, sf_dir), ddl(spark, sf_dir))


def stamp(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


def stamp_sql(name: str) -> str:
    return f"strftime({name}, '%Y-%m-%d %H:%M:%S') AS {name}"


@query("lineage_dependencies", f"""
SELECT SOURCE_SCHEMA AS "Source Schema", SOURCE_TABLE AS "Source Table", TARGET_SCHEMA AS "Target Schema", TARGET_TABLE AS "Target Table",
  RELATIONSHIP_TYPE AS "Relationship", count(*) AS n FROM {DEPS} GROUP BY ALL""")
def lineage_dependencies(spark, sf_dir):
    return L.dependency_table(deps(spark, sf_dir)).groupBy(
        "Source Schema", "Source Table", "Target Schema", "Target Table", "Relationship").agg(F.count(F.lit(1)).alias("n"))


@query("lineage_queries", f"""
SELECT QUERY_ID, {stamp_sql('QUERY_START_TIME')}, USER_NAME, QUERY_TYPE, TOTAL_ELAPSED_TIME FROM {QUERIES}""")
def lineage_queries(spark, sf_dir):
    return history(spark, sf_dir).select("QUERY_ID", stamp("QUERY_START_TIME"), "USER_NAME", "QUERY_TYPE", "TOTAL_ELAPSED_TIME")


@query("lineage_queries_newest", f"""
SELECT QUERY_ID, {stamp_sql('QUERY_START_TIME')}, QUERY_TYPE FROM (SELECT * FROM {QUERIES} ORDER BY QUERY_START_TIME DESC, QUERY_ID LIMIT 50)""")
def lineage_queries_newest(spark, sf_dir):
    return history(spark, sf_dir, 50).select("QUERY_ID", stamp("QUERY_START_TIME"), "QUERY_TYPE")


@query("lineage_queries_simple", f"""
SELECT QUERY_ID, USER_NAME, QUERY_TYPE FROM (SELECT * FROM {sql('query_log')} q
  WHERE QUERY_START_TIME >= TIMESTAMP '2024-02-10' - INTERVAL 30 DAY AND EXECUTION_STATUS = 'SUCCESS' AND {UP} LIKE '%{TABLE}%'
  AND QUERY_TYPE IN ('INSERT', 'UPDATE', 'CREATE_TABLE_AS_SELECT', 'SELECT', 'MERGE') ORDER BY QUERY_START_TIME DESC, QUERY_ID LIMIT 30)""")
def lineage_queries_simple(spark, sf_dir):
    return L.table_queries_simple(view(spark, sf_dir, "query_log"), TABLE, as_of="2024-02-10 00:00:00", limit=30).select(
        "QUERY_ID", "USER_NAME", "QUERY_TYPE")


@query("lineage_ddl", f"""
SELECT QUERY_ID, DDL_ACTION, EXECUTED_BY, {stamp_sql('EXECUTION_TIME')} FROM {DDL}""")
def lineage_ddl(spark, sf_dir):
    return ddl(spark, sf_dir).select("QUERY_ID", "DDL_ACTION", "EXECUTED_BY", stamp("EXECUTION_TIME"))


@query("lineage_ddl_from_queries", f"""
SELECT QUERY_ID, CASE WHEN {UP} LIKE '%CREATE%TABLE%' THEN 'CREATE' WHEN {UP} LIKE '%ALTER%TABLE%' THEN 'ALTER'
    WHEN {UP} LIKE '%DROP%TABLE%' THEN 'DROP' ELSE 'UNKNOWN' END AS DDL_ACTION, USER_NAME AS EXECUTED_BY
FROM {sql('query_log')} q WHERE QUERY_START_TIME >= {SINCE} AND EXECUTION_STATUS = 'SUCCESS' AND QUERY_TYPE IN ('CREATE_TABLE', 'ALTER', 'DROP')
  AND ({UP} LIKE '%CREATE%TABLE%{TABLE}%' OR {UP} LIKE '%ALTER%TABLE%{TABLE}%' OR {UP} LIKE '%DROP%TABLE%{TABLE}%')""")
def lineage_ddl_from_queries(spark, sf_dir):
    return L.ddl_from_queries(view(spark, sf_dir, "query_log"), *TARGET, as_of=AS_OF, limit=None).select(
        "QUERY_ID", "DDL_ACTION", "EXECUTED_BY")


@query("lineage_union", f"""
SELECT SOURCE_VIEW, count(*) AS n, count(QUERY_TYPE) AS typed, count(DDL_ACTION) AS ddl, count(SOURCE_TABLE) AS linked FROM (
  SELECT * FROM {DEPS} UNION ALL BY NAME SELECT * FROM {QUERIES} UNION ALL BY NAME SELECT * FROM {DDL}) GROUP BY 1""")
def lineage_union(spark, sf_dir):
    return everything(spark, sf_dir).groupBy("SOURCE_VIEW").agg(
        F.count(F.lit(1)).alias("n"), F.count("QUERY_TYPE").alias("typed"), F.count("DDL_ACTION").alias("ddl"),
        F.count("SOURCE_TABLE").alias("linked"))


@query("lineage_sources", f"SELECT source, count(*) AS queries FROM {SOURCES} GROUP BY 1")
def lineage_sources(spark, sf_dir):
    return L.transformation_sources(history(spark, sf_dir), *TARGET)


# the tables that each form of the scoped log reads, said without reading its text
SCOPED = " UNION ALL ".join(
    f"SELECT '{DB}.{SCHEMA}.' || {name} AS source FROM events WHERE event_id % 9 = {form}" for form, name in [
        (0, "'RAW_' || user_id % 6"), (1, "'LIVE_' || user_id % 4"), (1, "'DIMS'"), (2, "'TEXTS_' || user_id % 3"), (3, "'EVENTS_' || user_id % 5"),
        (3, "'RANKS'"), (4, "'AUDITS'"), (5, "'ROOTS'"), (5, "'LEAVES'"), (6, "'INNER_' || user_id % 2"), (6, "'OTHER'"), (7, "'LEFT_SIDE'"),
        (7, "'THIRD'"), (7, "'LIMITS'"), (8, "'DEEP_' || user_id % 3"), (8, "'WIDE'")]) + " UNION ALL SELECT 'RAW.RIGHT' FROM events WHERE event_id % 9 = 7"


@query("lineage_sources_scoped", f"SELECT source, count(*) AS queries FROM ({SCOPED}) GROUP BY 1")
def lineage_sources_scoped(spark, sf_dir):
    """Sources of queries with comments, literals, functions that hold FROM, and WITH queries."""
    return L.transformation_sources(view(spark, sf_dir, "scoped_query_log"), *TARGET)


@query("lineage_sources_first", f"SELECT source, count(*) AS queries FROM {FIRST_SOURCES} GROUP BY 1")
def lineage_sources_first(spark, sf_dir):
    """The narrower reading: one table after each FROM."""
    return L.transformation_sources(history(spark, sf_dir), *TARGET, first_only=True)


EDGES = f"""(SELECT DISTINCT * FROM (
  SELECT QUERY_TYPE || '_' || QUERY_ID AS source, {CENTER} AS target, lower(QUERY_TYPE) AS relationship FROM {QUERIES} WHERE QUERY_TYPE IN ('CREATE_TABLE_AS_SELECT', 'INSERT', 'MERGE')
  UNION ALL SELECT {CENTER}, QUERY_TYPE || '_' || QUERY_ID, 'self_update' FROM {QUERIES} WHERE QUERY_TYPE = 'UPDATE'
  UNION ALL SELECT QUERY_TYPE || '_' || QUERY_ID, {CENTER}, 'updated' FROM {QUERIES} WHERE QUERY_TYPE = 'UPDATE'
  UNION ALL SELECT source, QUERY_TYPE || '_' || QUERY_ID, 'feeds_into' FROM {SOURCES}
  UNION ALL SELECT SOURCE_DATABASE || '.' || SOURCE_SCHEMA || '.' || SOURCE_TABLE, TARGET_DATABASE || '.' || TARGET_SCHEMA || '.' || TARGET_TABLE, 'dependency' FROM {DEPS}))"""


@query("lineage_edges", f"""
SELECT source, target, relationship, CASE WHEN contains(relationship, 'create') THEN 'transformation' WHEN contains(relationship, 'dependency') THEN 'dependency'
  WHEN contains(relationship, 'update') THEN 'update' ELSE 'other' END AS edge_class FROM {EDGES}""")
def lineage_edges(spark, sf_dir):
    return L.lineage_edges(everything(spark, sf_dir), *TARGET).withColumn("edge_class", L.edge_class(F.col("relationship")))


NEWEST = f"(SELECT * FROM {QUERIES} ORDER BY QUERY_START_TIME DESC, QUERY_ID LIMIT 50)"


@query("lineage_edges_all_pairs", f"""
WITH top AS (SELECT *, QUERY_TYPE || '_' || row_number() OVER (ORDER BY QUERY_START_TIME DESC, QUERY_ID) AS node FROM {NEWEST}
  WHERE QUERY_TYPE IN ('CREATE_TABLE_AS_SELECT', 'INSERT', 'MERGE', 'UPDATE'))
SELECT s.source, top.node AS target, 'feeds_into' AS relationship
FROM (SELECT DISTINCT source FROM {SOURCES} WHERE QUERY_ID IN (SELECT QUERY_ID FROM top)) s, top WHERE QUERY_TYPE <> 'UPDATE'""")
def lineage_edges_all_pairs(spark, sf_dir):
    return L.source_edges(history(spark, sf_dir, 50), *TARGET, all_pairs=True, numbered=True)


@query("lineage_nodes", f"""
WITH n AS (SELECT {CENTER} AS node, 'target' AS node_type, 0 AS role
  UNION ALL SELECT QUERY_TYPE || '_' || QUERY_ID, CASE WHEN QUERY_TYPE = 'UPDATE' THEN 'update' ELSE 'transformation' END, 1 FROM {QUERIES}
    WHERE QUERY_TYPE IN ('CREATE_TABLE_AS_SELECT', 'INSERT', 'MERGE', 'UPDATE')
  UNION ALL SELECT source, 'source', 2 FROM {SOURCES}
  UNION ALL SELECT SOURCE_DATABASE || '.' || SOURCE_SCHEMA || '.' || SOURCE_TABLE, 'dependency_source', 3 FROM {DEPS}
  UNION ALL SELECT TARGET_DATABASE || '.' || TARGET_SCHEMA || '.' || TARGET_TABLE, 'dependency_target', 4 FROM {DEPS})
SELECT node, arg_min(node_type, role) AS node_type, string_split(node, '.')[-1] AS short_name FROM n GROUP BY node""")
def lineage_nodes(spark, sf_dir):
    return L.lineage_nodes(everything(spark, sf_dir), *TARGET).select(
        "node", "node_type", L.short_name(F.col("node")).alias("short_name"))


@query("transformation_summary", f"""
SELECT (SELECT count(*) FROM {QUERIES} WHERE QUERY_TYPE IN ('CREATE_TABLE_AS_SELECT', 'INSERT', 'MERGE', 'UPDATE')) AS transformations,
  (SELECT count(DISTINCT source) FROM {SOURCES}) AS source_tables""")
def transformation_summary(spark, sf_dir):
    return L.transformation_summary(history(spark, sf_dir), *TARGET)


@query("dependency_summary", f"""
SELECT count(*) AS total_dependencies, count(DISTINCT (SOURCE_DATABASE, SOURCE_SCHEMA, SOURCE_TABLE)) AS unique_sources,
  count(DISTINCT (TARGET_DATABASE, TARGET_SCHEMA, TARGET_TABLE)) AS unique_targets FROM {DEPS}""")
def dependency_summary(spark, sf_dir):
    return L.dependency_summary(deps(spark, sf_dir))


@query("access_summary", f"""
SELECT count(*) AS total_queries, count(*) FILTER (WHERE QUERY_TYPE IN ('INSERT', 'UPDATE', 'MERGE', 'CREATE_TABLE_AS_SELECT', 'CREATE_TABLE')) AS transformations,
  count(*) FILTER (WHERE QUERY_TYPE = 'SELECT') AS reads, count(DISTINCT USER_NAME) AS unique_users FROM {QUERIES}""")
def access_summary(spark, sf_dir):
    return L.access_summary(history(spark, sf_dir))


@query("recent_reads", f"""
SELECT QUERY_ID, USER_NAME, CASE WHEN length(QUERY_TEXT) > 500 THEN substring(QUERY_TEXT, 1, 500) || '...' ELSE QUERY_TEXT END AS shown_text
FROM (SELECT * FROM {QUERIES} WHERE QUERY_TYPE = 'SELECT' ORDER BY QUERY_START_TIME DESC, QUERY_ID LIMIT 10)""")
def recent_reads(spark, sf_dir):
    return L.recent_reads(history(spark, sf_dir), 10).select("QUERY_ID", "USER_NAME", "shown_text")


@query("sample_queries", f"""
SELECT QUERY_ID, QUERY_TYPE, QUERY_TEXT FROM (SELECT * FROM {QUERIES} ORDER BY QUERY_START_TIME DESC, QUERY_ID LIMIT 3)""")
def sample_queries(spark, sf_dir):
    return L.sample_queries(history(spark, sf_dir), 3)


@query("lineage_daily", f"""
SELECT strftime(QUERY_START_TIME, '%Y-%m-%d') AS day, QUERY_TYPE, count(*) AS queries FROM {QUERIES} GROUP BY 1, 2""")
def lineage_daily(spark, sf_dir):
    return L.daily_activity(history(spark, sf_dir)).withColumn("day", F.col("day").cast("string"))


@query("ddl_summary", f"""
SELECT count(*) AS total_ddl, count(*) FILTER (WHERE DDL_ACTION = 'CREATE') AS creates, count(*) FILTER (WHERE DDL_ACTION = 'ALTER') AS alters FROM {DDL}""")
def ddl_summary(spark, sf_dir):
    return L.ddl_summary(ddl(spark, sf_dir))


EVENTS = f"""(SELECT DEPENDENCY_CREATED AS ts, 'Dependency Created' AS event_type, 'Dependency: ' || SOURCE_TABLE || ' → ' || TARGET_TABLE AS description, 'dependency' AS category FROM {DEPS}
  UNION ALL SELECT QUERY_START_TIME, QUERY_TYPE || ' Query', QUERY_TYPE || ' by ' || USER_NAME,
    CASE WHEN QUERY_TYPE IN ('INSERT', 'UPDATE', 'MERGE', 'CREATE_TABLE_AS_SELECT', 'DELETE') THEN 'transformation' ELSE 'access' END FROM {QUERIES}
  UNION ALL SELECT EXECUTION_TIME, 'DDL ' || DDL_ACTION, DDL_ACTION || ' ' || OBJECT_TYPE || ' by ' || EXECUTED_BY, 'ddl' FROM {DDL})"""


@query("lineage_timeline", f"""
SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, event_type, description, category FROM {EVENTS}""")
def lineage_timeline(spark, sf_dir):
    return L.timeline(everything(spark, sf_dir)).select(stamp("timestamp"), "event_type", "description", "category")


@query("timeline_first", f"""
SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, event_type, description, category
FROM (SELECT * FROM {EVENTS} ORDER BY ts, event_type, description LIMIT 20)""")
def timeline_first(spark, sf_dir):
    events = L.timeline(everything(spark, sf_dir)).orderBy("timestamp", "event_type", "description").limit(20)
    return events.select(stamp("timestamp"), "event_type", "description", "category")


@query("timeline_daily", f"""
SELECT strftime(ts, '%Y-%m-%d') AS day, category, count(*) AS events FROM {EVENTS} GROUP BY 1, 2""")
def timeline_daily(spark, sf_dir):
    return L.timeline_daily(L.timeline(everything(spark, sf_dir))).withColumn("day", F.col("day").cast("string"))


@query("timeline_summary", f"""
SELECT count(*) FILTER (WHERE category = 'transformation') AS transformations, count(*) FILTER (WHERE category = 'access') AS access_events,
  count(*) FILTER (WHERE category = 'ddl') AS ddl_changes, (epoch_us(max(ts)) - epoch_us(min(ts))) // 86400000000 AS activity_days FROM {EVENTS}""")
def timeline_summary(spark, sf_dir):
    return L.timeline_summary(L.timeline(everything(spark, sf_dir)))


def top_sql(fact: str, value: str, source: str, k: int) -> str:
    return (f"SELECT * FROM (SELECT '{fact}' AS fact, {value} AS value, count(*) AS count FROM {source} "
            f"GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT {k})")


FACTS = f"""{top_sql('query_type', 'QUERY_TYPE', QUERIES, 1000)}
UNION ALL {top_sql('user', 'USER_NAME', QUERIES, 10)}
UNION ALL {top_sql('pair', "SOURCE_TABLE || ' -> ' || TARGET_TABLE", DEPS, 10)}
UNION ALL {top_sql('hour', 'CAST(hour(QUERY_START_TIME) AS VARCHAR)', QUERIES, 5)}
UNION ALL SELECT 'date_range', strftime(min(QUERY_START_TIME), '%Y-%m-%d %H:%M:%S') || ' to ' || strftime(max(QUERY_START_TIME), '%Y-%m-%d %H:%M:%S'), count(*) FROM {QUERIES}"""


@query("lineage_facts", FACTS)
def lineage_facts(spark, sf_dir):
    return L.lineage_facts(everything(spark, sf_dir))


@query("lineage_context", f"SELECT fact, fact || ': ' || value || ' (' || count || ')' AS line FROM ({FACTS})")
def lineage_context(spark, sf_dir):
    return recommend.lineage_context(L.lineage_facts(everything(spark, sf_dir)))
