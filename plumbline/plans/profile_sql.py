"""SQL for the profile facts of a view, one SELECT per column."""

from __future__ import annotations

from plumbline.plans.fixtures import sql

NUMBER_TEXT = (r"^[+-]?(\d(_?\d)*(\.(\d(_?\d)*)?)?|\.\d(_?\d)*)([eE][+-]?\d(_?\d)*)?$"
               r"|^[+-]?([iI][nN][fF]|[iI][nN][fF][iI][nN][iI][tT][yY]|[nN][aA][nN])$")
SPACE = r"[\s\p{Z}]"

DIRTY_LINEITEM = [
    ("l_orderkey", "integer"), ("l_partkey", "integer"), ("l_suppkey", "integer"), ("l_linenumber", "integer"),
    ("l_quantity", "float"), ("l_extendedprice", "float"), ("l_discount", "float"), ("l_tax", "float"),
    ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "datetime"),
    ("sparse_col", "float"), ("empty_col", "float"), ("const_col", "string"), ("mixed_col", "string")]
DIRTY_CUSTOMER = [("c_custkey", "integer"), ("c_name", "string"), ("c_nationkey", "integer"),
                  ("c_acctbal", "float"), ("c_mktsegment", "string")]
SKEWED_ORDERS = [("o_orderkey", "integer"), ("o_custkey", "integer"), ("o_orderstatus", "string"),
                 ("o_totalprice", "float"), ("o_weight", "float"), ("o_orderdate", "datetime"),
                 ("o_orderpriority", "string")]
PART = [("p_partkey", "integer"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"),
        ("p_size", "integer"), ("p_retailprice", "float")]
EVENTS = [("event_id", "integer"), ("ts", "datetime"), ("user_id", "integer"), ("event_type", "string"),
          ("value", "float"), ("props", "string")]

# declared types as Spark names them
TYPES = {"l_linenumber": "int", "c_nationkey": "int", "p_size": "int"}


def spark_type(name: str, kind: str) -> str:
    return TYPES.get(name, {"integer": "bigint", "float": "double", "string": "string",
                            "datetime": "timestamp_ntz"}[kind])


def numeric(cols):
    return [c for c, k in cols if k in ("integer", "float")]


def facts(view: str, cols, z: float = 2.0) -> str:
    """One row per column with everything the rules read."""
    parts = []
    for i, (c, kind) in enumerate(cols):
        num, text = kind in ("integer", "float"), kind == "string"
        shown = f"printf('%.4f', {c})" if kind == "float" else f"CAST({c} AS VARCHAR)"
        parts.append(f"""
SELECT {i} AS position, '{c}' AS column_name, '{kind}' AS data_type, '{spark_type(c, kind)}' AS dtype,
  count(*) AS total_count, count(*) - count({c}) AS null_count, count({c}) AS present_count,
  CASE WHEN count(*) > 0 THEN CAST(count(*) - count({c}) AS DOUBLE) / count(*) * 100 ELSE 0.0 END AS null_percentage,
  count(DISTINCT {c}) AS unique_count,
  {f'avg({c})' if num else 'CAST(NULL AS DOUBLE)'} AS mean,
  {f'quantile_cont({c}, 0.5)' if num else 'CAST(NULL AS DOUBLE)'} AS median,
  {f'stddev_samp({c})' if num else 'CAST(NULL AS DOUBLE)'} AS std,
  {f'CAST(min({c}) AS DOUBLE)' if num else 'CAST(NULL AS DOUBLE)'} AS min_value,
  {f'CAST(max({c}) AS DOUBLE)' if num else 'CAST(NULL AS DOUBLE)'} AS max_value,
  (SELECT {shown} FROM v WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS mode,
  {f'''(SELECT count(*) FROM v, (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM v)
    WHERE s > 0 AND abs(({c} - m) / s) > {z})''' if num else '0'} AS outliers_count,
  {f'count(DISTINCT lower({c})) <> count(DISTINCT {c})' if text else 'FALSE'} AS mixed_case,
  {f"coalesce(bool_or(regexp_matches({c}, '^{SPACE}|{SPACE}$')), FALSE)" if text else 'FALSE'} AS edge_space,
  {f"count(*) FILTER (WHERE regexp_matches(trim({c}), '{NUMBER_TEXT}'))" if text else '0'} AS numeric_cells,
  {f'max({c}) - min({c}) + 1' if kind == 'integer' else 'NULL'} AS span,
  {f'max(length({c}))' if text else 'NULL'} AS max_length,
  {f'avg(length({c}))' if text else 'CAST(NULL AS DOUBLE)'} AS mean_length,
  count({c}) > 0 AND min({c}) = max({c}) AS is_constant
FROM v""")
    return f"WITH v AS (SELECT * FROM {sql(view)} s), facts AS (" + " UNION ALL ".join(parts) + ")"


ISSUES = """
SELECT position, column_name, 1 AS k, CASE
    WHEN null_percentage > 50 THEN 'HIGH_NULL_RATE: ' || printf('%.1f', null_percentage) || '% null values'
    WHEN null_percentage > 10 THEN 'MODERATE_NULL_RATE: ' || printf('%.1f', null_percentage) || '% null values' END AS issue
  FROM facts
UNION ALL SELECT position, column_name, 2, CASE WHEN CAST(unique_count AS DOUBLE) / total_count < 0.01 THEN
    'LOW_UNIQUENESS: Only ' || printf('%.2f', CAST(unique_count AS DOUBLE) / total_count * 100) || '% unique values' END FROM facts
UNION ALL SELECT position, column_name, 3, CASE WHEN present_count > 0 AND CAST(outliers_count AS DOUBLE) / present_count > 0.05 THEN
    'HIGH_OUTLIER_RATE: ' || printf('%.2f', CAST(outliers_count AS DOUBLE) / present_count * 100) || '% outliers detected' END FROM facts
UNION ALL SELECT position, column_name, 4, CASE WHEN mixed_case THEN 'INCONSISTENT_CASING: Mixed case values detected' END FROM facts
UNION ALL SELECT position, column_name, 5, CASE WHEN edge_space THEN 'WHITESPACE_ISSUES: Leading/trailing whitespace detected' END FROM facts
UNION ALL SELECT position, column_name, 6, CASE WHEN data_type = 'integer' AND unique_count = total_count AND present_count > 1
    AND span <> unique_count THEN 'ID_GAPS: Potential gaps in ID sequence' END FROM facts"""


def scored(view: str, cols) -> str:
    """CTEs facts, issues, scored."""
    return facts(view, cols) + f""", issues AS (SELECT * FROM ({ISSUES}) WHERE issue IS NOT NULL),
scored AS (SELECT f.*, coalesce(n, 0) AS issue_count,
  greatest(0.0, 100 - null_percentage * 0.5 - coalesce(n, 0) * 10) AS quality_score
  FROM facts f LEFT JOIN (SELECT position AS p, count(*) AS n FROM issues GROUP BY 1) i ON f.position = i.p)"""


def duplicates(view: str) -> str:
    return f"""(SELECT CAST((SELECT count(*) FROM {sql(view)} a) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {sql(view)} b)) AS BIGINT))"""
