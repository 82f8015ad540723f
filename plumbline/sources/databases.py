"""Reader options for Snowflake and Oracle.  The connectors themselves come with the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SNOWFLAKE_REQUIRED = ("account", "username", "password", "warehouse", "database")
ORACLE_REQUIRED = ("username", "password", "dsn")


def _need(kind: str, names: tuple[str, ...], given: dict) -> None:
    for name in names:
        if not given.get(name):
            raise ValueError(f"{name} is required for {kind}")


def snowflake_options(schema: str = "PUBLIC", **given) -> dict[str, str]:
    _need("snowflake", SNOWFLAKE_REQUIRED, given)
    return {"sfURL": f"{given['account']}.snowflakecomputing.com", "sfUser": given["username"],
            "sfPassword": given["password"], "sfWarehouse": given["warehouse"],
            "sfDatabase": given["database"], "sfSchema": schema}


def oracle_options(wallet: str | None = None, fetch_rows: int = 10_000, **given) -> dict[str, str]:
    _need("oracle", ORACLE_REQUIRED, given)
    url = f"jdbc:oracle:thin:@{given['dsn']}" + (f"?TNS_ADMIN={wallet}" if wallet else "")
    return {"url": url, "user": given["username"], "password": given["password"],
            "driver": "oracle.jdbc.OracleDriver", "fetchsize": str(fetch_rows)}


def split_options(column: str, low: int, high: int, parts: int) -> dict[str, str]:
    """Parallel JDBC reading over ranges of a numeric or date column."""
    return {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)}


def snowflake_tables_query(schema: str) -> str:
    name = schema.replace("'", "''")
    return ("SELECT table_name FROM information_schema.tables "
            f"WHERE table_schema = '{name}' AND table_type = 'BASE TABLE' ORDER BY table_name")


def snowflake_columns_query(schema: str, table: str) -> str:
    name, owner = table.replace("'", "''"), schema.replace("'", "''")
    return ("SELECT column_name, data_type FROM information_schema.columns "
            f"WHERE table_schema = '{owner}' AND table_name = '{name}' ORDER BY ordinal_position")


def oracle_tables_query() -> str:
    return "SELECT table_name FROM user_tables ORDER BY table_name"


def oracle_columns_query(table: str) -> str:
    name = table.upper().replace("'", "''")
    return f"SELECT column_name, data_type FROM user_tab_columns WHERE table_name = '{name}' ORDER BY column_id"


def read_database(spark: SparkSession, source: str, options: dict[str, str], table: str | None = None,
                  query: str | None = None, limit: int | None = None) -> DataFrame:
    """A table or a query from ``snowflake`` or ``jdbc``; filters and limits push down."""
    if (table is None) == (query is None):
        raise ValueError("give either a table or a query")
    reader = spark.read.format(source).options(**options)
    df = (reader.option("dbtable", table) if table else reader.option("query", query)).load()
    return df if limit is None else df.limit(limit)
