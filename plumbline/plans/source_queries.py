"""Reading, writing and registering: round trips of the given tables through files."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from plumbline.functions.sizing import shared_folder
from plumbline.operators import metadata, overview, profile, readiness
from plumbline.plans import profile_sql as S
from plumbline.plans.catalog import query
from plumbline.plans.fixtures import TABLES, base, sql, view
from plumbline.plans.profile_queries import PROFILE_SELECT, profile_view, readiness_sql
from plumbline.sources import factory, files, registry, sinks


@query("csv_roundtrip", " UNION ALL ".join(
    f"SELECT '{e}' AS encoding, c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer" for e in files.ENCODINGS))
def csv_roundtrip(spark, sf_dir):
    """The customers through CSV in every offered encoding and delimiter, types inferred."""
    folder = shared_folder(spark)
    df = base(spark, sf_dir, "customer")
    out = None
    for name, sep in zip(files.ENCODINGS, files.DELIMITERS.values()):
        path = f"{folder}/{name}"
        sinks.write_csv(df, path, encoding=name, delimiter=sep)
        back = factory.read_source(spark, "csv", path=path, encoding=name, delimiter=sep).select(
            F.lit(name).alias("encoding"), F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_name", "c_nationkey",
            "c_acctbal", "c_mktsegment")
        out = back if out is None else out.unionByName(back)
    return out


@query("csv_text_roundtrip", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def csv_text_roundtrip(spark, sf_dir):
    """Whole document texts through CSV: quotes and line breaks survive."""
    df = base(spark, sf_dir, "documents")
    path = f"{shared_folder(spark)}/documents"
    sinks.write_csv(df, path)
    return files.read_csv(spark, path, schema=df.schema, multi_line=True)


@query("csv_broken_records", """
SELECT CAST(o_orderkey AS VARCHAR) || ',' || CAST(o_custkey AS VARCHAR) || CASE WHEN o_orderkey % 2 = 0 THEN ',surplus,field' ELSE '' END AS record
FROM orders WHERE o_orderkey % 97 = 0""")
def csv_broken_records(spark, sf_dir):
    """Orders as CSV lines, some with a field too few or too many: those come back as they stand."""
    path = f"{shared_folder(spark)}/broken"
    key, customer = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    broken = F.when(F.col("o_orderkey") % 2 == 0, F.concat_ws(",", key, customer, F.lit("surplus"), F.lit("field"))).otherwise(
        F.concat_ws(",", key, customer))
    line = F.when(F.col("o_orderkey") % 97 == 0, broken).otherwise(F.concat_ws(",", key, customer, "o_orderstatus"))
    base(spark, sf_dir, "orders").select(line.alias("o_orderkey,o_custkey,o_orderstatus")).write.option("header", True).option(
        "sep", "\u0001").csv(path)  # the commas are in the lines already
    return files.broken_records(spark, path, "o_orderkey long, o_custkey long, o_orderstatus string")


@query("csv_ledger", """
SELECT o_orderstatus AS status, count(*) FILTER (o_orderkey % 97 <> 0 AND o_custkey % 89 <> 0) AS good_rows,
  count(*) FILTER (o_orderkey % 97 = 0 OR o_custkey % 89 = 0) AS bad_rows FROM orders GROUP BY 1""")
def csv_ledger(spark, sf_dir):
    """Good and bad rows of the files of orders by status: some lines lack a field, some hold a word for a number."""
    path = f"{shared_folder(spark)}/ledger"
    number = F.when(F.col("o_custkey") % 89 == 0, F.lit("unknown")).otherwise(F.col("o_custkey").cast("string"))
    line = F.concat_ws(",", F.col("o_orderkey").cast("string"), number, F.when(F.col("o_orderkey") % 97 != 0, F.col("o_orderpriority")))
    base(spark, sf_dir, "orders").select("o_orderstatus", line.alias("o_orderkey,o_custkey,o_orderpriority")).write.partitionBy(
        "o_orderstatus").option("header", True).option("sep", "\u0001").csv(path)
    found = files.csv_ledger(spark, path, "o_orderkey long, o_custkey long, o_orderpriority string", pathGlobFilter="*.csv")
    return found.groupBy(F.regexp_extract("path", "o_orderstatus=([^/]*)", 1).alias("status")).agg(
        *[F.sum(c).alias(c) for c in ("good_rows", "bad_rows")])


FOOTER_TABLES = {"lineitem": ("l_orderkey", "l_quantity", "l_discount", "l_linenumber"), "documents": ("doc_id", "n_chars"),
                 "labels": ("doc_id", "quality"), "orders": ("o_orderkey", "o_totalprice")}


@query("footer_facts", " UNION ALL ".join(
    f"SELECT '{t}' AS dataset, '{c}' AS name, count(*) AS row_count, count({c}) AS non_null_count, count(*) - count({c}) AS null_count, "
    f"CAST(min({c}) AS DOUBLE) AS low, CAST(max({c}) AS DOUBLE) AS high FROM {t}" for t, cols in FOOTER_TABLES.items() for c in cols))
def footer_facts(spark, sf_dir):
    """Counts and extremes of columns from Parquet footers; the tables' columns are not read."""
    out = None
    for t, cols in FOOTER_TABLES.items():
        one = metadata.column_facts_from_files(spark, f"{sf_dir}/{t}.parquet").where(F.col("name").isin(*cols)).select(
            F.lit(t).alias("dataset"), "name", "row_count", "non_null_count", "null_count",
            F.col("min_value").cast("double").alias("low"), F.col("max_value").cast("double").alias("high"))
        out = one if out is None else out.unionByName(one)
    return out


@query("footer_snapshot", " UNION ALL ".join(
    f"SELECT '{t}' AS name, count(*) AS row_count, (SELECT count(*) FROM (DESCRIBE SELECT * FROM {t})) AS column_count, "
    f"count(*) * {n} - {' - '.join(f'count({c})' for c in cols)} AS total_null_count FROM {t}"
    for t, n, cols in [("documents", 5, ("doc_id", "text", "lang", "source", "n_chars")), ("labels", 3, ("doc_id", "quality", "toxic")),
                       ("pages", 3, ("page_id", "url", "html"))]))
def footer_snapshot(spark, sf_dir):
    """The snapshot of whole tables from their footers."""
    out = None
    for t in ("documents", "labels", "pages"):
        one = metadata.snapshot_from_files(spark, f"{sf_dir}/{t}.parquet", t).select("name", "row_count", "column_count", "total_null_count")
        out = one if out is None else out.unionByName(one)
    return out


@query("csv_files", "SELECT 'nation' AS dataset, count(*) AS rows, 3 AS columns FROM nation UNION ALL SELECT 'supplier', count(*), 4 FROM supplier UNION ALL SELECT 'orders', count(*), 6 FROM orders")
def csv_files(spark, sf_dir):
    """Several CSV datasets, each under its own name; a missing one is reported, not fatal."""
    folder = shared_folder(spark)
    names = ["nation", "supplier", "orders"]
    for n in names:
        sinks.write_csv(base(spark, sf_dir, n), f"{folder}/{n}")
    loaded, failed = files.read_csv_files(spark, [f"{folder}/{n}" for n in [*names, "missing"]])
    if list(failed) != ["missing"]:
        raise ValueError(f"unexpected failures: {failed}")
    out = None
    for name, df in loaded.items():
        row = files.source_info(df, "csv", name).select(
            F.col("file_path").alias("dataset"), F.col("row_count").alias("rows"), F.col("column_count").cast("int").alias("columns"))
        out = row if out is None else out.unionByName(row)
    return out


ORDER_FORMS = ("csv", "parquet", "pq", "json", "json array", "dat")


@query("file_dispatch", " UNION ALL ".join(
    f"SELECT '{e}' AS form, o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority FROM orders"
    for e in ORDER_FORMS))
def file_dispatch(spark, sf_dir):
    """The orders through each file kind, read back by extension alone; JSON as lines and as arrays."""
    folder = shared_folder(spark)
    df = base(spark, sf_dir, "orders")
    sinks.write_csv(df, f"{folder}/a.csv")
    sinks.write_csv(df, f"{folder}/a.dat")
    df.write.parquet(f"{folder}/a.parquet")
    df.write.parquet(f"{folder}/a.pq")
    df.write.json(f"{folder}/a.json")
    # files that hold one array each
    df.groupBy(F.floor(F.col("o_orderkey") / 10_000).alias("part")).agg(
        F.to_json(F.collect_list(F.struct(*df.columns))).alias("value")).select("value").write.option(
        "maxRecordsPerFile", 1).text(f"{folder}/array/a.json")
    out = None
    for form in ORDER_FORMS:
        path = f"{folder}/array/a.json" if form == "json array" else f"{folder}/a.{form}"
        got = factory.read_source(spark, "hdfs", path=path).select(
            F.lit(form).alias("form"), *[F.col(c).cast("bigint") for c in ("o_orderkey", "o_custkey")], "o_orderstatus", "o_totalprice",
            F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("o_orderdate"), "o_orderpriority")
        out = got if out is None else out.unionByName(got)
    return out


@query("file_listing", "SELECT unnest([{}]) AS name, 'parquet' AS extension".format(", ".join(f"'{t}.parquet'" for t in TABLES)))
def file_listing(spark, sf_dir):
    got = files.list_files(spark, sf_dir, depth=0, data_only=True).where("size_bytes > 0")
    return got.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "extension")


@query("directory_listing", """
SELECT '' AS directory FROM orders UNION SELECT 'o_orderstatus=' || o_orderstatus FROM orders
UNION SELECT 'o_orderstatus=' || o_orderstatus || '/year=' || year(o_orderdate) FROM orders""")
def directory_listing(spark, sf_dir):
    """The folders of the orders written by status and year; those of a status hold only folders."""
    path = f"{shared_folder(spark)}/orders"
    base(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.year("o_orderdate").alias("year")).write.partitionBy(
        "o_orderstatus", "year").parquet(path)
    return files.list_directories(files.list_files(spark, path, data_only=True), path)


@query("source_info", "SELECT 'parquet' AS source_type, count(*) AS row_count, CAST(11 AS BIGINT) AS column_count FROM lineitem")
def source_info(spark, sf_dir):
    df = base(spark, sf_dir, "lineitem")
    return files.source_info(df, "parquet", sf_dir).select("source_type", "row_count", "column_count")


SUMMARY_TABLES = TABLES


def _registry(spark, sf_dir):
    reg = registry.Registry(spark)
    for t in SUMMARY_TABLES:
        reg.register(t, base(spark, sf_dir, t), "parquet", file_name=f"{t}.parquet")
    return reg


@query("dataset_summary", " UNION ALL ".join(
    f"SELECT '{t}' AS name, 'parquet' AS source_type, count(*) AS rows, (SELECT count(*) FROM (DESCRIBE SELECT * FROM {t})) AS columns, CAST(0 AS BIGINT) AS missing_values FROM {t}"
    for t in SUMMARY_TABLES))
def dataset_summary(spark, sf_dir):
    return _registry(spark, sf_dir).summaries().select("name", "source_type", "rows", "columns", "missing_values")


@query("dataset_totals", f"""
SELECT CAST({len(SUMMARY_TABLES)} AS BIGINT) AS total_datasets, CAST({' + '.join(f'(SELECT count(*) FROM {t})' for t in SUMMARY_TABLES)} AS BIGINT) AS total_rows""")
def dataset_totals(spark, sf_dir):
    return _registry(spark, sf_dir).totals().drop("total_bytes")


@query("registry_query", """
SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def registry_query(spark, sf_dir):
    reg = _registry(spark, sf_dir)
    return reg.query("SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance "
                     "FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")


@query("registry_replace", "SELECT count(*) AS rows, count(c_acctbal) AS balances FROM " + sql("dirty_customer") + " c")
def registry_replace(spark, sf_dir):
    reg = _registry(spark, sf_dir)
    reg.replace("customer", view(spark, sf_dir, "dirty_customer"))
    return reg.get("customer").agg(F.count(F.lit(1)).alias("rows"), F.count("c_acctbal").alias("balances"))


@query("row_preview", "SELECT * FROM supplier ORDER BY s_suppkey LIMIT 10")
def row_preview(spark, sf_dir):
    return overview.preview(base(spark, sf_dir, "supplier"), 10, ["s_suppkey"])


@query("type_counts", f"""
SELECT CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string'
  ELSE 'timestamp_ntz' END AS type, count(*) AS columns FROM (DESCRIBE SELECT * FROM {sql('dirty_lineitem')} v) GROUP BY 1""")
def type_counts(spark, sf_dir):
    return overview.type_counts(view(spark, sf_dir, "dirty_lineitem"))


@query("issue_export", readiness_sql("dirty_lineitem", S.DIRTY_LINEITEM) + """
SELECT title AS "Issue", severity AS "Severity", description AS "Description", affected_columns AS "Affected Columns", recommendation AS "Recommendation" FROM found""")
def issue_export(spark, sf_dir):
    """Readiness issues written as CSV and read back."""
    path = f"{shared_folder(spark)}/issues"
    sinks.write_issues(readiness.readiness_issues(view(spark, sf_dir, "dirty_lineitem")), path)
    return files.read_csv(spark, path, schema='`Issue` string, `Severity` string, `Description` string, `Affected Columns` string, `Recommendation` string')


@query("report_export", S.facts("dirty_customer", S.DIRTY_CUSTOMER) + PROFILE_SELECT)
def report_export(spark, sf_dir):
    """A profile written as Parquet and read back."""
    path = f"{shared_folder(spark)}/report"
    sinks.write_report(profile.profile_columns(view(spark, sf_dir, "dirty_customer")), path)
    return profile_view(spark.read.parquet(path))


@query("report_json", S.facts("dirty_customer", S.DIRTY_CUSTOMER) + PROFILE_SELECT)
def report_json(spark, sf_dir):
    """A profile written as JSON lines and read back by its extension, whole."""
    path = f"{shared_folder(spark)}/report.json"
    found = profile.profile_columns(view(spark, sf_dir, "dirty_customer"))
    sinks.write_report(found, path, form="json")
    return profile_view(files.read_file(spark, path, schema=found.schema))


@query("metadata_json", "SELECT 'customer' AS name, count(*) AS row_count, CAST(5 AS BIGINT) AS column_count, count(*) - count(c_acctbal) AS total_null_count FROM " + sql("dirty_customer") + " c")
def metadata_json(spark, sf_dir):
    """A snapshot to JSON and back."""
    snap = metadata.snapshot(view(spark, sf_dir, "dirty_customer"), "customer", "file")
    back = sinks.from_json(sinks.to_json(snap), T.StructType(snap.schema.fields))
    return back.select("name", "row_count", "column_count", "total_null_count")


@query("snapshot_history", "SELECT 'customer' AS name, count(*) AS row_count, CAST(2 AS BIGINT) AS snapshots FROM customer")
def snapshot_history(spark, sf_dir):
    """Two snapshots appended to a partitioned history; the newest is read back."""
    path = f"{shared_folder(spark)}/history"
    for name in ("dirty_customer", "customer"):
        sinks.append_history(metadata.snapshot(view(spark, sf_dir, name), "customer", "file"), path)
    sinks.append_history(metadata.snapshot(base(spark, sf_dir, "nation"), "nation", "file"), path)
    latest = sinks.latest_snapshots(spark, path, "customer", 1).select("name", "row_count")
    count = spark.read.parquet(path).where("dataset = 'customer'").agg(F.count(F.lit(1)).alias("snapshots"))
    return latest.crossJoin(F.broadcast(count))  # one row each
