"""Snapshots of a table's metadata, and fingerprints that do not depend on row order."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timezone
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from plumbline.functions.columns import NUMERIC_FAMILIES, family, groupable_sql, normalise, quoted
from plumbline.functions.sizing import estimated_bytes, local_frame, ratio
from plumbline.operators.frequency import duplicate_rows, frequency_facts
from plumbline.operators.scan import TableStats, stats_frame, table_stats


def column_metadata(df: DataFrame) -> DataFrame:
    """Per column: name, data_type, non_null_count, null_count, null_percentage."""
    stats = table_stats(df, moments=False, constants=False)
    return stats_frame(df.sparkSession, stats).select(
        "position", F.col("column_name").alias("name"), F.col("dtype").alias("data_type"),
        F.col("present_count").alias("non_null_count"), "null_count", _null_share())


def _null_share() -> Column:
    return F.round(F.coalesce(ratio(F.col("null_count"), F.col("total_count")) * 100, F.lit(0.0)), 2).alias(
        "null_percentage")


def snapshot(df: DataFrame, name: str, source_type: str, source_metadata: dict[str, str] | None = None) -> DataFrame:
    """One row describing the table: counts, names, types, type groups, missing cells, columns.

    Booleans count as numeric here.
    """
    stats = table_stats(df, moments=False, constants=False)
    cols = [(c.name, c.dtype, c.kind, c.present, c.missing,
             round(c.missing / stats.rows * 100, 2) if stats.rows else 0.0) for c in stats.columns]
    return _snapshot_row(df.sparkSession, name, source_type, source_metadata, cols, stats.rows, stats.missing_cells,
                         estimated_bytes(df))


def snapshot_from_schema(spark: SparkSession, schema: T.StructType, name: str, source_type: str,
                         row_count: int | None = None, source_metadata: dict[str, str] | None = None) -> DataFrame:
    """The snapshot of a warehouse table from its schema (and row count, when known), reading
    no data.  Missing-cell counts are NULL."""
    cols = [(f.name, f.dataType.simpleString(), family(f.dataType), None, None, None) for f in schema.fields]
    return _snapshot_row(spark, name, source_type, source_metadata, cols, row_count, None, None)


# fixed values: column types whose extremes Spark takes from Parquet footers
FOOTER_EXTREMES = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DateType)


@contextmanager
def _from_footers(spark: SparkSession) -> Iterator[None]:
    """Let Spark answer counts and extremes of Parquet files from their footers, and put the settings back after."""
    listed = spark.conf.get("spark.sql.sources.useV1SourceList")
    wanted = {"spark.sql.sources.useV1SourceList": ",".join(n for n in listed.split(",") if n.strip() != "parquet"),
              "spark.sql.parquet.aggregatePushdown": "true"}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def footer_query(spark: SparkSession, path: str, extremes: list[int] | None = None, counts: bool = True) -> DataFrame:
    """One row from the footers of Parquet files: n, p<i> present cells of column i, l<i> and h<i> its extremes (of all columns, or those named).

    To be planned under ``_from_footers``.  Nested columns have no counts; text, decimals and timestamps have
    no extremes, since footers may hold them cut short or not at all.  Footers count leaves, so columns behind
    a struct, a map or an array of nested values have neither.
    """
    df = spark.read.parquet(path)
    exprs = [F.count(F.lit(1)).alias("n")]
    for i, f in enumerate(df.schema.fields):
        if family(f.dataType) == "nested":
            if isinstance(f.dataType, T.ArrayType) and family(f.dataType.elementType) != "nested":
                continue  # one leaf
            break
        if counts:
            exprs.append(F.count(quoted(f.name)).alias(f"p{i}"))
        if isinstance(f.dataType, FOOTER_EXTREMES) and (extremes is None or i in extremes):
            exprs += [F.min(quoted(f.name)).alias(f"l{i}"), F.max(quoted(f.name)).alias(f"h{i}")]
    return df.agg(*exprs)


def footer_facts(spark: SparkSession, path: str) -> tuple[T.StructType, dict]:
    """The schema and the row of ``footer_query``; no column is read.

    A column without extremes in some footer, as where a file holds only nulls of it, gets none; then
    every column is asked for apart.
    """
    def asked(**which) -> dict | None:
        try:
            return footer_query(spark, path, **which).first().asDict()
        except Exception as problem:
            if "No min/max found" not in str(problem):
                raise
            return None

    with _from_footers(spark):
        schema = spark.read.parquet(path).schema
        row = asked()
        if row is None:
            row = asked(extremes=[])
            for i in range(len(schema)):
                row |= asked(extremes=[i], counts=False) or {}
        return schema, row


def column_facts_from_files(spark: SparkSession, path: str) -> DataFrame:
    """A row per column from Parquet footers alone: position, name, data_type, row_count, non_null_count, null_count, min_value, max_value.

    Extremes are text, as Spark writes the value; what footers cannot tell is NULL.  Footers leave NaN out of
    extremes and count it as present.
    """
    schema, row = footer_facts(spark, path)

    def shown(value) -> str | None:
        return None if value is None else str(value).lower() if isinstance(value, bool) else str(value)

    cols = [(i, f.name, f.dataType.simpleString(), row["n"], row.get(f"p{i}"), shown(row.get(f"l{i}")), shown(row.get(f"h{i}")))
            for i, f in enumerate(schema.fields)]
    kinds = {"position": pa.int32(), "name": pa.string(), "data_type": pa.string(), "row_count": pa.int64(),
             "non_null_count": pa.int64(), "min_value": pa.string(), "max_value": pa.string()}
    frame = local_frame(spark, {k: (t, [c[j] for c in cols]) for j, (k, t) in enumerate(kinds.items())})
    return frame.withColumn("null_count", F.col("row_count") - F.col("non_null_count"))


def snapshot_from_files(spark: SparkSession, path: str, name: str, source_type: str = "parquet",
                        source_metadata: dict[str, str] | None = None) -> DataFrame:
    """The snapshot of Parquet files from their footers, reading no column: counts, missing cells, types.

    The cells of nested columns are not counted in footers: their counts are NULL and they add nothing to
    total_null_count.  NaN counts as present here.
    """
    schema, row = footer_facts(spark, path)
    n, cols = row["n"], []
    for i, f in enumerate(schema.fields):
        present = row.get(f"p{i}")
        gone = None if present is None else n - present
        cols.append((f.name, f.dataType.simpleString(), family(f.dataType), present, gone,
                     None if gone is None else round(gone / n * 100, 2) if n else 0.0))
    return _snapshot_row(spark, name, source_type, source_metadata, cols, n, sum(c[4] or 0 for c in cols),
                         estimated_bytes(spark.read.parquet(path)))


def _snapshot_row(spark: SparkSession, name: str, source_type: str, facts: dict[str, str] | None, cols: list[tuple],
                  rows: int | None, missing: int | None, size: int | None) -> DataFrame:
    def named(*kinds: str) -> list[list[str]]:
        return [[c[0] for c in cols if c[2] in kinds]]

    text, count, names = pa.string(), pa.int64(), pa.list_(pa.string())
    column = pa.struct([("name", text), ("data_type", text), ("non_null_count", count), ("null_count", count),
                        ("null_percentage", pa.float64())])
    return local_frame(spark, {
        "name": (text, [name]), "source_type": (text, [source_type]), "row_count": (count, [rows]),
        "column_count": (count, [len(cols)]),
        "creation_time": (pa.timestamp("us", tz="UTC"), [datetime.now(timezone.utc)]),
        "size_bytes": (pa.decimal128(38, 0), [None if size is None else Decimal(size)]),
        "column_names": (names, [[c[0] for c in cols]]),
        "column_types": (pa.map_(text, text), [[(c[0], c[1]) for c in cols]]),
        "numeric_columns": (names, named(*NUMERIC_FAMILIES, "boolean")),
        "categorical_columns": (names, named("string", "nested", "interval")),
        "datetime_columns": (names, named("datetime")),
        "total_null_count": (count, [missing]),
        "columns": (pa.list_(column), [[
            {"name": n, "data_type": t, "non_null_count": p, "null_count": m, "null_percentage": share}
            for n, t, _, p, m, share in cols]]),
        "source_metadata": (pa.map_(text, text), [list((facts or {}).items())])})


def _mix(columns: list[Column]) -> list[Column]:
    """Order-free digest parts of a set of rows: xor and sum of 64-bit row hashes, and a count.

    The hash skips NULLs, so a bit mask of the NULL columns is hashed along with the values.
    """
    masks = []
    for start in range(0, len(columns), 62):
        bits = [F.when(c.isNull(), F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
                for i, c in enumerate(columns[start:start + 62])]
        masks.append(sum(bits[1:], bits[0]))
    h = F.xxhash64(*columns, *masks)
    return [F.bit_xor(h), F.sum(h.cast("decimal(38,0)")), F.count(F.lit(1))]


def extended_columns(df: DataFrame, stats: TableStats | None = None, samples: int = 0) -> DataFrame:
    """Column metadata with distinct and duplicate counts, extremes, moments and digests."""
    stats = stats or table_stats(df, constants=False)
    digest = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in ("hash_xor", "hash_sum", "distinct")]))
    facts = frequency_facts(df, stats, digests=True, modes=False).select("position", "distinct", digest.alias("value_hash"))
    frame = stats_frame(df.sparkSession, stats)
    unique = F.coalesce("distinct", F.lit(0))
    out = frame.join(F.broadcast(facts), "position", "left").select(
        "position", F.col("column_name").alias("name"), F.col("dtype").alias("data_type"), "kind",
        F.col("present_count").alias("non_null_count"), "null_count", _null_share(),
        unique.alias("unique_count"), (F.col("total_count") - unique).alias("duplicate_count"),
        "min_value", "max_value", F.col("mean").alias("mean_value"), F.col("std").alias("std_value"),
        F.coalesce("value_hash", F.md5(F.lit("empty_column"))).alias("value_hash"))
    digest = F.md5(F.to_json(F.struct("non_null_count", "null_count", "unique_count", "data_type",
                                      *[F.round(c, 6).alias(c) for c in ("mean_value", "std_value")],
                                      "min_value", "max_value")))
    out = out.withColumn("stats_hash", digest)
    if samples:
        from plumbline.operators.frequency import sample_values
        # at most ``samples`` values per column
        picked = sample_values(df, samples).groupBy(F.col("column_name").alias("name")).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda s: s["value"]).alias("sample_values"))
        out = out.join(F.broadcast(picked), "name", "left")
    return out


def schema_hash(df: DataFrame) -> Column:
    """Digest of column names and types."""
    return F.md5(F.lit(repr([(n, t) for n, t in df.dtypes])))


def content_hash(df: DataFrame) -> DataFrame:
    """One row: digest over all rows, independent of their order."""
    flat = normalise(df)
    parts = [p.cast("string") for p in _mix([F.col(f"`{c}`") for c in flat.columns])]
    return flat.agg(F.md5(F.concat_ws("|", *parts)).alias("content_hash"))


def _fixed_text(field: T.StructField) -> str:
    """A cell as text that does not depend on the engine's settings; NULL and NaN give NULL."""
    key, kind = groupable_sql(field), family(field.dataType)
    if isinstance(field.dataType, T.DateType):
        return f"CAST(unix_date({key}) AS STRING)"
    return f"CAST(unix_micros(CAST({key} AS TIMESTAMP)) AS STRING)" if kind == "datetime" else f"CAST({key} AS STRING)"


def additive_digest(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Digest of the rows as a multiset, per group of ``by``: row_count, high, low.

    A row is written as its cells' texts, each behind its length (missing ones are ``-``); high and low are
    the sums of the first and second half of the rows' md5, as whole numbers.  So the digest does not depend
    on order, counts repeats, and follows a table by adding or subtracting the digests of changed rows.
    """
    by = by or []
    cells = [_fixed_text(f) for f in df.schema.fields if f.name not in by]
    written = "concat(" + ", ".join(["''", *[f"coalesce(concat(length({c}), ':', {c}), '-')" for c in cells]]) + ")"
    marked = df.selectExpr(*[quoted(c) for c in by], f"md5({written}) AS __md5")
    halves = {name: f"sum(CAST(conv(substr(__md5, {at}, 16), 16, 10) AS DECIMAL(20, 0)))" for name, at in (("high", 1), ("low", 17))}
    return marked.groupBy(*[quoted(c) for c in by]).agg(F.expr("count(1) AS row_count"), *[
        F.expr(f"CAST(coalesce({agg}, 0) AS DECIMAL(38, 0)) AS {name}") for name, agg in halves.items()])


def changed_digest(digest: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """The digest of a table after rows came and went, from the digests of the three; no other row is read."""
    signed = [digest.selectExpr("1 AS sign", "*")]
    signed += [d.selectExpr(f"{sign} AS sign", "*") for d, sign in ((added, 1), (removed, -1)) if d is not None]
    every = signed[0]
    for more in signed[1:]:
        every = every.unionByName(more)
    return every.agg(*[F.expr(f"CAST(sum(sign * {c}) AS {'BIGINT' if c == 'row_count' else 'DECIMAL(38, 0)'}) AS {c}") for c in ("row_count", "high", "low")])


def extended_snapshot(df: DataFrame, name: str, source_type: str) -> DataFrame:
    """One row: the snapshot with duplicate rows, score, digests and extended columns."""
    stats = table_stats(df, constants=False)
    cols = extended_columns(df, stats)
    listed = F.array_sort(F.collect_list(F.struct(
        "position", "name", "data_type", "non_null_count", "null_count", "null_percentage", "unique_count",
        "duplicate_count", "min_value", "max_value", "mean_value", "std_value", "value_hash", "stats_hash")))
    packed = cols.agg(listed.alias("columns"))  # one entry per column of the table
    complete = (stats.cells - stats.missing_cells) / stats.cells * 100 if stats.cells else 0.0
    unique = F.coalesce(ratio(F.col("row_count") - F.col("total_duplicate_rows"), F.col("row_count")) * 100, F.lit(0.0))
    dup = duplicate_rows(df).select(F.col("total_rows").alias("row_count"),
                                    F.col("duplicate_rows").alias("total_duplicate_rows"))
    both = dup.crossJoin(F.broadcast(content_hash(df))).crossJoin(F.broadcast(packed))  # one row each
    return both.select(
        F.lit(name).alias("name"), F.lit(source_type).alias("source_type"), "row_count",
        F.lit(len(stats.columns)).cast("bigint").alias("column_count"), F.current_timestamp().alias("creation_time"),
        F.lit(estimated_bytes(df)).cast("decimal(38,0)").alias("size_bytes"),
        F.lit(stats.missing_cells).cast("bigint").alias("total_null_count"), "total_duplicate_rows",
        F.when(F.col("row_count") > 0, F.round(F.lit(complete) * 0.7 + unique * 0.3, 2)).otherwise(0.0)
        .alias("data_quality_score"),
        schema_hash(df).alias("schema_hash"),
        F.md5(F.concat_ws("|", F.lit(repr(df.dtypes)), F.col("row_count").cast("string"))).alias("structure_hash"),
        "content_hash",
        F.md5(F.concat_ws("|", F.col("row_count").cast("string"), F.col("total_duplicate_rows").cast("string"),
                          F.concat_ws(",", F.transform("columns", lambda c: c["stats_hash"])))).alias("stats_hash"),
        "columns")
