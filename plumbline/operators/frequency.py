"""Value frequencies of all columns at once, and the per-column facts that follow from them.

The table is unpivoted in one scan to typed cells and pre-aggregated, so a value that fills
a third of the table crosses the shuffle once per task.  A second grouping by lower-cased
text finds values that differ only by case; a third gives one row per column.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window as W, functions as F, types as T

from plumbline.functions.columns import double_sql, family, groupable_sql, normalise, number, quoted
from plumbline.functions.sizing import local_frame, settle
from plumbline.functions.text import EDGE_SPACE, EDGE_SPACES, NUMERIC_TEXT
from plumbline.operators.scan import TableStats, stats_frame


def _typed(field: T.StructField) -> tuple[str, str, str]:
    """The cell as (text, long, double), one of them set; decimals keep text and value."""
    no_text, no_long, no_double = (f"CAST(NULL AS {t})" for t in ("STRING", "BIGINT", "DOUBLE"))
    col, kind = quoted(field.name), family(field.dataType)
    if kind in ("integer", "boolean"):
        return no_text, f"CAST({col} AS BIGINT)", no_double
    if kind == "datetime":
        if isinstance(field.dataType, T.DateType):
            return no_text, f"CAST(unix_date({col}) AS BIGINT)", no_double
        return no_text, f"unix_micros(CAST({col} AS TIMESTAMP))", no_double
    if kind == "float":
        return no_text, no_long, double_sql(field)
    if kind == "decimal":
        return f"CAST({col} AS STRING)", no_long, f"CAST({col} AS DOUBLE)"
    return groupable_sql(field), no_long, no_double


BROADCAST_DIGESTS = 1_000_000  # most row digests (of 16 bytes) that are broadcast
KEYS = {"s": "STRING", "l": "BIGINT", "d": "DOUBLE"}
# Kinds whose cells are one number; the others need text keys.
FIXED_WIDTH = ("integer", "boolean", "datetime", "float")


def _cells(df: DataFrame, fields: list[tuple[int, T.StructField]], *keep: str) -> DataFrame:
    """Unpivot to one row per present cell: kept columns, position, and the keys in use."""
    fixed = all(family(f.dataType) in FIXED_WIDTH for _, f in fields)
    used = ["l", "d"] if fixed else list(KEYS)
    parts = ", ".join(f"{i}, {', '.join(_typed(f)[-len(used):])}" for i, f in fields)
    long = df.selectExpr(*keep, f"stack({len(fields)}, {parts}) AS (position, {', '.join(used)})")
    return long.where(" OR ".join(f"{k} IS NOT NULL" for k in used))


def _all_keys(df: DataFrame, *rest: str) -> DataFrame:
    """The same rows with every key column; keys not in use are NULL."""
    keys = [k if k in df.columns else f"CAST(NULL AS {t}) AS {k}" for k, t in KEYS.items()]
    return df.selectExpr("position", *keys, *rest)


def value_frequencies(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per (column, distinct present value): position, s, l, d, cnt.

    Numbers, dates and booleans are grouped by fixed-width keys, apart from text.
    """
    wanted = [(i, f) for i, f in enumerate(df.schema.fields) if columns is None or f.name in columns]
    groups = [[w for w in wanted if (family(w[1].dataType) in FIXED_WIDTH) == fixed] for fixed in (True, False)]
    parts = []
    for fields in filter(None, groups):
        cells = _cells(df, fields)
        parts.append(_all_keys(cells.groupBy(*cells.columns).agg(F.expr("count(1) AS cnt")), "cnt"))
    if not parts:
        return df.sparkSession.range(0).selectExpr(
            "CAST(id AS INT) AS position", "'' AS s", "id AS l", "0.0D AS d", "id AS cnt")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


# The frequency key as text, by the column's own type.
_TIME_TEXT = """CASE WHEN dtype = 'date' THEN CAST(date_from_unix_date(CAST({0} AS INT)) AS STRING)
  WHEN kind = 'datetime' THEN CAST(timestamp_micros({0}) AS STRING) END"""
_AS_TEXT = """CASE WHEN kind = 'boolean' THEN CASE WHEN l = 1 THEN 'true' ELSE 'false' END
  WHEN dtype = 'date' THEN CAST(date_from_unix_date(CAST(l AS INT)) AS STRING)
  WHEN kind = 'datetime' THEN CAST(timestamp_micros(l) AS STRING)
  ELSE coalesce(s, CAST(l AS STRING), CAST(d AS STRING)) END"""


def frequency_facts(df: DataFrame, stats: TableStats, columns: list[str] | None = None,
                    z_threshold: float = 2.0, digests: bool = False, modes: bool = True) -> DataFrame:
    """One row per column that has a value.

    position, distinct, single (values seen once), mode, mode_count, first_time, last_time (dates
    as text), outliers (z-score), zeros, negatives, mixed_case, edge_space, numeric_cells, text_cells, min_length,
    max_length, total_length, total_words.  ``digests`` adds hash_xor and hash_sum over the
    distinct values.  Without ``modes`` the mode is NULL and the frequencies are read once only.
    """
    meta = stats_frame(df.sparkSession, stats).selectExpr(
        "position", "kind", "dtype", "kind = 'string' AS is_text", "mean",
        "CASE WHEN abs(std) < double('infinity') THEN std END AS std")  # NaN is above infinity: no score without a finite spread
    names = [c.name for c in stats.columns if columns is None or c.name in columns]
    fixed = [n for n in names if stats.by_name(n).kind in FIXED_WIDTH]
    other = [n for n in names if n not in fixed]
    parts = [_column_facts(df, meta, part, part is other, z_threshold, digests, modes)
             for part in (fixed, other) if part or not names]
    per_column = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    named = per_column.join(F.broadcast(meta.select("position", "kind", "dtype")), "position")
    return named.selectExpr(
        "position", "distinct", "single", f"{_AS_TEXT} AS mode", "top_count AS mode_count",
        f"{_TIME_TEXT.format('low_l')} AS first_time", f"{_TIME_TEXT.format('high_l')} AS last_time",
        "outliers", "zeros", "negatives", "mixed_case", "edge_space", "numeric_cells",
        "text_cells", "min_length", "max_length", "total_length", "total_words",
        *(("hash_xor", "hash_sum") if digests else ()))


def _column_facts(df: DataFrame, meta: DataFrame, columns: list[str], by_case: bool, z_threshold: float,
                  digests: bool, modes: bool) -> DataFrame:
    """Facts of some columns from their frequencies; ``by_case`` groups text by lower case first."""
    freq = value_frequencies(df, columns)
    typed = freq.join(F.broadcast(meta), "position").selectExpr(  # meta: one row per column of the table
        "position", "is_text", "s", "l", "d", "cnt", "CASE WHEN is_text THEN lower(s) END AS folded",
        "coalesce(d, CASE WHEN kind = 'integer' THEN CAST(l AS DOUBLE) END) AS v", "mean", "std")

    def cells(test: str) -> str:
        return f"coalesce(sum(CASE WHEN {test} THEN cnt END), 0)"

    text_aggs = {
        "edge_space": f"max(is_text AND s RLIKE r'{EDGE_SPACE}')",
        "numeric_cells": cells(f"is_text AND regexp_replace(s, r'{EDGE_SPACES}', '') RLIKE r'{NUMERIC_TEXT}'"),
        "text_cells": cells("is_text"),
        "min_length": "min(CASE WHEN is_text THEN length(s) END)",
        "max_length": "max(CASE WHEN is_text THEN length(s) END)",
        "total_length": "sum(CASE WHEN is_text THEN length(s) * cnt END)",
        "total_words": r"sum(CASE WHEN is_text THEN size(filter(split(s, r'(?U)\s+'), w -> w <> '')) * cnt END)",
    }
    if not by_case:  # no text here
        text_aggs = {"edge_space": "CAST(NULL AS BOOLEAN)", "numeric_cells": "0L", "text_cells": "0L",
                     "min_length": "CAST(NULL AS INT)", "max_length": "CAST(NULL AS INT)",
                     "total_length": "CAST(NULL AS BIGINT)", "total_words": "CAST(NULL AS BIGINT)"}
    # each distinct value has one of l, d, s, so the kind of key is part of its hash
    hashed = "xxhash64(l, d, s, CASE WHEN l IS NOT NULL THEN 1 WHEN s IS NOT NULL THEN 2 ELSE 3 END)"
    marks = {"hash_xor": f"bit_xor({hashed})", "hash_sum": f"sum(CAST({hashed} AS DECIMAL(38,0)))"} if digests else {}
    first = typed.groupBy("position", *(["folded"] if by_case else [])).agg(*map(F.expr, (
        "count(1) AS distinct", "count_if(cnt = 1) AS single",
        "max(cnt) AS top_count", "min(l) AS low_l", "max(l) AS high_l",
        f"{cells(f'abs(try_divide(v - mean, std)) > {number(float(z_threshold))}')} AS outliers",
        f"{cells('v = 0')} AS zeros", f"{cells('v < 0')} AS negatives",
        *[f"{agg} AS {name}" for name, agg in (text_aggs | marks).items()])))
    if not by_case:
        facts = first.withColumn("mixed_case", F.lit(False))
    else:
        facts = first.groupBy("position").agg(*map(F.expr, (
            "sum(distinct) AS distinct", "sum(single) AS single", "max(top_count) AS top_count", "min(low_l) AS low_l", "max(high_l) AS high_l",
            "max(folded IS NOT NULL AND distinct > 1) AS mixed_case", "max(edge_space) AS edge_space",
            "min(min_length) AS min_length", "max(max_length) AS max_length",
            *(("bit_xor(hash_xor) AS hash_xor", "sum(hash_sum) AS hash_sum") if digests else ()),
            *[f"sum({c}) AS {c}" for c in ("outliers", "zeros", "negatives", "numeric_cells", "text_cells",
                                           "total_length", "total_words")])))
    if not modes:
        return facts.withColumns({"l": F.lit(None).cast("long"), "d": F.lit(None).cast("double"), "s": F.lit(None).cast("string")})
    # the mode is the smallest of the most frequent values: looked up among those alone, so that the
    # aggregates over all values hold numbers only and stay in hash tables
    most = freq.join(F.broadcast(facts.select("position", "top_count")), "position").where("cnt = top_count")  # one row per column
    if by_case:
        tops = most.groupBy("position").agg(F.expr("min(named_struct('d', d, 's', s)) AS top")).selectExpr(
            "position", "CAST(NULL AS BIGINT) AS l", "top.d", "top.s")
    else:
        tops = most.groupBy("position").agg(F.min("l").alias("l"), F.min("d").alias("d")).withColumn("s", F.lit(None).cast("string"))
    return facts.join(F.broadcast(tops), "position", "left")


def sample_values(df: DataFrame, k: int = 5, order_col: str | None = None) -> DataFrame:
    """Up to ``k`` present values per column: column_name, rank, value.

    Without an order the smallest distinct values are shown; with ``order_col`` the first
    present values in that order.  Both rank-limit before the shuffle.
    """
    fields = list(enumerate(df.schema.fields))
    about = local_frame(df.sparkSession, {
        "position": (pa.int32(), [i for i, _ in fields]),
        "column_name": (pa.string(), [f.name for _, f in fields]),
        "kind": (pa.string(), [family(f.dataType) for _, f in fields]),
        "dtype": (pa.string(), [f.dataType.simpleString() for _, f in fields])})
    if order_col is None:
        cells, order = value_frequencies(df), ["l", "d", "s"]
    else:
        cells = _all_keys(_cells(df, fields, f"{quoted(order_col)} AS __at"), "__at")
        order = ["__at"]
    ranked = cells.withColumn("rank", F.row_number().over(W.partitionBy("position").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).join(F.broadcast(about), "position").selectExpr(
        "column_name", "rank", f"{_AS_TEXT} AS value")


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    """Group counts, most frequent first, ties by value."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("count")).orderBy(
        F.desc("count"), *columns)


def top_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The ``k`` most frequent present values; ties go to the smaller value."""
    return value_counts(df.where(F.col(column).isNotNull()), column).limit(k)


def row_digest(df: DataFrame) -> list[Column]:
    """Two 64-bit digests of a row; which cells are NULL is part of them."""
    cells = [F.col(quoted(c)) for c in df.columns]
    masks = []
    for at in range(0, len(cells), 62):
        bits = [F.when(c.isNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, c in enumerate(cells[at:at + 62])]
        masks.append(sum(bits[1:], bits[0]))
    return [F.xxhash64(F.lit(seed), *masks, *cells) for seed in (1, 2)]


def duplicate_rows(df: DataFrame, digest: Callable[[DataFrame], list[Column]] = row_digest) -> DataFrame:
    """One row: total_rows and duplicate_rows, the rows beyond the first of each equal set.

    Only 16 bytes of a row are shuffled first; rows whose digest repeats are then compared whole, so a
    clash of digests never counts as a repeat.  A table without repeats is read once.
    """
    flat = normalise(df)
    if not flat.columns:
        return df.selectExpr("count(1) AS total_rows", "greatest(count(1) - 1, 0L) AS duplicate_rows")
    marked = flat.withColumns({f"__d{i}": c for i, c in enumerate(digest(flat))})
    keys = [c for c in marked.columns if c not in flat.columns]
    seen = Observation()
    counts = marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).observe(
        seen, F.coalesce(F.sum("__n"), F.lit(0)).alias("rows"), F.count_if(F.col("__n") > 1).alias("repeated"))
    repeated = settle(counts.where("__n > 1").drop("__n"))
    total, few = df.sparkSession.range(1).select(F.lit(seen.get["rows"]).cast("long").alias("total_rows")), seen.get["repeated"] <= BROADCAST_DIGESTS
    if not seen.get["repeated"]:
        return total.withColumn("duplicate_rows", F.lit(0).cast("long"))
    suspects = marked.join(F.broadcast(repeated) if few else repeated, keys, "left_semi")
    same = suspects.groupBy(*keys, *[quoted(c) for c in flat.columns]).agg(F.expr("count(1) AS __n"))
    repeats = same.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicate_rows"))
    return total.crossJoin(F.broadcast(repeats))  # one row each
