"""Exact heavy hitters from a bounded sketch, and mergeable distinct counts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F, types as T

from plumbline.functions.columns import family, groupable_sql, is_missing, quoted
from plumbline.operators.frequency import top_values

TRACKED = 10_000  # values that the sketch of frequent values keeps
CANDIDATE_BYTES = 32 << 20  # most bytes of candidates that are broadcast
LG_K = 14  # a distinct-count state has 2 ** LG_K registers: relative error 0.8 %


def sketch_error(rows: int, tracked: int) -> float:
    """Most occurrences of a value that the sketch may have lost.

    The sketch keeps a hash map of the next power of two above tracked / 0.75 slots; its guaranteed error
    is 3.5 / slots of the rows, merged sketches included.
    """
    slots = 1 << math.ceil(math.log2(math.ceil(tracked / 0.75)))
    return 3.5 * rows / slots


def heavy_hitters(df: DataFrame, column: str, k: int = 10, tracked: int = TRACKED) -> tuple[DataFrame | None, bool]:
    """(rows (value, count) of all values that may be among the ``k`` most frequent, whether that is proven).

    Tasks keep a bounded sketch of frequent values; the merged sketch names at most ``tracked`` candidates and
    one pass counts them exactly.  A value that is no candidate occurs at most ``sketch_error`` times, so the
    answer is proven when the kth exact count is above that, or when the candidates are all there is.  Types
    the sketch does not take, and candidates too long to broadcast, give (None, False).
    """
    field = df.schema[column]
    if family(field.dataType) in ("nested", "interval") or isinstance(field.dataType, (T.BinaryType, T.TimestampNTZType)):
        return None, False
    present = df.where(~is_missing(field)).select(F.col(quoted(column)).alias("value"))
    found = present.agg(F.expr(f"approx_top_k(value, {tracked}, {tracked})").alias("top"), F.count("*").alias("n"))
    named = found.select("n", F.expr("transform(top, t -> t.item)").alias("items"))  # one row of ``tracked`` values at most
    size = named.select("n", F.expr("aggregate(items, 0L, (s, x) -> s + octet_length(CAST(x AS STRING)) + 16L)").alias("bytes")).first()
    if size["bytes"] is not None and size["bytes"] > CANDIDATE_BYTES:
        return None, False
    candidates = named.select(F.explode("items").alias("value"))
    counted = present.join(F.broadcast(candidates), "value").groupBy("value").agg(F.count("*").alias("count"))
    held = counted.agg(F.sum("count").alias("all"), F.slice(F.sort_array(F.collect_list("count"), False), k, 1).alias("kth")).first()
    covered = (held["all"] or 0) == size["n"]
    return counted, covered or bool(held["kth"]) and held["kth"][0] > sketch_error(size["n"], tracked)


def top_values_sketched(df: DataFrame, column: str, k: int = 10, tracked: int = TRACKED) -> DataFrame:
    """The rows of ``top_values`` (column, count) without a shuffle of all distinct values.

    Falls back to counting every value where the sketch proves nothing, such as for values that are all
    about equally frequent.
    """
    counted, proven = heavy_hitters(df, column, k, tracked)
    if not proven:
        return top_values(df.where(~is_missing(df.schema[column])), column, k)
    return counted.orderBy(F.desc("count"), "value").limit(k).select(F.col("value").alias(column), "count")


def distinct_states(df: DataFrame, by: list[str] | None = None, lg_k: int = LG_K) -> DataFrame:
    """Mergeable distinct-count states: (by..., position, column_name, state).

    A state is a few kilobytes whatever the table, so it can be stored with the history of a table and
    merged with the states of later parts.  ``by`` gives states of groups, such as the parts of a table.
    """
    by = by or []
    fields = [(i, f) for i, f in enumerate(df.schema.fields) if f.name not in by]
    aggs = []
    for i, f in fields:
        key = groupable_sql(f)
        aggs.append(F.expr(f"hll_sketch_agg(CASE WHEN {key} IS NOT NULL THEN xxhash64({key}) END, {lg_k}) AS s{i}"))
    wide = df.groupBy(*[quoted(c) for c in by]).agg(*aggs)
    parts = ", ".join(f"""{i}, '{f.name.replace("'", "''")}', s{i}""" for i, f in fields)
    return wide.selectExpr(*[quoted(c) for c in by], f"stack({len(fields)}, {parts}) AS (position, column_name, state)")


def merged_states(states: DataFrame, by: list[str] | None = None) -> DataFrame:
    """States of the same column (and ``by``) as one."""
    return states.groupBy(*(by or []), "position", "column_name").agg(F.hll_union_agg("state").alias("state"))


def distinct_counts(df: DataFrame, approximate: bool = False, lg_k: int = LG_K) -> DataFrame:
    """(position, column_name, distinct) of every column; ``approximate`` estimates them in one pass without a shuffle of values."""
    if approximate:
        return distinct_states(df, lg_k=lg_k).select("position", "column_name", F.hll_sketch_estimate("state").alias("distinct"))
    from plumbline.operators.frequency import value_frequencies
    names = df.sparkSession.createDataFrame([(i, f.name) for i, f in enumerate(df.schema.fields)], "position int, column_name string")
    counts = value_frequencies(df).groupBy("position").agg(F.count("*").alias("distinct"))
    return names.join(F.broadcast(counts), "position", "left").select("position", "column_name", F.coalesce("distinct", F.lit(0)).alias("distinct"))
