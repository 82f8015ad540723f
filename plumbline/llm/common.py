"""Helpers the corpus operators share: settled tables, distributed numbering, connected components."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from plumbline.functions.sizing import settle

BROADCAST_ROWS = 1_000_000  # most rows (of a few numbers each) that are broadcast


def worker_kept(name: object, make: Callable[[], object]) -> object:
    """An object that a Python worker makes once and keeps for all its tasks."""
    kept = sys.__dict__.setdefault("_plumbline_kept", {})
    if name not in kept:
        kept[name] = make()
    return kept[name]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches in small pieces, so a worker turns few texts at a time into Python objects.

    After each batch the worker gives back what Arrow has freed: an executor's memory holds several workers.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        pa.default_memory_pool().release_unused()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose crc32 of the id, written as text, leaves no rest by five.  A null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def running_before(value: Column, group: list[str], order: list[str]) -> Column:
    """Sum of ``value`` over the rows before this one in its group."""
    frame = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(frame), F.lit(0).cast("long"))


def numbered(df: DataFrame, group: list[str], bucket: str, order: list[str], name: str,
             weight: str | None = None) -> DataFrame:
    """Number the rows of each group from 0 by (bucket, order) without bringing a group into one task.

    ``bucket`` deals each group into pieces; rows are ranked inside a piece, and the pieces'
    totals give where each begins.  With ``weight`` the sum of that column before a row is
    returned instead of the number of rows.
    """
    amount = F.lit(1).cast("long") if weight is None else F.col(weight)
    keys = [*group, bucket]
    begins = (df.groupBy(*keys).agg(F.sum(amount).alias("_n"))
              .select(*[F.col(k).alias(f"_{k}") for k in keys],
                      running_before(F.col("_n"), group, [bucket]).alias("_begin")))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    inside = df.withColumn("_inside", running_before(amount, keys, order))
    return (inside.join(begins, same, "left").withColumn(name, F.col("_begin") + F.col("_inside"))
            .drop("_inside", "_begin", *[f"_{k}" for k in keys]))


def bounded(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint at a broadcast when the counted rows stay below the limit; a plain join otherwise."""
    return F.broadcast(df) if rows <= limit else df


def components(links: DataFrame) -> DataFrame:
    """Connected components of the pairs (a, b): rows (id, component), component being the smallest id.

    Randomised contraction: every vertex moves to the neighbour (or itself) with the smallest
    hash, the links are drawn between the new places, and loops and repeats fall away, until no
    link is left.  Each round is written to the shared folder; the joins are plain shuffles, so a
    vertex with very many links is only a key with many slim rows.
    """
    pairs = links.where(F.col("a") != F.col("b")).select("a", "b").distinct()
    both = settle(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    placed = both.select(F.col("a").alias("id"), F.col("a").alias("root")).distinct()
    while not both.isEmpty():
        moved = settle(
            both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("v"))).alias("m"))
            .select("a", F.least(F.col("m"), F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("v")))["v"].alias("to")))
        placed = placed.join(moved.withColumnRenamed("a", "root"), "root", "left").select("id", F.coalesce("to", "root").alias("root"))
        both = settle(both.join(moved, "a").select(F.col("to").alias("a"), "b")
                      .join(moved.select(F.col("a").alias("b"), F.col("to").alias("to_b")), "b")
                      .select("a", F.col("to_b").alias("b")).where("a != b").distinct())
    placed = settle(placed)
    smallest = placed.groupBy("root").agg(F.min("id").alias("component"))
    return placed.join(smallest, "root").select("id", "component")
