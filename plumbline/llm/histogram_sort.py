"""Histogram sort: exact byte counts below candidate boundaries lead to splitters, then one exchange."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.sizing import settle
from plumbline.llm.common import running_before

KEY_LENGTH = 32  # hexadecimal digits: 16 of the text's hash, 16 of the other columns'
STEP = 2  # digits by which a candidate boundary is refined in one round


def sort_key(columns: list[Column], tie: list[Column]) -> Column:
    """A text whose order is the sort order: equal ``columns`` lie together, ``tie`` orders them inside."""
    def digits(cols: list[Column]) -> Column:
        return F.lpad(F.hex(F.xxhash64(*cols)), KEY_LENGTH // 2, "0")
    return F.concat(digits(columns), digits(tie))


def splitters(keyed: DataFrame, parts: int, tolerance: float = 0.002) -> list[str]:
    """Boundaries that cut (key, size) rows into ``parts`` of equal bytes; a part begins at its boundary.

    Each round counts the exact bytes below 256 candidates inside every bracket that is still open.
    A bracket closes when its nearer end misses the target by at most ``tolerance`` of a part or a
    key cannot be refined.  What is collected is bounded by ``parts`` * 256 rows, whatever the data.
    """
    total = keyed.agg(F.sum("size")).first()[0] or 0
    slack = tolerance * total / parts
    found: dict[int, str] = {}
    open_: dict[str, tuple[int, list[int]]] = {"": (0, list(range(1, parts)))} if total else {}
    while open_:
        by_length: dict[int, list[str]] = {}
        for prefix in open_:
            by_length.setdefault(len(prefix), []).append(prefix)
        probes = [keyed.where(F.substring("key", 1, n).isin(prefixes)).select(
                      F.substring("key", 1, n).alias("prefix"), F.substring("key", 1, n + STEP).alias("probe"), "key", "size")
                  for n, prefixes in by_length.items()]
        frame = probes[0]
        for more in probes[1:]:
            frame = frame.unionByName(more)
        histogram: dict[str, list] = {}
        for r in sorted(frame.groupBy("prefix", "probe").agg(
                F.sum("size").alias("bytes"), F.min("key").alias("low"), F.max("key").alias("high")).collect()):
            histogram.setdefault(r["prefix"], []).append(r)
        refined: dict[str, tuple[int, list[int]]] = {}
        for prefix, (below, targets) in open_.items():
            rows, at = histogram[prefix], 0
            for target in targets:
                goal = total * target / parts
                while at < len(rows) - 1 and below + rows[at]["bytes"] <= goal:
                    below += rows[at]["bytes"]
                    at += 1
                row = rows[at]
                left, right = abs(goal - below), abs(goal - below - row["bytes"])
                if min(left, right) <= slack or row["low"] == row["high"]:
                    found[target] = row["low"] if left <= right else row["high"] + "~"  # "~" sorts behind every digit
                else:
                    common = os.path.commonprefix([row["low"], row["high"]])
                    refined.setdefault(common, (below, []))[1].append(target)
        open_ = refined
    return [found[t] for t in sorted(found)]


def _passed(bounds: Column) -> Column:
    """How many of the boundaries are not above the row's key."""
    return F.size(F.filter(bounds, lambda bound: bound <= F.col("key")))


def shard_by_bytes(df: DataFrame, key: Column, size: Column, shards: int = 16, blocks: int = 16) -> DataFrame:
    """Add ``size``, ``shard`` (0 to shards - 1, near equal bytes) and ``slot`` (the row's place in its shard's order).

    The splitters cut every shard into ``blocks`` more, the unit of the one exchange and of sorting;
    a slot is the place inside a block plus the rows of the shard's earlier blocks.  Equal keys stay
    together unless they are heavier than a block and differ in their tie columns; rows that agree in
    every column share one shard.  An empty table gives no rows.  Columns of ``df`` named key, size,
    block, shard or slot are replaced.
    """
    keyed = settle(df.withColumns({"key": key, "size": size}))
    bounds = splitters(keyed.select("key", "size"), shards * blocks)
    outer, inner = bounds[blocks - 1::blocks], [bounds[s * blocks:(s + 1) * blocks - 1] for s in range(shards)]
    dealt = (keyed.withColumn("shard", _passed(F.array(*map(F.lit, outer)).cast("array<string>")))
             .withColumn("block", _passed(F.element_at(F.array(*[F.array(*map(F.lit, b)).cast("array<string>") for b in inner]), F.col("shard") + 1))))
    begins = (dealt.groupBy("shard", "block").agg(F.count("*").alias("_n"))
              .select("shard", "block", running_before(F.col("_n"), ["shard"], ["block"]).alias("_begin")))
    inside = dealt.withColumn("_inside", running_before(F.lit(1), ["shard", "block"], ["key"]))
    return (inside.join(F.broadcast(begins), ["shard", "block"])  # shards * blocks rows
            .withColumn("slot", F.col("_begin") + F.col("_inside")).drop("_begin", "_inside", "block", "key"))
