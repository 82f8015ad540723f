"""Hard negatives for contrastive training by Fagin's threshold algorithm over sorted component lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.functions.sizing import settle
from plumbline.llm.common import slices

BLOCK = 4096  # rows of one block of sorted lists, about
ANCHORS = 512  # anchors of one group, about
STEP = 64  # positions that the first round of sorted access reads in every list
SAFE = 2.0 ** 52  # sums below it are exact in double precision


def whole(vector: Column) -> Column:
    """Vectors that take part: not null, no null or non-finite component."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def quantised(vectors: np.ndarray) -> np.ndarray:
    """floor(256 x) as whole numbers: doubles where sums of products stay exact, else Python integers."""
    scaled = np.floor(256.0 * vectors)
    if not vectors.size or np.abs(scaled).max() ** 2 * vectors.shape[1] < SAFE:
        return scaled
    exact = np.empty(vectors.shape, object)
    for place, x in np.ndenumerate(vectors):
        exact[place] = int(x) * 256 if abs(x) >= 2.0 ** 53 else int(np.floor(256.0 * x))
    return exact


class SortedLists:
    """A block of rows with one list per component, sorted by its value; rows stand in order of their ids."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], quantised(vectors[order])
        self.labels, self.kinds = np.unique(labels[order].astype(str), return_inverse=True)
        self.orders = np.argsort(self.values, axis=0, kind="stable").T  # rows by rising value, a list a component

    def other_labels(self, label: object) -> np.ndarray:
        at = int(np.searchsorted(self.labels, str(label)))
        if at == len(self.labels) or self.labels[at] != str(label):
            return np.ones(len(self.ids), bool)
        return self.kinds != at

    def walk(self, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, object]]:
        """Rounds of (rows met anew, their scores, threshold): no row yet to come scores above the threshold.

        A component above zero is read from its largest value down, one below zero from its smallest up;
        zero components add nothing and are not read.  Each round reads four times as deep as the one
        before; once half the block is met, the next round takes the rest, after which there is no threshold.
        """
        total, axes, values = len(self.ids), np.flatnonzero(anchor != 0), self.values
        if values.dtype != anchor.dtype:  # only one side needs Python integers
            values, anchor = (x if x.dtype == object else x.astype(np.int64).astype(object) for x in (values, anchor))
        if not len(axes):
            yield np.arange(total), np.zeros(total), None
            return
        down, lists = anchor[axes] > 0, self.orders[axes]
        waiting, every, depth = np.ones(total, bool), None, 0
        while depth < total:
            deep = total if every is not None else min(total, max(STEP, 4 * depth))
            if deep == total:
                rows = np.flatnonzero(waiting)
            else:
                met = np.zeros(total, bool)
                met[lists[down, total - deep:total - depth].ravel()] = True
                met[lists[~down, depth:deep].ravel()] = True
                rows = np.flatnonzero(met & waiting)
                waiting[rows] = False
            depth = deep
            if every is None and 2 * np.count_nonzero(waiting) < total:
                every = values @ anchor
            scores = every[rows] if every is not None else values[rows] @ anchor
            ends = np.where(down, lists[:, total - deep], lists[:, deep - 1])
            yield rows, scores, (None if deep == total else (values[ends, axes] * anchor[axes]).sum())

    def best(self, anchor: np.ndarray, use: np.ndarray, windows: list[tuple[object, object]], k: int) -> list[list[tuple[int, int]]]:
        """Per window the first ``k`` used rows (score, id) with low <= score <= high, by falling score, then id.

        Access stops once the threshold falls strictly below the kth score of each window, or below its low
        end where fewer are found; None leaves an end open, and a window whose ends cross holds nothing.
        """
        kept: list[list[tuple[int, int]]] = [[] for _ in windows]
        able = [w for w, (low, high) in enumerate(windows) if low is None or high is None or low <= high]
        for rows, scores, threshold in self.walk(anchor) if able else ():
            least = [kept[w][-1][0] if len(kept[w]) == k else windows[w][0] for w in able]
            fit = use[rows]
            if None not in least:
                fit &= (scores >= min(least)).astype(bool)
            if all(windows[w][1] is not None for w in able):
                fit &= (scores <= max(windows[w][1] for w in able)).astype(bool)
            there = np.flatnonzero(fit)
            there = there[np.argsort(-scores[there], kind="stable")]  # ties stay in order of ids
            falling = -scores[there]
            for w in able:
                low, high = windows[w]
                begin = 0 if high is None else int(np.searchsorted(falling, -high, "left"))
                stop = len(there) if low is None else int(np.searchsorted(falling, -low, "right"))
                found = [(int(scores[i]), int(self.ids[rows[i]])) for i in there[begin:min(stop, begin + k)].tolist()]
                kept[w] = sorted(kept[w] + found, key=lambda f: (-f[0], f[1]))[:k]
            ends = [kept[w][-1][0] if len(kept[w]) == k else windows[w][0] for w in able]
            if threshold is None or None not in ends and threshold < min(ends):
                break
        return kept


def _tiles(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Every block of ``left`` (keys, block, rows) beside every group of ``right`` (keys, group, rows) of equal keys.

    Both sides go to the pair of their numbers, so a tile is a key of its own and no key brings its rows together.
    """
    blocks = left.groupBy(*keys).agg(F.max("block").alias("blocks"))
    groups = right.groupBy(*keys).agg(F.max("group").alias("groups"))
    from_left = left.join(groups, keys).withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), "groups"))).drop("groups")
    from_right = right.join(blocks, keys).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), "blocks"))).drop("blocks")
    return from_left.join(from_right, [*keys, "block", "group"])


def _blocks(rows: DataFrame, keys: list[str], size: int, name: str) -> DataFrame:
    """Rows of equal keys dealt into numbered parts of about ``size``, each packed into one row."""
    parts = rows.groupBy(*keys).agg(F.ceil(F.count("*") / size).cast("long").alias("_parts"))
    placed = rows.join(parts, keys).withColumn(name, F.pmod(F.xxhash64("id"), F.col("_parts")))
    packed = [c for c in rows.columns if c not in keys]
    return placed.groupBy(*keys, name).agg(F.collect_list(F.struct(*packed)).alias(f"{name}_rows"))  # about ``size`` rows


def _ranked(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "other"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def _packed(rows: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    held = rows.values
    vectors = held.field("vector")
    return (np.asarray(held.field("id")), np.asarray(held.field("label").to_pylist(), object),
            np.asarray(vectors.flatten(), np.float64).reshape(len(vectors), -1))


def _whole_number(x: int) -> int:
    return max(-(1 << 63), min((1 << 63) - 1, x))


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
                   id_col: str = "vec_id") -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vectors`` holds id_col, label and embedding; ``anchors`` tells which rows are anchors.  Components count
    as floor(256 x), a score is an integer inner product; higher scores come first, then smaller ids.  An
    anchor's positives are its first ``positives`` other rows of its label; for each, the first ``negatives``
    rows of other labels with low * positive_score <= 100 * score <= high * positive_score are returned.

    Rows are dealt by hash into blocks of bounded size, positives within their label and negatives over all
    rows; a block keeps a sorted list of every component.  Groups of anchors meet all blocks, one at a time
    and in bounded memory, and each walks the lists by the threshold algorithm; the blocks' first rows are
    then ranked by Spark.  Rows with a null id, label or vector, or any null or non-finite component take no
    part; vectors of different lengths never compare; rows of one id are one row, that of the smallest label
    and then vector.  Scores beyond 64 bits are compared exactly
    and shown as the nearest long, which windows then start from.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    fit = vectors.select(F.col(id_col).alias("id"), "label", F.col("embedding").alias("vector"), F.coalesce(anchors, F.lit(False)).alias("asked")).where(
        F.col("id").isNotNull() & F.col("label").isNotNull() & whole(F.col("embedding")))
    one = fit.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("r"), F.max("asked").alias("asked"))
    rows = settle(one.select("id", "r.label", "r.vector", "asked", F.size("r.vector").alias("length")))
    asked = rows.where("asked").select("id", "label", "length", "vector")
    others = rows.select("id", "label", "length", "vector")

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            ids, labels, held = _packed(batch.column("block_rows")[0])
            lists = SortedLists(ids, labels, held)
            found = []
            group = _packed(batch.column("group_rows")[0])
            for anchor, own in zip(group[0].tolist(), quantised(group[2]), strict=True):
                for score, other in lists.best(own, lists.ids != anchor, [(None, None)], positives)[0]:
                    found.append((anchor, _whole_number(score), other))
            yield from _batch(found, ["anchor", "score", "other"], kind)

    label_blocks = _blocks(others.withColumn("own", F.col("label")), ["own", "length"], BLOCK, "block")
    label_groups = _blocks(asked.withColumn("own", F.col("label")), ["own", "length"], ANCHORS, "group")
    tiles = _tiles(settle(label_blocks), settle(label_groups), ["own", "length"])
    close = tiles.select("block_rows", "group_rows").mapInArrow(nearest, f"anchor {kind}, score long, other {kind}")
    near = settle(_ranked(close, ["anchor"], positives).select("anchor", F.col("score").alias("positive_score"), F.col("other").alias("positive")))

    def hard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            ids, labels, held = _packed(batch.column("block_rows")[0])
            lists = SortedLists(ids, labels, held)
            group, found = batch.column("group_rows")[0], []
            anchor_ids, own_labels, own = _packed(group)
            wanted = group.values.field("positives").to_pylist()
            for anchor, label, vector, goals in zip(anchor_ids.tolist(), own_labels.tolist(), quantised(own), wanted, strict=True):
                scores = [g["positive_score"] for g in goals]
                # whole bounds of the window: low * p <= 100 * s and 100 * s <= high * p
                windows = [(-(-low * p // 100), high * p // 100) for p in scores]
                for goal, first in zip(goals, lists.best(vector, lists.other_labels(label), windows, negatives), strict=True):
                    found += [(anchor, goal["positive"], goal["positive_score"], _whole_number(s), o) for s, o in first]
            yield from _batch(found, ["anchor", "positive", "positive_score", "score", "other"], kind)

    goals = near.groupBy("anchor").agg(F.collect_list(F.struct("positive", "positive_score")).alias("positives"))  # ``positives`` at most
    aimed = asked.join(goals.withColumnRenamed("anchor", "id"), "id")
    all_blocks = _blocks(others, ["length"], BLOCK, "block")
    tiles = _tiles(settle(all_blocks), settle(_blocks(aimed, ["length"], ANCHORS, "group")), ["length"])
    hardest = tiles.select("block_rows", "group_rows").mapInArrow(hard, f"anchor {kind}, positive {kind}, positive_score long, score long, other {kind}")
    ranked = _ranked(hardest, ["anchor", "positive"], negatives)
    return ranked.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("other").alias("negative_id"),
                         "positive_score", F.col("score").alias("negative_score"))


def _batch(rows: list[tuple], names: list[str], kind: str) -> Iterator[pa.RecordBatch]:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}
    types = [pa.int64() if "score" in n else kinds[kind] for n in names]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)
