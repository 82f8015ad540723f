"""Near-duplicate vectors by counting window collisions on one-dimensional projections."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.sizing import settle
from plumbline.llm.common import components

PROJECTIONS = 24
WIDTH = 1.5  # half window in deviations of a pair just at the threshold
MISS = 1e-4  # share of pairs just at the threshold that the collision count may lose
LEAD = 4.0  # half window of the leading projection, which deals vectors into cells, in the same unit
TILE = 1024  # vectors of one chunk


def distance_at(cosine: float) -> float:
    """Euclidean distance of unit vectors with this cosine."""
    return math.sqrt(2 - 2 * cosine)


def least_count(projections: int = PROJECTIONS, width: float = WIDTH, miss: float = MISS) -> int:
    """Largest count that a pair just at the threshold falls short of with probability ``miss`` at most.

    On a Gaussian projection such a pair differs by its distance times a standard normal number.
    """
    p, below = math.erf(width / math.sqrt(2)), 0.0
    for count in range(projections + 1):
        below += math.comb(projections, count) * p ** count * (1 - p) ** (projections - count)
        if below > miss:
            return count
    return projections


def usable(vector: Column) -> Column:
    """Vectors that can link: not null or zero, no null or non-finite component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def tile_links(left: pd.DataFrame, right: pd.DataFrame, same: bool, cosine: float) -> pd.DataFrame:
    """Links between two chunks: rows (id, other, links); ``other`` spans what hangs together in this tile."""
    a, b = (np.stack([np.asarray(v, np.float64) for v in side.embedding]) for side in (left, right))
    # scaling by the largest component first keeps squares of extreme numbers finite
    a, b = (x / np.abs(x).max(axis=1, keepdims=True) for x in (a, b))
    a, b = (x / np.sqrt((x * x).sum(axis=1, keepdims=True)) for x in (a, b))
    axes = np.random.default_rng(41).normal(size=(PROJECTIONS, a.shape[1]))
    half, kind = WIDTH * distance_at(cosine), np.uint16 if len(b) < 60_000 else np.uint32
    count = np.zeros((len(a), len(b)), np.uint8)
    for axis in axes:
        pa, pb = a @ axis, b @ axis
        order = np.argsort(pb, kind="stable")
        place = np.empty(len(b), kind)
        place[order] = np.arange(len(b), dtype=kind)
        ranked = pb[order]
        low = np.searchsorted(ranked, pa - half, "left")
        wide = (np.searchsorted(ranked, pa + half, "right") - low).astype(kind)
        count += (place[None, :] - low.astype(kind)[:, None]) < wide[:, None]
    linked = count >= least_count()
    rows, cols = np.nonzero(linked)
    for at in range(0, len(rows), 100_000):
        r, c = rows[at:at + 100_000], cols[at:at + 100_000]
        linked[r, c] = (a[r] * b[c]).sum(axis=1) >= cosine
    if same:
        np.fill_diagonal(linked, False)
    ids_a, ids_b = left.id.to_numpy(), right.id.to_numpy()
    links = [(ids_a, linked @ right.copies.to_numpy())]
    if not same:
        links.append((ids_b, left.copies.to_numpy() @ linked))
    ids, others, sums = [], [], []
    for side, n in links:
        ids.append(side[n > 0])
        others.append(side[n > 0])
        sums.append(n[n > 0])
    waiting = linked.any(axis=1)
    while waiting.any():
        inside, reached = np.zeros(len(a), bool), np.zeros(len(b), bool)
        front = np.array([waiting.argmax()])
        while len(front):
            inside[front] = True
            fresh = linked[front].any(axis=0) & ~reached
            reached |= fresh
            front = np.flatnonzero(linked[:, fresh].any(axis=1) & ~inside)
        waiting &= ~inside
        members = np.concatenate([ids_a[inside], ids_b[reached]])
        ids.append(members)
        others.append(np.full(len(members), members.min()))
        sums.append(np.zeros(len(members), np.int64))
    return pd.DataFrame({"id": np.concatenate(ids), "other": np.concatenate(others), "links": np.concatenate(sums).astype("int64")})


def near_vectors(vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id") -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.  Only vectors of one (not null) label and length compare.

    Equal vectors are one class; it counts its copies as links and enters the search once.  The
    leading projection cuts each label into cells as wide as its window, so a vector meets its own
    cell and the next ones; cells are cut into chunks of about ``TILE`` vectors and each pair of
    chunks is one task of bounded memory.  There every vector counts, over ``PROJECTIONS`` sorted
    projections, in how many windows around it the others fall; pairs that reach the calibrated count
    are verified in double precision.  A tile returns sums and one star per linked group, not its pairs.
    Vectors that are null, zero or not finite, or without a label, link with nothing.
    """
    base = vectors.select(F.col(id_col).alias("id"), "label", "embedding")
    fit = base.where(usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("id").isNotNull())
    width = F.lit(LEAD * distance_at(cosine))
    # by the largest component first, so that squares neither vanish nor overflow
    largest = F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))
    scaled = F.transform("embedding", lambda x: F.try_divide(x.cast("double"), largest))
    norm = F.sqrt(F.aggregate(scaled, F.lit(0.0), lambda s, x: s + x * x))
    lead = F.try_divide(F.aggregate(F.transform(scaled, lambda x, i: x * F.sqrt(F.lit(2.0)) * F.cos(
        (i + 1) * F.lit(2.399963229728653) + 1)), F.lit(0.0), lambda s, x: s + x), norm)
    cell = F.when(lead.isNull() | F.isnan(lead), 0).otherwise(F.floor(lead / width)).cast("long")
    classes = settle(fit.groupBy("label", "embedding").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
                     .withColumns({"cell": cell, "length": F.size("embedding")}))
    place = ["label", "length", "cell"]
    chunks = classes.groupBy(*place).agg(F.ceil(F.count("*") / TILE).alias("chunks"))
    chunked = classes.join(chunks, place).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")))
    single = chunks.select(*place, F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
    first = single.select("label", "length", F.col("cell").alias("cell_a"), F.col("chunk").alias("chunk_a"),
                          F.explode(F.array(F.col("cell"), F.col("cell") + 1)).alias("cell_b"))
    tiles = first.join(single.select("label", "length", F.col("cell").alias("cell_b"), F.col("chunk").alias("chunk_b")),
                       ["label", "length", "cell_b"]).where("cell_a != cell_b or chunk_a <= chunk_b").withColumn(
        "tile", F.xxhash64("label", "length", "cell_a", "chunk_a", "cell_b", "chunk_b"))
    same = (F.col("cell_a") == F.col("cell_b")) & (F.col("chunk_a") == F.col("chunk_b"))
    sides = [tiles.where(~same | F.lit(s == "a")).select("label", "length", F.col(f"cell_{s}").alias("cell"), F.col(f"chunk_{s}").alias("chunk"),
                          "tile", F.lit(s).alias("side"), same.alias("same")) for s in "ab"]
    dealt = chunked.join(sides[0].unionByName(sides[1]), [*place, "chunk"]).select("tile", "side", "same", "id", "copies", "embedding")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        left = rows[rows.side == "a"]
        return tile_links(left, left if rows.same.iloc[0] else rows[rows.side == "b"], bool(rows.same.iloc[0]), cosine)

    found = settle(dealt.groupBy("tile").applyInPandas(compare, f"id {dict(base.dtypes)['id']}, other {dict(base.dtypes)['id']}, links long"))
    sums = found.groupBy("id").agg(F.sum("links").alias("links"))
    linked = components(found.select(F.col("id").alias("a"), F.col("other").alias("b")))
    known = (classes.select("label", "embedding", "id", "copies").join(sums, "id", "left").join(linked, "id", "left")
             .select(F.col("label").alias("l"), F.col("embedding").alias("e"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"),
                     F.coalesce("component", "id").alias("c")))
    joined = base.join(known, (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("e")) & F.col("id").isNotNull(), "left")
    component = F.coalesce("c", "id")
    return joined.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                         F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
