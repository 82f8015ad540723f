"""Exact nearest binary codes by incremental multi-index hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.functions.sizing import settle
from plumbline.llm.collision import usable
from plumbline.llm.common import bounded

SEGMENT = 16  # bits of one segment
WORD = 60  # bits of one number of a code
HOT = 4096  # codes of one (segment, value) that one task compares with a probe


def sign_bits(vector: Column, bits: int, width: int) -> Column:
    """The signs of a vector as integers of ``width`` bits (a component above zero is 1)."""
    starts = F.array(*[F.lit(1 + s) for s in range(0, bits, width)])
    return F.transform(starts, lambda s: F.aggregate(
        F.slice(vector, s, width), F.lit(0).cast("long"), lambda code, x: code * 2 + F.when(x > 0, 1).otherwise(0)))


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def nearest_codes(vectors: DataFrame, queries: DataFrame, bits: int, k: int = 10, id_col: str = "vec_id") -> DataFrame:
    """Rows (query_id, neighbor_id, distance, rank): the k nearest codes of each query but itself, ties by id.

    Equal codes are one entry of the index that keeps its k + 1 smallest ids, all that any answer can
    use.  The index holds a slim row (segment, value, code) of each code and segment.  In round r every open
    query probes, segment by segment, the values at Hamming distance r; a code within
    ``segments * (r + 1) - 1`` must agree with the query up to r in some segment, so once the kth verified
    distance is not above that, the query is closed.  Only codes met are joined to their ids.  A value that
    more than ``HOT`` codes share is dealt into parts by hash, and its probes go to each of them; the index
    itself is never broadcast.  Nothing is approximate and no candidate is dropped.  Vectors that are not
    usable or have another length than ``bits`` hold no code; a query without one has no rows.
    """
    def coded(df: DataFrame) -> DataFrame:
        fit = df.where(usable(F.col("embedding")) & (F.size("embedding") == bits) & F.col(id_col).isNotNull())
        return fit.select(F.col(id_col).alias("id"), sign_bits(F.col("embedding"), bits, WORD).alias("code"),
                          sign_bits(F.col("embedding"), bits, SEGMENT).alias("values"))

    segments = -(-bits // SEGMENT)
    every = settle(coded(vectors))
    first = every.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("id"))).where(F.col("n") <= k + 1)
    ids = settle(first.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("values").alias("values")))
    entries = ids.select(F.sum(F.size("ids"))).first()[0] or 0
    index = ids.select("code", F.posexplode("values").alias("segment", "value"))
    hot = settle(index.groupBy("segment", "value").agg(F.ceil(F.count("*") / HOT).cast("int").alias("parts")).where("parts > 1"))
    shared = bounded(hot, hot.count())
    index = settle(index.join(shared, ["segment", "value"], "left").select(
        "segment", "value", F.coalesce(F.pmod(F.hash("code"), F.col("parts")), F.lit(0)).alias("part"), "code"))
    asked = settle(coded(queries))
    open_ = asked.select("code", "values").distinct()
    best = None
    done: list[DataFrame] = []
    top = Window.partitionBy("asked").orderBy("distance", "id")
    for radius in range(SEGMENT + 1):
        masks = ",".join(str(m) for m in range(1 << SEGMENT) if m.bit_count() == radius)
        probes = open_.select(F.col("code").alias("asked"), F.posexplode("values").alias("segment", "own")).select(
            "asked", "segment", F.explode(F.split(F.lit(masks), ",").cast("array<long>")).alias("mask"), "own").select(
            "asked", "segment", F.col("own").bitwiseXOR(F.col("mask")).alias("value"))
        dealt = probes.join(shared, ["segment", "value"], "left").select(
            "asked", "segment", "value", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
        met = dealt.join(index.hint("merge"), ["segment", "value", "part"]).select("asked", "code", hamming(F.col("asked"), F.col("code")).alias("distance")).distinct()
        fresh = met.join(ids.select("code", "ids").hint("merge"), "code").select("asked", "distance", F.explode("ids").alias("id"))
        known = fresh if best is None else fresh.unionByName(best).distinct()
        ranked = settle(known.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k + 1))
        covered = segments * (radius + 1) - 1
        state = ranked.groupBy("asked").agg(F.count("*").alias("n"), F.max("distance").alias("worst"))
        closed = state.where(((F.col("n") == k + 1) & (F.col("worst") <= covered)) | (F.col("n") == entries) | F.lit(radius == SEGMENT))
        closed = settle(closed.select("asked"))
        done.append(ranked.join(closed, "asked", "left_semi"))
        open_ = settle(open_.join(closed, open_["code"] == closed["asked"], "left_anti"))
        best = ranked.join(closed, "asked", "left_anti").select("asked", "distance", "id")
        if open_.isEmpty():
            break
    answers = done[0]
    for more in done[1:]:
        answers = answers.unionByName(more)
    pairs = asked.select(F.col("id").alias("query_id"), F.col("code").alias("asked")).join(answers.drop("rank"), "asked").where("id != query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return pairs.distinct().withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("id").alias("neighbor_id"), "distance", "rank")
