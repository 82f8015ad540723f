"""Heavy hitters, distinct-count states, duplicates by digest, additive digests."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.operators import frequency, metadata, sketches


def plain_top(values, k):
    return sorted(Counter(v for v in values if v is not None and v == v).items(), key=lambda t: (-t[1], t[0]))[:k]


@pytest.mark.parametrize(("values", "tracked", "proven"), [
    ([i % 7 for i in range(500)] + [None] * 40, 100, True),
    ([0] * 400 + [1] * 300 + list(range(2, 4000)), 60, True),  # far more values than the sketch keeps
    (list(range(3000)) * 2, 60, False),  # nothing frequent
    ([], 100, True),
])
def test_heavy_hitters(spark, values, tracked, proven):
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(4)
    k = 2 if len(set(values)) > 100 else 5
    assert sketches.heavy_hitters(df, "v", k, tracked)[1] is proven
    assert [tuple(r) for r in sketches.top_values_sketched(df, "v", k, tracked).collect()] == plain_top(values, k)


def test_heavy_hitters_of_other_types(spark):
    df = spark.createDataFrame([(float("nan"), "a b", [1]), (0.5, "a b", [1]), (0.5, "c", [2]), (None, None, None)], "`d x` double, s string, a array<int>")
    assert [tuple(r) for r in sketches.top_values_sketched(df, "d x", 3).collect()] == [(0.5, 2)]
    assert [tuple(r) for r in sketches.top_values_sketched(df, "s", 1).collect()] == [("a b", 2)]
    assert sketches.heavy_hitters(df, "a") == (None, False)
    assert sketches.top_values_sketched(df, "a", 1).first()["count"] == 2


def test_sketched_plan_shuffles_candidates_only(spark):
    df = spark.range(5000).selectExpr("CASE WHEN id % 3 = 0 THEN -1 ELSE id END AS v")
    counted, proven = sketches.heavy_hitters(df, "v", 1, 50)
    assert proven and counted.count() <= 50


def test_distinct_states(spark):
    df = spark.range(30_000).selectExpr("id AS i", "CASE WHEN id % 2 = 0 THEN CAST(id % 100 AS STRING) END AS s", "CAST('nan' AS DOUBLE) AS d", "id % 4 AS part")
    whole = {r["column_name"]: r["distinct"] for r in sketches.distinct_counts(df, approximate=True).collect()}
    exact = {r["column_name"]: r["distinct"] for r in sketches.distinct_counts(df).collect()}
    assert exact == {"i": 30_000, "s": 50, "d": 0, "part": 4}
    assert all(abs(whole[c] - n) <= 0.03 * n for c, n in exact.items())
    states = sketches.distinct_states(df, ["part"])
    stored = sketches.merged_states(states.where("part < 3")).unionByName(sketches.merged_states(states.where("part = 3")))
    later = {r["column_name"]: r["n"] for r in sketches.merged_states(stored).select("column_name", F.hll_sketch_estimate("state").alias("n")).collect()}
    assert all(abs(later[c] - exact[c]) <= 0.03 * exact[c] for c in later)


def test_duplicates_survive_clashing_digests(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (None, "a"), (None, "a"), (None, None), (3, "b")], "x int, s string")
    for digest in (frequency.row_digest, lambda d: [F.lit(1)], lambda d: [F.col("s")]):
        assert tuple(frequency.duplicate_rows(df, digest).first()) == (7, 2)
    assert tuple(frequency.duplicate_rows(df.limit(0)).first()) == (0, 0)
    assert tuple(frequency.duplicate_rows(df.where("x > 1")).first()) == (2, 0)


def test_first_exchange_holds_digests_only(spark):
    df = spark.range(100).selectExpr("id % 7 AS i", "repeat('x', 50) AS long_text")
    keys = frequency.row_digest(df)
    assert len(keys) == 2 and [t for _, t in df.select(*keys).dtypes] == ["bigint", "bigint"]


def test_additive_digest(spark):
    rows = [(1, "a", 0.5), (2, None, float("nan")), (1, "a", 0.5), (3, "b:1", None)]
    df = spark.createDataFrame(rows, "x int, s string, d double")
    whole = metadata.additive_digest(df).first()
    assert metadata.additive_digest(df.orderBy("d")).first() == whole
    assert metadata.additive_digest(df.distinct()).first() != whole  # repeats count
    parts = metadata.additive_digest(df.withColumn("p", F.col("x") % 2), ["p"]).drop("p")
    assert metadata.changed_digest(metadata.additive_digest(df.limit(0)), parts).first() == whole
    gone = metadata.changed_digest(metadata.additive_digest(df), removed=metadata.additive_digest(df.where("x = 3"))).first()
    assert gone == metadata.additive_digest(df.where("x <> 3")).first()
    moved = spark.createDataFrame([(1, "a1:", 0.5), (2, None, None), (1, "a", 0.5), (3, "b", None)], "x int, s string, d double")
    assert metadata.additive_digest(moved).first() != whole
