"""Exact quantiles, profiles and outliers on hand-made and random tables."""

import math
import random
import statistics

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from plumbline.operators import anomaly, frequency, outliers, profile, quantiles, rolling
from plumbline.operators.scan import table_stats

PROBS = [0.0, 0.02, 0.25, 0.5, 0.75, 0.98, 1.0]


def frame(spark, values, kind="double"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id bigint, v {kind}")


@pytest.mark.parametrize("shape", ["uniform", "hot", "hot_edge", "heavy", "few", "negative"])
def test_bracketed_quantiles_are_exact(spark, shape):
    rng = np.random.default_rng(7)
    values = {"hot_edge": np.concatenate([np.full(10_000, 7.0), 7 + rng.random(5_000), rng.random(15_000) * 7]),
              "uniform": rng.random(30_000), "hot": np.where(rng.random(30_000) < 0.4, 5.0, rng.random(30_000) * 10),
              "heavy": rng.pareto(0.3, 30_000), "few": rng.integers(0, 4, 30_000).astype(float),
              "negative": -rng.exponential(3, 30_000)}[shape]
    df = spark.createDataFrame(pd.DataFrame({"v": values})).repartition(6)
    probs = [*PROBS, 0.5001, 0.8333, 0.834]
    got = quantiles.exact_quantiles(df, {"v": F.col("v")}, probs, direct_rows=0, bracket_rows=60)["v"]
    assert got == pytest.approx(list(np.quantile(values, probs)), rel=1e-12)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=40))
def test_small_quantiles(spark, values):
    df = frame(spark, values)
    for direct in (0, 1000):
        got = quantiles.exact_quantiles(df, {"v": F.col("v")}, PROBS, direct_rows=direct, bracket_rows=3)["v"]
        assert got == pytest.approx(list(np.quantile(values, PROBS)), rel=1e-9, abs=1e-9)


def test_quantiles_of_nothing(spark):
    df = frame(spark, [None, None])
    for direct in (0, 1000):
        assert quantiles.exact_quantiles(df, {"v": F.col("v")}, [0.5], direct_rows=direct) == {"v": [None]}


def test_infinite_values(spark):
    df = frame(spark, [1.0, 2.0, math.inf, -math.inf, 3.0])
    for direct in (0, 1000):
        assert quantiles.exact_quantiles(df, {"v": F.col("v")}, [0.5], direct_rows=direct)["v"] == [2.0]


def by_name(df):
    return {r["column_name"]: r for r in df.collect()}


def test_profile_counts_nan_as_missing(spark):
    got = by_name(profile.profile_columns(frame(spark, [1.0, math.nan, None, 3.0])))["v"]
    assert (got["null_count"], got["unique_count"], got["duplicate_count"]) == (2, 2, 2)
    assert (got["mean"], got["median"]) == (2.0, 2.0)
    assert got["std"] == pytest.approx(math.sqrt(2))


def test_profile_of_empty_and_one_row(spark):
    got = by_name(profile.profile_columns(frame(spark, [])))["v"]
    assert (got["total_count"], got["unique_count"], got["quality_score"], got["data_quality_issues"]) == (0, 0, None, [])
    one = by_name(profile.profile_columns(frame(spark, [4.0])))["v"]
    assert (one["std"], one["outliers_count"], one["mode"]) == (None, 0, "4.0")


def test_mode_tie_takes_the_smallest(spark):
    assert by_name(profile.profile_columns(frame(spark, [9, 3, 9, 3, 1], "bigint")))["v"]["mode"] == "3"
    assert by_name(profile.profile_columns(frame(spark, ["b", "a", "b", "a"], "string")))["v"]["mode"] == "a"


def test_string_rules(spark):
    values = ["Ab", "aB", "\tx", "y ", "z"]
    issues = by_name(profile.profile_columns(frame(spark, values, "string")))["v"]["data_quality_issues"]
    assert any(i.startswith("INCONSISTENT_CASING") for i in issues)
    assert any(i.startswith("WHITESPACE_ISSUES") for i in issues)
    clean = by_name(profile.profile_columns(frame(spark, ["Ab", "cd"], "string")))["v"]["data_quality_issues"]
    assert clean == []


def test_id_gaps_with_long_ids(spark):
    base = 2 ** 60
    gap = by_name(profile.profile_columns(frame(spark, [base, base + 1, base + 3], "bigint")))["v"]
    full = by_name(profile.profile_columns(frame(spark, [base, base + 1, base + 2], "bigint")))["v"]
    assert any(i.startswith("ID_GAPS") for i in gap["data_quality_issues"])
    assert full["data_quality_issues"] == [] and full["unique_count"] == 3


def test_thresholds_are_strict(spark):
    half = by_name(profile.profile_columns(frame(spark, [1.0, 2.0, None, None])))["v"]["data_quality_issues"]
    assert half == ["MODERATE_NULL_RATE: 50.0% null values"]
    tenth = by_name(profile.profile_columns(frame(spark, [float(i) for i in range(9)] + [None])))["v"]
    assert tenth["data_quality_issues"] == []


def test_categorical_columns_may_repeat(spark):
    df = spark.createDataFrame([("a",)] * 300, "c string")
    plain = by_name(profile.profile_columns(df))["c"]
    marked = by_name(profile.profile_columns(df, categorical=("c",)))["c"]
    assert plain["data_quality_issues"] == ["LOW_UNIQUENESS: Only 0.33% unique values"]
    assert (marked["data_type"], marked["data_quality_issues"]) == ("categorical", [])


def test_all_types_profile(spark):
    df = spark.sql("""SELECT true AS b, DATE '2024-02-03' AS d, TIMESTAMP '2024-01-01 10:00:00' AS t, 1.50BD AS m,
        array(1, 2) AS a, map('k', 1) AS mp, named_struct('x', 1) AS s, INTERVAL '1' DAY AS i, CAST(7 AS SMALLINT) AS sm""")
    got = by_name(profile.profile_columns(df.union(df)))
    assert {r["unique_count"] for r in got.values()} == {1}
    assert got["b"]["mode"] == "true" and got["d"]["mode"] == "2024-02-03" and got["m"]["mean"] == 1.5
    assert frequency.duplicate_rows(df.union(df)).first()["duplicate_rows"] == 1


def test_duplicates_treat_missing_as_equal(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, None), (math.nan, "x"), (None, "x")], "a double, b string")
    assert frequency.duplicate_rows(df).first()["duplicate_rows"] == 2


def test_constant_hash_is_confirmed(spark):
    df = spark.createDataFrame([("x", None, "p"), ("x", None, "q")], "c string, e string, d string")
    flags = {c.name: c.constant for c in table_stats(df).columns}
    assert flags == {"c": True, "e": False, "d": False}


@pytest.mark.parametrize("values", [[5.0] * 10, [1.0] * 9 + [9.0], [1.0]])
def test_no_spread_no_anomaly(spark, values):
    found = {r["method"] for r in anomaly.detect_anomalies(frame(spark, values), ["id"], anomaly.METHODS, ["v"]).collect()}
    assert "iqr" not in found and "modified_zscore" not in found


def test_fence_without_spread_flags_every_other_value(spark):
    got = outliers.column_outliers(frame(spark, [1.0] * 9 + [9.0])).where("column_name = 'v'").first()
    assert (got["outliers"], got["lower_bound"], got["upper_bound"]) == (1, 1.0, 1.0)


@pytest.mark.parametrize("count,majority", [(2, 2), (3, 2), (4, 3)])
def test_consensus_majority(spark, count, majority):
    rng = random.Random(3)
    values = [rng.gauss(0, 1) for _ in range(400)] + [50.0, 3.0, -2.6]
    methods = list(anomaly.METHODS[:count])
    rows = anomaly.anomaly_consensus(frame(spark, values), ["id"], methods, ["v"]).collect()
    assert rows
    for r in rows:
        assert r["by_majority"] == (r["methods"] >= majority) and r["by_all_methods"] == (r["methods"] == count)
    assert not any(r["by_majority"] for r in anomaly.anomaly_consensus(frame(spark, values), ["id"], ["zscore"], ["v"]).collect())


def test_unknown_method_is_skipped(spark):
    with pytest.warns(UserWarning):
        got = anomaly.anomaly_summary(frame(spark, [1.0, 2.0, 30.0]), ["zscore", "magic"], ["v"]).collect()
    assert [r["method"] for r in got] == ["zscore"]


def test_mad(spark):
    values = [1.0, 2.0, 2.0, 9.0, 20.0]
    got = anomaly.statistical_summary(frame(spark, values), ["v"]).first()
    middle = statistics.median(values)
    assert got["mad"] == statistics.median([abs(v - middle) for v in values])


def expected_z(values, w):
    s = pd.Series(values, dtype=float)
    z = ((s - s.rolling(w, center=True).mean()) / s.rolling(w, center=True).std()).abs()
    return [None if math.isnan(x) or math.isinf(x) else x for x in z]


@pytest.mark.parametrize("w", [3, 4, 10])
@pytest.mark.parametrize("sizes", [{}, {"single_window_rows": 0, "block_rows": 12}])
def test_rolling_matches_pandas(spark, w, sizes):
    rng = random.Random(w)
    values = [rng.random() * 10 for _ in range(60)]
    values[25] = None
    df = frame(spark, values).repartition(4)
    got = [r["z"] for r in rolling.rolling_zscore(df, "v", ["id"], window=w, **sizes).orderBy("id").collect()]
    want = expected_z([math.nan if v is None else v for v in values], w)
    assert [g is None for g in got] == [x is None for x in want]
    assert [g for g in got if g is not None] == pytest.approx([x for x in want if x is not None])


def test_rolling_needs_two_windows(spark):
    for n, valid in ((19, 0), (20, 11)):
        df = frame(spark, [float(i * i % 7) for i in range(n)])
        for sizes in ({}, {"single_window_rows": 0, "block_rows": 10}):
            assert rolling.rolling_summary(rolling.rolling_zscore(df, "v", ["id"], **sizes)).first()["valid_rows"] == valid


def test_rolling_blocks_with_a_hot_series_and_null_keys(spark):
    rng = random.Random(5)
    rows = [(i, "hot" if i % 3 else None, rng.random()) for i in range(400)]
    df = spark.createDataFrame(rows, "id bigint, k string, v double")
    plain = rolling.rolling_zscore(df, "v", ["id"], ["k"], 5).select("id", F.round("z", 9))
    cut = rolling.rolling_zscore(df, "v", ["id"], ["k"], 5, single_window_rows=0, block_rows=17).select("id", F.round("z", 9))
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, cut.collect()))


def test_tables_without_numbers(spark):
    df = spark.createDataFrame([("a",), (None,)], "s string")
    assert outliers.column_outliers(df).count() == 0
    assert outliers.outlier_rows(df, ["s"]).count() == 0
    assert anomaly.detect_anomalies(df, ["s"]).count() == 0
    assert anomaly.anomaly_summary(df).count() == 0
    assert anomaly.statistical_summary(df).count() == 0
    assert outliers.outlier_overview(outliers.column_outliers(df), 2, 0).first()["total_outliers"] == 0
    with pytest.raises(ValueError):
        outliers.box_plot(df)


def test_no_score_without_a_finite_spread(spark):
    """One infinite value leaves no standard deviation: no z-score anywhere, quartiles still work."""
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(40)] + [(40, float("inf"))], "k int, v double")
    found = anomaly.detect_anomalies(df, ["k"], methods=("zscore", "iqr"), columns=["v"]).collect()
    assert {(r["k"], r["method"]) for r in found} == {(40, "iqr")}
    row = profile.profile_columns(df).where("column_name = 'v'").first()
    assert row["outliers_count"] == 0
    scored = rolling.rolling_zscore(df, "v", ["k"], window=5)
    assert scored.where("k >= 38 and z is not null").count() == 0 and scored.where("k = 20 and z is not null").count() == 1


def test_numbers_are_profiled_in_hash_tables(spark):
    """No aggregate over numeric columns sorts its rows."""
    df = spark.range(100).selectExpr("id", "id % 7 AS a", "cast(id % 3 AS double) AS b")
    plan = frequency.frequency_facts(df, table_stats(df, constants=False))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
