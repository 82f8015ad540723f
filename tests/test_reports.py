"""Readiness, overview, diff, lineage, replies and recommendations on small tables."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import diff, lineage, metadata, overview, profile, readiness, recommend, replies


def test_readiness_of_an_empty_table(spark):
    df = spark.createDataFrame([], "a int, b string")
    issues = readiness.readiness_issues(df)
    assert issues.count() == 0
    assert profile.quality_report(profile.profile_columns(df)).first()["overall_quality_score"] is None


def test_empty_column_gives_two_critical_issues(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, None)], "a int, b string")
    issues = readiness.readiness_issues(df)
    assert [r["severity"] for r in issues.collect()] == ["critical", "critical"]
    score = readiness.readiness_score(issues).first()
    assert (score["quality_score"], score["verdict"]) == (0, "Critical")


@pytest.mark.parametrize("severities,score", [
    ([], 100), (["medium"], 80), (["high"], 60), (["high", "high"], 20), (["medium"] * 4, 10), (["critical"], 30),
    (["high", "medium"], 40)])
def test_readiness_score(spark, severities, score):
    df = spark.createDataFrame([(s,) for s in severities], "severity string")
    assert readiness.readiness_score(df).first()["quality_score"] == score


@pytest.mark.parametrize("texts,mixed", [
    (["1", "2", "x"], True), (["1"] * 9 + ["x"], False), (["a", "b", "c"], False), (["1_0", "5d", "0x1", "inf", " 7 "], True)])
def test_mixed_types(spark, texts, mixed):
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    assert readiness.mixed_types(df).first()["is_mixed"] is mixed


def test_numeric_text_follows_python_floats(spark):
    from plumbline.functions.text import looks_numeric
    texts = ["1", "-1.5", ".5", "5.", "1e5", "1_0", "nan", "-inf", "Infinity", " 3 ", "", "5d", "0x1p3", "1__0", "_1", "e5", "+"]

    def numeric(t):
        try:
            float(t)
            return True
        except ValueError:
            return False

    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", looks_numeric(F.col("t")).alias("n"))
    assert {r["t"]: r["n"] for r in df.collect()} == {t: numeric(t) for t in texts}


def test_formats_follow_python(spark):
    from plumbline.functions.text import fixed, grouped, signed
    values = [0.125, 6.25, 2.5, 1234567.891, 0.05, 99.95]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", fixed(F.col("v"), 1).alias("f"))
    assert [r["f"] for r in df.collect()] == [f"{v:.1f}" for v in values]
    row = spark.range(1).select(grouped(F.lit(1234567)).alias("g"), signed(F.lit(-1234)).alias("s")).first()
    assert (row["g"], row["s"]) == ("1,234,567", "-1,234")


def test_column_status_order(spark):
    df = spark.createDataFrame([(None, "k", 1)] * 3 + [(None, None, 2)], "e string, c string, v int")
    got = {r["column_name"]: r["quality"] for r in overview.column_quality(df).collect()}
    assert got == {"e": "Empty", "c": "Constant", "v": "Excellent"}


def snap(spark, rows, schema, name="t"):
    return metadata.snapshot(spark.createDataFrame(rows, schema), name, "file")


@pytest.mark.parametrize("old,new,severity", [(100, 105, "medium"), (100, 115, "high"), (100, 100, None)])
def test_row_change_severity(spark, old, new, severity):
    a, b = (snap(spark, [(i,) for i in range(n)], "v int") for n in (old, new))
    rows = diff.simple_changes(a, b).collect()
    assert [r["severity"] for r in rows] == ([severity] if severity else [])
    if severity is None:
        assert diff.simple_diff(a, b).first()["recommendations"] == ["No significant changes detected"]


def test_schema_changes(spark):
    got = diff.simple_changes(snap(spark, [(1, "a")], "x int, y string"), snap(spark, [(1, 2)], "x bigint, z int"))
    assert [(r["type"], r["severity"]) for r in got.collect()] == [("schema", "high"), ("schema", "high"), ("schema", "medium")]


def test_null_change_severity(spark):
    for extra, severity in ((50, "medium"), (500, "high")):
        a = snap(spark, [(1,)] * 600, "v int")
        b = snap(spark, [(1,)] * (600 - extra) + [(None,)] * extra, "v int")
        assert diff.simple_changes(a, b).first()["severity"] == severity


def test_equal_snapshots_have_no_extended_changes(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "x int, y string")
    a = metadata.extended_snapshot(df, "t", "file")
    b = metadata.extended_snapshot(df.repartition(3).orderBy(F.desc("x")), "t", "file")
    assert diff.extended_changes(a, b).count() == 0
    assert diff.change_score(diff.extended_changes(a, b)).first()["change_score"] == 0.0
    assert diff.change_advice(diff.extended_changes(a, b)).first()["advice"].startswith("No significant")


def test_content_hash_sees_moved_nulls(spark):
    a = spark.createDataFrame([(None, "x")], "p string, q string")
    b = spark.createDataFrame([("x", None)], "p string, q string")
    assert metadata.content_hash(a).first() != metadata.content_hash(b).first()
    twice = metadata.content_hash(a.union(a).union(a).union(a)).first()
    assert twice != metadata.content_hash(b.union(b).union(b).union(b)).first()


def sources(spark, text, **options):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(lineage.source_tables(F.col("t"), "DB", "S", "T", **options)).first()[0]


@pytest.mark.parametrize("text,first,every", [
    ("insert into t select * from a.b.c where x", ["A.B.C"], ["A.B.C"]),
    ("select * from items, other", ["DB.S.ITEMS"], ["DB.S.ITEMS", "DB.S.OTHER"]),
    ('create table t as select * from "My".raw.Tab;', ["MY.RAW.TAB"], ["MY.RAW.TAB"]),
    ("select * from (select distinct k from deltas) d", ["DB.S.DELTAS"], ["DB.S.DELTAS"]),
    ("select * from (select x1, y11 from deltas, (select zzz from more)) d", ["DB.S.Y11", "DB.S.DELTAS", "DB.S.MORE"], ["DB.S.DELTAS", "DB.S.MORE"]),
    ("select * from t where a in (select b from src)", ["DB.S.SRC"], ["DB.S.SRC"]),
    ("select * from db.s.t", [], []),
    ("select * from a1 join b2 on x", [], []),
    ("select * from orders", [], ["DB.S.ORDERS"]),
    ("select * from aaa left join bbb using (k), ccc", ["DB.S.AAA"], ["DB.S.AAA", "DB.S.BBB"]),
    ("select 1", [], []),
    (None, None, None),
    ("select extract(year from order_ts) from aaa", ["DB.S.AAA"], ["DB.S.AAA"]),
    ("select a -- copied from backup\nfrom live /* from \n older */", ["DB.S.BACKUP", "DB.S.LIVE", "DB.S.OLDER"], ["DB.S.LIVE"]),
    ("select 'it''s from here', 'a\\' from there' from aaa", ["DB.S.HERE", "DB.S.THERE", "DB.S.AAA"], ["DB.S.AAA"]),
    ("with cte as (select * from base1), two (k) as (select k from cte) select * from two, cte join far on 1",
     ["DB.S.BASE1", "DB.S.CTE", "DB.S.TWO"], ["DB.S.BASE1", "DB.S.FAR"]),
    ("with own as (select * from own) select * from own", ["DB.S.OWN"], ["DB.S.OWN"]),
    ("with recursive own as (select 1 from roots union all select 1 from own) select * from own", ["DB.S.ROOTS", "DB.S.OWN"], ["DB.S.ROOTS"]),
    ("select * from flat(xxx), lateral (select * from inn) i, aaa where a is distinct from bbb",
     ["DB.S.FLAT", "DB.S.INN", "DB.S.BBB"], ["DB.S.INN", "DB.S.AAA"]),
    ("select * from ((aaa join bbb on 1) join ccc on 1), ddd", ["DB.S.AAA"], ["DB.S.AAA", "DB.S.BBB", "DB.S.CCC", "DB.S.DDD"]),
    ('select * from "My" . "ta(b" x', [], ["MY.TA(B"]),
    ("select * from aaa )) from 'open", ["DB.S.AAA", "DB.S.OPEN"], ["DB.S.AAA"]),
])
def test_source_tables(spark, text, first, every):
    assert sources(spark, text, first_only=True) == first
    assert sources(spark, text) == every


def test_long_histories_are_not_paired(spark):
    log = spark.range(lineage.PAIR_ROWS + 1).select(
        F.col("id").cast("string").alias("QUERY_ID"), F.lit("INSERT").alias("QUERY_TYPE"), F.lit("from aaa").alias("QUERY_TEXT"),
        F.lit("2024-01-01").alias("QUERY_START_TIME"))
    for form in ({"all_pairs": True}, {"numbered": True}):
        with pytest.raises(ValueError, match="limit the history"):
            lineage.source_edges(log, "D", "S", "T", **form)


def test_replies(spark):
    texts = ["", "no braces", "{bad", '{"recommendations": [{"category": "c", "action_items": ["a"]}]}',
             '{"summary": "s"}', "pre {\"recommendations\": []} post"]
    df = spark.createDataFrame(list(enumerate(texts)), "reply_id bigint, text string")
    got = {r["reply_id"]: r for r in replies.parse_replies(df).collect()}
    assert [got[i]["parsed"] for i in range(6)] == [False, False, False, True, True, True]
    assert got[1]["description"] == "Raw AI response: no braces..."
    assert [got[i]["raw_text"] for i in range(6)] == ["", "no braces", "{bad", None, None, None]
    long = replies.parse_replies(spark.createDataFrame([(1, "word " * 5000)], "reply_id bigint, text string")).first()
    assert long["raw_text"] == "word " * 5000 and len(long["description"]) < 250
    assert (got[3]["type"], got[3]["suggested_actions"], got[3]["priority"]) == ("c", ["a"], "medium")
    assert got[4]["summary"] == "s" and got[4]["item"] is None


@pytest.mark.parametrize("text,priority,action", [
    ("**High Priority:** Fill it", "High", "Fill it"), ("Low: Rename: now", "Low", "Rename: now"),
    ("Urgent: Go", "Medium", "Go"), ("Just do it", "Medium", "Just do it")])
def test_action_priority(spark, text, priority, action):
    level, told = replies.action_priority(F.col("t"))
    assert tuple(spark.createDataFrame([(text,)], "t string").select(level, told).first()) == (priority, action)


def test_recommendations_for_a_bad_table(spark):
    df = spark.createDataFrame([(None, "x ")] * 200 + [(1.0, "X ")], "a double, b string")
    got = recommend.recommendations(profile.profile_columns(df)).collect()
    assert [r["category"] for r in got] == ["data_validation", "data_monitoring"]
    assert got[0]["affected_columns"] == ["a"] and len(got[1]["action_items"]) == 4


def test_snapshot_from_schema_compares_with_a_read_one(spark):
    df = spark.createDataFrame([(1, "a", True)], "x int, y string, b boolean")
    bare = metadata.snapshot_from_schema(spark, df.schema, "t", "snowflake", row_count=1)
    assert bare.first()["numeric_columns"] == ["x", "b"]
    assert bare.schema == metadata.snapshot(df, "t", "file").schema
    assert diff.simple_changes(bare, metadata.snapshot(df, "t", "file")).count() == 0


def test_numbered_nodes_and_all_pairs(spark):
    rows = [("q1", "INSERT", "insert into t select * from aaa", "2024-01-01"), ("q2", "MERGE", "merge from bbb", "2024-01-02"),
            ("q3", "UPDATE", "update t", "2024-01-03")]
    log = spark.createDataFrame(rows, "QUERY_ID string, QUERY_TYPE string, QUERY_TEXT string, QUERY_START_TIME string")
    read = {tuple(r)[:2] for r in lineage.source_edges(log, "D", "S", "T", numbered=True).collect()}
    every = {tuple(r)[:2] for r in lineage.source_edges(log, "D", "S", "T", numbered=True, all_pairs=True).collect()}
    assert read == {("D.S.AAA", "INSERT_3"), ("D.S.BBB", "MERGE_2")}
    assert every == {(s, n) for s in ("D.S.AAA", "D.S.BBB") for n in ("INSERT_3", "MERGE_2")}
