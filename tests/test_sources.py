"""Readers, writers, the registry, and stream monitors."""

import zipfile

import pytest
from pyspark.sql import functions as F

from plumbline.functions.sizing import settle, shared_folder
from plumbline.operators import anomaly, metadata
from plumbline.sources import databases, excel, factory, files, registry, sinks
from plumbline.streaming import monitor

PARTS = {
    "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" '
    'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>'
    '<sheet name="First" sheetId="1" r:id="rId1"/><sheet name="Second" sheetId="2" r:id="rId2"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    '<Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/sheet2.xml"/></Relationships>',
    "xl/sharedStrings.xml": '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
    "<si><t>id</t></si><si><t>name</t></si><si><r><t>Ann</t></r><r><t>a</t></r></si></sst>",
    "xl/worksheets/sheet1.xml": '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
    '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row>'
    '<row r="2"><c r="A2"><v>1</v></c><c r="B2" t="s"><v>2</v></c></row>'
    '<row r="3"><c r="B3" t="inlineStr"><is><t>Bob</t></is></c></row></sheetData></worksheet>',
    "xl/worksheets/sheet2.xml": '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
    '<row r="1"><c r="A1" t="inlineStr"><is><t>v</t></is></c></row><row r="2"><c r="A2"><v>2.5</v></c></row></sheetData></worksheet>',
}


@pytest.fixture()
def books(tmp_path):
    for name in ("one.xlsx", "two.xlsx"):
        with zipfile.ZipFile(tmp_path / name, "w") as book:
            for part, text in PARTS.items():
                book.writestr(part, text)
    return str(tmp_path)


def test_excel(spark, books):
    assert {(r["sheet"], r["rows"]) for r in excel.list_sheets(spark, books).collect()} == {("First", 2), ("Second", 1)}
    one = excel.read_sheet(spark, f"{books}/one.xlsx", schema={"id": "int"})
    assert one.dtypes == [("id", "int"), ("name", "string")]
    assert sorted(map(tuple, one.collect()), key=str) == [(1, "Anna"), (None, "Bob")]
    both = factory.read_source(spark, "excel", path=books, sheet="Second", schema={"v": "double"})
    assert [r["v"] for r in both.collect()] == [2.5, 2.5]
    with pytest.raises(ValueError):
        excel.read_sheet(spark, books, sheet="Third")


@pytest.mark.parametrize("encoding", list(files.ENCODINGS))
@pytest.mark.parametrize("delimiter", list(files.DELIMITERS.values()))
def test_csv_encodings(spark, tmp_path, encoding, delimiter):
    texts = ["é,;|\t\"q\"", "two\nlines", "plain"] + (["€ “quoted” Ÿ"] if encoding != "latin-1" else [])
    lines = [delimiter.join(("id", "näme"))] + [
        delimiter.join((str(i), '"' + t.replace('"', '""') + '"')) for i, t in enumerate(texts)]
    path = tmp_path / "f.csv"
    path.write_bytes("\n".join(lines).encode(encoding))
    df = files.read_csv(spark, str(path), encoding=encoding, delimiter=delimiter, multi_line=True)
    assert df.columns == ["id", "näme"]
    assert [r["näme"] for r in df.orderBy("id").collect()] == texts
    sinks.write_csv(df, str(tmp_path / "out"), encoding=encoding, delimiter=delimiter)
    back = files.read_csv(spark, str(tmp_path / "out"), encoding=encoding, delimiter=delimiter, multi_line=True)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_csv_probe_and_failures(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    assert files.probe_csv(spark, str(tmp_path / "a.csv"))
    assert not files.probe_csv(spark, str(tmp_path / "none.csv"))
    loaded, failed = files.read_csv_files(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert list(loaded) == ["a"] and list(failed) == ["b"]


def test_listing_depth_and_kinds(spark, tmp_path):
    for name in ("a.csv", "b.txt", "d/c.parquet", "d/e/f.XLSX"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x" * 10)

    def names(**options):
        return sorted(r["path"].rsplit("/", 1)[1] for r in files.list_files(spark, str(tmp_path), **options).collect())

    assert names() == ["a.csv", "b.txt", "c.parquet", "f.XLSX"]
    assert names(data_only=True) == ["a.csv", "c.parquet", "f.XLSX"]
    assert names(depth=0) == ["a.csv", "b.txt"] and names(depth=1) == ["a.csv", "b.txt", "c.parquet"]
    row = files.list_files(spark, str(tmp_path), depth=0).first()
    assert (row["size_bytes"], row["size_mb"]) == (10, 0.0)
    found = files.list_directories(files.list_files(spark, str(tmp_path)), str(tmp_path)).collect()
    assert sorted(r["directory"] for r in found) == ["", "d", "d/e"]
    (tmp_path / "x" / "y" / "z").mkdir(parents=True)
    (tmp_path / "x" / "y" / "z" / "g.csv").write_text("a")
    found = files.list_directories(files.list_files(spark, str(tmp_path)), str(tmp_path)).collect()
    assert sorted(r["directory"] for r in found) == ["", "d", "d/e", "x", "x/y", "x/y/z"]


def test_json_of_both_kinds_is_read_whole(spark, tmp_path):
    """One array per line, and a folder of arrays and of lines: every record arrives."""
    (tmp_path / "each.json").write_text('[{"id": 1}, {"id": 2}]\n\n[{"id": 3}]\n[{"id": 4}]\n')
    assert sorted(r["id"] for r in files.read_file(spark, str(tmp_path / "each.json")).collect()) == [1, 2, 3, 4]
    folder = tmp_path / "both kinds.json"
    folder.mkdir()
    (folder / "a rows.json").write_text('[\n {"id": 1, "x": 1},\n {"id": 2, "x": 2}\n]\n')
    (folder / "b.json").write_text("".join(f'{{"id": {i}, "x": {i}.5, "y": "t"}}\n' for i in range(10, 60)))
    (folder / "c.json").write_text('[{"id": 3, "x": 3}]\n[{"id": 4, "x": 4}]\n')
    wanted = [1, 2, 3, 4, *range(10, 60)]
    paths = [str(folder / n) for n in ("a rows.json", "b.json", "c.json")]
    for got in (files.read_json(spark, paths), files.read_file(spark, str(folder)),
                files.read_json(spark, paths, schema="id long, x double")):
        assert sorted(r["id"] for r in got.collect()) == wanted and dict(got.dtypes)["x"] == "double"


def test_json_lines_arrays_and_refused_files(spark, tmp_path):
    spark.range(100).repartition(2).write.json(str(tmp_path / "lines.json"))
    assert files.read_file(spark, str(tmp_path / "lines.json")).count() == 100
    (tmp_path / "array.json").write_text('\n [{"id": 1},\n {"id": 2}]')
    assert files.read_file(spark, str(tmp_path / "array.json")).count() == 2
    (tmp_path / "bad.json").write_text('{"id": 1}\n{"id": \n')
    with pytest.raises(Exception, match="MALFORMED"):
        files.read_file(spark, str(tmp_path / "bad.json"), schema="id long").collect()
    with pytest.raises(ValueError, match="xls"):
        files.read_file(spark, str(tmp_path / "a.xls"))
    spark.range(3).write.parquet(str(tmp_path / "p.parquet"))
    assert files.read_file(spark, str(tmp_path / "p.parquet"), mergeSchema="true").count() == 3


def test_broken_csv_records(spark, tmp_path):
    (tmp_path / "b.csv").write_text("x,y\n1,a\n2,b,c\n3\nz,d\n")
    got = sorted(r["record"] for r in files.broken_records(spark, str(tmp_path / "b.csv"), "x long, y string").collect())
    assert got == ["2,b,c", "3", "z,d"]
    assert not files.probe_csv(spark, str(tmp_path / "b.csv"))
    (tmp_path / "empty.csv").write_text("")
    assert not files.probe_csv(spark, str(tmp_path / "empty.csv"))


def test_database_options():
    full = dict(account="acc", username="u", password="p", warehouse="w", database="d")
    assert databases.snowflake_options(**full)["sfSchema"] == "PUBLIC"
    with pytest.raises(ValueError, match="warehouse"):
        databases.snowflake_options(**{**full, "warehouse": ""})
    oracle = databases.oracle_options(username="u", password="p", dsn="host/db", wallet="/w")
    assert oracle["url"] == "jdbc:oracle:thin:@host/db?TNS_ADMIN=/w"
    with pytest.raises(ValueError, match="dsn"):
        databases.oracle_options(username="u", password="p")
    assert databases.split_options("id", 0, 9, 3)["numPartitions"] == "3"
    assert "''" in databases.snowflake_tables_query("a'b")
    assert "ORDER BY column_id" in databases.oracle_columns_query("t")


def test_factory_checks(spark):
    assert factory.supported_types() == ["csv", "excel", "snowflake", "oracle", "hdfs"]
    with pytest.raises(ValueError, match="path"):
        factory.read_source(spark, "csv")
    with pytest.raises(ValueError, match="unsupported"):
        factory.read_source(spark, "ftp")
    with pytest.raises(ValueError, match="either"):
        databases.read_database(spark, "jdbc", {}, table="t", query="q")


def test_registry(spark):
    reg = registry.Registry(spark)
    reg.register("things", spark.range(5), "csv", file_name="things.csv")
    assert reg.names() == ["things"] and reg.get("things").count() == 5
    reg.replace("things", spark.range(7))
    assert reg.query("SELECT * FROM things", limit=6).count() == 6
    assert reg.describe().first()["file_name"] == "things.csv"
    assert reg.totals().first()["total_rows"] == 7
    with pytest.raises(KeyError):
        reg.get("nothing")


def test_settle_keeps_rows(spark):
    df = spark.range(100).withColumn("p", F.spark_partition_id())
    kept = settle(df)
    assert kept.count() == 100 and kept.dtypes == df.dtypes
    assert shared_folder(spark).startswith(spark.conf.get("spark.checkpoint.dir"))


def test_stream_drops_late_rows_and_flags(spark, tmp_path):
    def batch(name, rows):
        spark.createDataFrame(rows, "ts string, v double").selectExpr("CAST(ts AS TIMESTAMP) AS ts", "v").coalesce(1).write.parquet(
            str(tmp_path / "in" / name))

    batch("a", [("2024-01-01 00:10:00", 1.0), ("2024-01-01 00:20:00", None), ("2024-01-01 05:00:00", 2.0)])
    read = lambda: spark.readStream.schema("ts timestamp, v double").option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    run = lambda df, name: monitor.run_to_files(df, str(tmp_path / name), str(tmp_path / f"{name}-state")).awaitTermination()
    run(monitor.window_metrics(read(), "ts", "v"), "out")
    batch("b", [("2024-01-01 00:30:00", 9.0), ("2024-01-01 09:00:00", 3.0)])
    run(monitor.window_metrics(read(), "ts", "v"), "out")
    got = {str(r["window_start"]): (r["rows"], r["completeness"], r["mean"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"2024-01-01 00:00:00": (2, 50.0, 1.0), "2024-01-01 05:00:00": (1, 100.0, 2.0)}
    base = spark.createDataFrame([(float(i),) for i in range(20)], "v double")
    spreads = anomaly.spreads(base, ["v"], ("zscore", "iqr"))
    run(monitor.flag_outside(read().withColumn("v", F.col("v") * 100), spreads), "flags")
    assert sorted(r["v"] for r in spark.read.parquet(str(tmp_path / "flags")).collect()) == [100.0, 200.0, 300.0, 900.0]


def test_csv_ledger(spark, tmp_path):
    """Rows that fit and rows that do not, file by file, with one of a header alone; a file without a byte is not listed."""
    texts = {"a.csv": "x,y\n1,a\n2,b\n", "b c+d.csv": "x,y\n1\nno,b\n3,c,d\n4,e\n", "empty.csv": "", "head.csv": "x,y\n", "sub/a.csv": "x,y\n2,b\n1,a\n"}
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    rows = {r["path"].split(str(tmp_path) + "/")[1]: r for r in files.csv_ledger(spark, str(tmp_path), "x int, y string").collect()}
    assert {k: (r["good_rows"], r["bad_rows"], r["size_bytes"]) for k, r in rows.items()} == {
        "a.csv": (2, 0, 12), "b c+d.csv": (1, 3, 21), "head.csv": (0, 0, 4), "sub/a.csv": (2, 0, 12)}
    assert rows["a.csv"]["rows_digest"] == rows["sub/a.csv"]["rows_digest"] is not None and rows["head.csv"]["rows_digest"] is None


def test_facts_from_footers(spark, tmp_path):
    """Counts and extremes without reading a column: the plan scans only footers, and the settings stay as they were."""
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, None, "a", [1], True), (5, 2.5, None, None, False), (None, -1.0, "b", [2], True)],
                          "k int, v double, s string, l array<int>, b boolean").coalesce(1).write.parquet(path)
    before = spark.conf.get("spark.sql.sources.useV1SourceList")
    rows = {r["name"]: r for r in metadata.column_facts_from_files(spark, path).collect()}
    told = {k: (r["row_count"], r["non_null_count"], r["null_count"], r["min_value"], r["max_value"]) for k, r in rows.items()}
    assert told == {"k": (3, 2, 1, "1", "5"), "v": (3, 2, 1, "-1.0", "2.5"), "s": (3, 2, 1, None, None),
                    "l": (3, None, None, None, None), "b": (3, 3, 0, "false", "true")}
    snap = metadata.snapshot_from_files(spark, path, "t").first()
    assert (snap["row_count"], snap["column_count"], snap["total_null_count"]) == (3, 5, 3)
    with metadata._from_footers(spark):
        plan = metadata.footer_query(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*)" in plan and "ReadSchema: struct<count(*)" in plan.replace("COUNT", "count")
    assert spark.conf.get("spark.sql.sources.useV1SourceList") == before
    # a file without a value of a column has no extremes for it; columns behind a nested one of several leaves are not told
    part = spark.createDataFrame([(None, 1.5, "a", (1, 2), True)], "k int, v double, s string, l struct<a: int, b: int>, b boolean")
    part.union(part.selectExpr("7", "v", "s", "l", "b")).repartition(2, "k").write.option("maxRecordsPerFile", 1).parquet(str(tmp_path / "u"))
    told = {r["name"]: (r["row_count"], r["null_count"], r["min_value"], r["max_value"]) for r in metadata.column_facts_from_files(
        spark, str(tmp_path / "u")).collect()}
    assert told == {"k": (2, 1, None, None), "v": (2, 0, "1.5", "1.5"), "s": (2, 0, None, None), "l": (2, None, None, None), "b": (2, None, None, None)}
