"""File sources: CSV, Parquet, JSON, and listings of what a folder holds."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from plumbline.functions.sizing import settle

# Offered encodings as Spark charset names, delimiters, data-file extensions.
# Spark has no windows-1252: it is read as ISO-8859-1 and the characters that differ are mapped.
ENCODINGS = {"utf-8": "UTF-8", "latin-1": "ISO-8859-1", "cp1252": "ISO-8859-1", "utf-16": "UTF-16"}
DELIMITERS = {"comma": ",", "semicolon": ";", "tab": "\t", "pipe": "|"}
FORMATS = {"csv": "csv", "parquet": "parquet", "pq": "parquet", "json": "json", "xlsx": "excel"}
DATA_FILE = r"(?i)\.(csv|parquet|pq|json|xlsx)$"
UNREADABLE = ("xls",)
FILE_CHOICE = ("recursiveFileLookup", "pathGlobFilter", "modifiedBefore", "modifiedAfter")  # options on which files are read
# what Spark's errors about the file itself hold
UNREADABLE_SIGNS = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "FAILED_READ_FILE", "MALFORMED_RECORD", "MALFORMED_CSV")


def charset_of(encoding: str) -> str:
    return "ISO-8859-1" if encoding.lower() == "windows-1252" else ENCODINGS.get(encoding.lower(), encoding)


def _cp1252_pairs() -> tuple[str, str]:
    """The control characters of ISO-8859-1 and what windows-1252 has in their place."""
    both = [(chr(b), bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)]
    return "".join(c for c, w in both if w), "".join(w for _, w in both if w)


def map_cp1252(df: DataFrame, writing: bool = False) -> DataFrame:
    """Text columns (and, when reading, names) between ISO-8859-1 controls and windows-1252."""
    control, windows = _cp1252_pairs()
    old, new = (windows, control) if writing else (control, windows)
    table = str.maketrans(old, new)
    return df.select(*[
        (F.translate(F.col(f"`{f.name}`"), old, new) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`"))
        .alias(f.name.translate(table)) for f in df.schema.fields])


def read_csv(spark: SparkSession, path: str | list[str], encoding: str = "utf-8", delimiter: str = ",",
             schema: T.StructType | str | None = None, limit: int | None = None, strict: bool = False,
             multi_line: bool = False, types: bool = True) -> DataFrame:
    """CSV with a header row.  Give a schema on big inputs; without one a pass infers it (``types=False``: all text).

    Big files are split.  ``multi_line`` allows line breaks in quoted fields and keeps a file in one
    task.  Records that do not fit are null-filled unless ``strict``; ``broken_records`` returns them.
    """
    charset = charset_of(encoding)
    multi_line = multi_line or charset.upper().startswith(("UTF-16", "UTF-32"))  # Spark cannot split these
    reader = (spark.read.option("header", True).option("sep", delimiter).option("encoding", charset)
              .option("multiLine", multi_line).option("escape", '"')
              .option("mode", "FAILFAST" if strict else "PERMISSIVE"))
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", types)
    df = reader.csv(path)
    if encoding.lower() in ("cp1252", "windows-1252"):
        df = map_cp1252(df)
    return df if limit is None else df.limit(limit)


def probe_csv(spark: SparkSession, path: str, rows: int = 5, delimiter: str = ",", encoding: str = "utf-8") -> bool:
    """Whether the first rows can be read as text under the header; no types are inferred.

    A file that cannot be read, or whose rows do not fit its header, is not; other errors are raised.
    """
    try:
        head = read_csv(spark, path, encoding, delimiter, strict=True, types=False)
        return bool(head.columns) and head.take(rows) is not None
    except Exception as problem:
        if any(sign in str(problem) for sign in UNREADABLE_SIGNS):
            return False
        raise


def broken_records(spark: SparkSession, path: str | list[str], schema: str, encoding: str = "utf-8", delimiter: str = ",",
                   multi_line: bool = False) -> DataFrame:
    """Records that do not fit the schema, as they stand in the file: one column, ``record``.

    They are written to the shared folder, since Spark cannot read them alone.
    """
    reader = (spark.read.option("header", True).option("sep", delimiter).option("encoding", charset_of(encoding))
              .option("multiLine", multi_line).option("escape", '"').option("columnNameOfCorruptRecord", "record"))
    return settle(reader.schema(f"{schema}, record string").csv(path).where("record IS NOT NULL")).select("record")


def read_csv_files(spark: SparkSession, paths: list[str], **options) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Each file as its own dataset: (name -> DataFrame, name -> failure)."""
    loaded, failed = {}, {}
    for path in paths:
        name = re.sub(r"\.[^.]*$", "", path.rstrip("/").rsplit("/", 1)[-1])
        try:
            loaded[name] = read_csv(spark, path, **options)
        except Exception as problem:
            failed[name] = str(problem).splitlines()[0]
    return loaded, failed


def csv_ledger(spark: SparkSession, path: str | list[str], schema: str, encoding: str = "utf-8", delimiter: str = ",",
               multi_line: bool = False, **options) -> DataFrame:
    """What one scan over CSV files found, a row per file: path, size_bytes, good_rows, bad_rows, rows_digest.

    A bad row does not fit the schema (a field too few or too many, a value of another type).  Files are
    pre-aggregated where they are read, so many files cost no job each; one with a header alone is listed with
    none, one without a byte is not listed.
    ``rows_digest`` does not depend on the order of the rows.  A reader that fails on a whole file, such as
    a broken archive, fails the scan.
    """
    reader = (spark.read.options(**{"recursiveFileLookup": True, **options}).option("header", True).option("sep", delimiter)
              .option("encoding", charset_of(encoding)).option("multiLine", multi_line).option("escape", '"')
              .option("columnNameOfCorruptRecord", "__record"))
    rows = reader.schema(f"{schema}, __record string").csv(path)
    whole = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])  # reads all fields: Spark sees a bad row only in those it parses
    # written, a row a file, so that no later selection makes the scan parse fewer fields
    found = settle(rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.count_if(F.col("__record").isNull()).alias("good_rows"), F.count_if(F.col("__record").isNotNull()).alias("bad_rows"),
        F.bit_xor(whole).alias("rows_digest")))
    chosen = {k: v for k, v in {"recursiveFileLookup": True, **options}.items() if k in FILE_CHOICE}
    listed = spark.read.format("binaryFile").options(**chosen).load(path).select("path", F.col("length").alias("size_bytes"))
    plain = F.regexp_replace(F.url_decode(F.regexp_replace("file", r"\+", "%2B")), r"^[a-z]+:/*", "/")
    return listed.join(found.withColumn("plain", plain), F.regexp_replace("path", r"^[a-z]+:/*", "/") == F.col("plain"), "left").select(
        "path", "size_bytes", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good_rows", "bad_rows")], "rows_digest")


def source_info(df: DataFrame, source_type: str, path: str) -> DataFrame:
    """One row: source_type, file_path, row_count, column_count, columns."""
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(source_type).alias("source_type"), F.lit(path).alias("file_path"), "row_count",
        F.lit(len(df.columns)).cast("bigint").alias("column_count"),
        F.array(*[F.lit(c) for c in df.columns]).cast("array<string>").alias("columns"))


def json_kinds(spark: SparkSession, path: str | list[str], **options) -> dict[bool, list[str]]:
    """The JSON files of a path by kind: True for those that hold one array over several lines, False for lines.

    The first two lines that are not blank tell, file by file; one pass over the text finds them.
    """
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    lines = spark.read.options(**{k: v for k, v in options.items() if k in FILE_CHOICE}).text(path).select(
        F.col("_metadata.file_path").alias("file"), at.alias("at"), F.trim(F.regexp_replace("value", r"^[\s\uFEFF]+|\s+$", "")).alias("v")).where("v != ''")
    ends = lines.select("file", F.struct("at", F.substring("v", 1, 1).alias("head"), F.right("v", F.lit(1)).alias("tail")).alias("line"))
    first = ends.groupBy("file").agg(F.min("line").alias("one"))
    two = ends.join(first, "file").groupBy("file", "one").agg(F.min(F.when(F.col("line.at") > F.col("one.at"), F.col("line"))).alias("two"))
    each_line = (F.col("one.tail") == "]") & F.coalesce(F.col("two.head").isin("[", "{"), F.lit(True))
    kinds: dict[bool, list[str]] = {}
    for r in two.select("file", ((F.col("one.head") == "[") & ~each_line).alias("array")).collect():
        kinds.setdefault(r["array"], []).append(re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(r["file"])))
    return kinds


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that holds values of both, as when they are inferred together: text where they do not agree."""
    if a == b:
        return a
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        others = {f.name: f.dataType for f in b.fields}
        own = {f.name for f in a.fields}
        return T.StructType([T.StructField(f.name, common_type(f.dataType, others[f.name]) if f.name in others else f.dataType) for f in a.fields]
                            + [T.StructField(f.name, f.dataType) for f in b.fields if f.name not in own])
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(common_type(a.elementType, b.elementType))
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        return T.DoubleType()
    return T.StringType()


def read_json(spark: SparkSession, path: str | list[str], array: bool | None = None,
              schema: T.StructType | str | None = None, **options) -> DataFrame:
    """JSON lines, or files that hold one array (or one object over several lines) each.

    Without ``array`` the first lines of every file decide for that file: ``[`` begins an array, unless
    the line ends it and others of the kind follow, which are lines.  Files of both kinds are read apart
    under one schema.  Lines split over tasks; an array keeps its file in one.  What cannot be parsed
    fails (``mode`` changes that), so no record is lost without a word.
    """
    def reader(array: bool, schema: T.StructType | str | None, **more):
        found = spark.read.options(**{"mode": "FAILFAST", **options, **more}).option("multiLine", array)
        return found if schema is None else found.schema(schema)

    kinds = {array: []} if array is not None else json_kinds(spark, path, **options)
    if len(kinds) < 2:
        return reader(True in kinds, schema).json(path)
    # a folder stays the root of its partition columns
    base = {"basePath": path} if isinstance(path, str) and not re.search(r"[*?\[{]", path) else {}
    if schema is None:
        schema = common_type(*[reader(kind, None, **base).json(kinds[kind]).schema for kind in (False, True)])
    lines, arrays = (reader(kind, schema, **base).json(kinds[kind]) for kind in (False, True))
    return lines.unionByName(arrays, allowMissingColumns=True)


def read_file(spark: SparkSession, path: str, limit: int | None = None, **options) -> DataFrame:
    """Read by extension; options go to the reader.  Unknown extensions are taken as CSV, ``.xls`` is refused."""
    extension = path.lower().rstrip("/").rsplit(".", 1)[-1]
    if extension in UNREADABLE:
        raise ValueError(f".{extension} files cannot be read: {path}")
    kind = FORMATS.get(extension, "csv")
    if kind == "parquet":
        df = spark.read.options(**options).parquet(path)
    elif kind == "json":
        df = read_json(spark, path, **options)
    elif kind == "excel":
        from plumbline.sources.excel import read_sheet
        df = read_sheet(spark, path, **options)
    else:
        df = read_csv(spark, path, **options)
    return df if limit is None else df.limit(limit)


def list_files(spark: SparkSession, path: str, depth: int | None = None, data_only: bool = False) -> DataFrame:
    """Files below a folder: path, size_bytes, size_mb, modification_time, extension.

    Contents are not read.  ``depth`` counts folder levels below ``path``.
    """
    root = re.sub(r"^[a-z]+:/*", "/", path).rstrip("/")
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
             .select("path", "modificationTime", "length"))
    plain = F.regexp_replace("path", r"^[a-z]+:/*", "/")
    below = F.size(F.split(F.substr(plain, F.lit(len(root) + 2)), "/")) - 1
    if depth is not None:
        files = files.where(below <= depth)
    if data_only:
        files = files.where(F.col("path").rlike(DATA_FILE))
    return files.select(
        "path", F.col("length").alias("size_bytes"), F.round(F.col("length") / 1048576, 2).alias("size_mb"),
        F.col("modificationTime").alias("modification_time"),
        F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("extension"))


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def list_directories(files: DataFrame, root: str) -> DataFrame:
    """Folders from ``root`` down that hold a listed file at any depth, also those that hold only folders.

    ``directory`` is the path below the root (empty for the root).  Folders are known by their files:
    one without a file anywhere below it is not listed.
    """
    plain = F.regexp_replace("path", r"^[a-z]+:/*", "/")
    below = F.substr(parent(plain), F.lit(len(re.sub(r"^[a-z]+:/*", "/", root).rstrip("/")) + 2))
    names = F.filter(F.split(below, "/"), lambda n: n != "")
    return files.select(F.explode(F.transform(F.sequence(F.lit(0), F.size(names)), lambda n: F.array_join(
        F.slice(names, 1, n), "/"))).alias("directory")).distinct()
