"""Excel workbooks (.xlsx) from a folder, one task per workbook.

A workbook is a zip of XML parts, read with the standard library inside the tasks.  Rows
come back as arrays of text and take their types from casts.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

ROWS_PER_BATCH = 10_000
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(sheet name, part name) in workbook order."""
    rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    return [(s.get("name"), "xl/" + rels[s.get(_REL)].removeprefix("/xl/"))
            for s in root.iter(f"{_MAIN}sheet")]


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
    return ["".join(t.text or "" for t in item.iter(f"{_MAIN}t")) for item in root.iter(f"{_MAIN}si")]


def _column(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref).group():
        n = n * 26 + ord(ch) - 64
    return n - 1


def _rows(book: zipfile.ZipFile, part: str, shared: list[str]) -> Iterator[list[str | None]]:
    with book.open(part) as stream:
        for _, row in ElementTree.iterparse(stream):
            if row.tag != f"{_MAIN}row":
                continue
            cells: list[str | None] = []
            for at, cell in enumerate(row.iter(f"{_MAIN}c")):
                index = _column(cell.get("r")) if cell.get("r") else at
                cells += [None] * (index + 1 - len(cells))
                value = cell.find(f"{_MAIN}v")
                if cell.get("t") == "inlineStr":
                    cells[index] = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
                elif value is not None:
                    cells[index] = shared[int(value.text)] if cell.get("t") == "s" else value.text
            yield cells
            row.clear()


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            with zipfile.ZipFile(io.BytesIO(content)) as book:
                shared = _shared(book)
                for order, (sheet, part) in enumerate(_sheets(book)):
                    held: list[tuple] = []
                    for number, cells in enumerate(_rows(book, part, shared)):
                        held.append((path, order, sheet, number, cells))
                        if len(held) == ROWS_PER_BATCH:
                            yield pd.DataFrame(held, columns=["path", "sheet_order", "sheet", "row", "cells"])
                            held = []
                    if held:
                        yield pd.DataFrame(held, columns=["path", "sheet_order", "sheet", "row", "cells"])


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """Every row of every sheet: path, sheet_order, sheet, row (0 is the header), cells."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("pathGlobFilter", "*.xlsx").load(path).select("path", "content"))
    return files.mapInPandas(_read, "path string, sheet_order int, sheet string, row bigint, cells array<string>")


def list_sheets(spark: SparkSession, path: str) -> DataFrame:
    """path, sheet_order, sheet of the workbooks below a folder, with their data rows."""
    return read_workbooks(spark, path).groupBy("path", "sheet_order", "sheet").agg(
        F.count_if(F.col("row") > 0).alias("rows"))


def read_sheet(spark: SparkSession, path: str, sheet: str | None = None, limit: int | None = None,
               schema: dict[str, str] | None = None) -> DataFrame:
    """One sheet (the first by default) of a workbook or of a folder of like workbooks.

    The header row names the columns; ``schema`` casts them, absent columns stay text.
    """
    rows = read_workbooks(spark, path)
    rows = rows.where(F.col("sheet") == sheet) if sheet is not None else rows.where(F.col("sheet_order") == 0)
    head = rows.where(F.col("row") == 0).select("cells").first()
    if head is None:
        raise ValueError(f"no sheet {sheet or 'at position 0'} in {path}")
    names = [n if n else f"column_{i + 1}" for i, n in enumerate(head["cells"])]
    kinds = schema or {}
    body = rows.where(F.col("row") > 0).select(*[
        F.get("cells", F.lit(i)).try_cast(kinds.get(n, "string")).alias(n) for i, n in enumerate(names)])
    return body if limit is None else body.limit(limit)
