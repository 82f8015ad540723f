"""One wide aggregate over a table: counts, missing cells, moments and extremes per column.

The result is a single row whose width is the number of columns, so it is collected and
later passes use its values as literals.  It needs no shuffle beyond that one row.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from plumbline.functions.columns import (
    NUMERIC_FAMILIES, double_sql, family, groupable_sql, type_label,
)
from plumbline.functions.sizing import local_frame


_HASHED = ("string", "nested", "interval")


@dataclass(frozen=True)
class ColumnStats:
    name: str
    position: int
    dtype: str
    kind: str
    label: str
    present: int
    missing: int
    constant: bool  # exactly one distinct value
    mean: float | None = None
    std: float | None = None
    low: float | None = None
    high: float | None = None
    span: int | None = None  # max - min + 1 of integer columns, exact

    @property
    def numeric(self) -> bool:
        return self.kind in NUMERIC_FAMILIES


@dataclass(frozen=True)
class TableStats:
    rows: int
    columns: tuple[ColumnStats, ...]

    @property
    def missing_cells(self) -> int:
        return sum(c.missing for c in self.columns)

    @property
    def cells(self) -> int:
        return self.rows * len(self.columns)

    def numeric(self) -> list[ColumnStats]:
        return [c for c in self.columns if c.numeric]

    def by_name(self, name: str) -> ColumnStats:
        return next(c for c in self.columns if c.name == name)


def table_stats(df: DataFrame, moments: bool = True, constants: bool = True,
                categorical: tuple[str, ...] = ()) -> TableStats:
    """Collect the wide aggregate of ``df``.

    ``constants`` compares min with max instead of counting distinct values: a column is
    constant exactly when they agree, and that needs no shuffle.  For text and nested values
    the hashes are compared first, and only columns whose hashes agree are read again.
    """
    exprs = ["count(1) AS n"]
    for i, f in enumerate(df.schema.fields):
        key = groupable_sql(f)
        numeric = moments and family(f.dataType) in NUMERIC_FAMILIES
        exprs.append(f"count({key}) AS p{i}")
        if constants:
            hashed = family(f.dataType) in _HASHED
            probe = f"CASE WHEN {key} IS NOT NULL THEN xxhash64({key}) END" if hashed else key
            exprs.append(f"min({probe}) = max({probe}) AS c{i}")
        if numeric:
            v = double_sql(f)
            exprs += [f"avg({v}) AS a{i}", f"stddev_samp({v}) AS s{i}",
                      f"CAST(min({key}) AS DOUBLE) AS l{i}", f"CAST(max({key}) AS DOUBLE) AS h{i}"]
            if family(f.dataType) == "integer":
                exprs.append(f"CAST(max({key}) AS DECIMAL(20,0)) - CAST(min({key}) AS DECIMAL(20,0)) + 1 AS w{i}")
    row = df.selectExpr(*exprs).first().asDict()
    n = row["n"]
    unsure = [(i, f) for i, f in enumerate(df.schema.fields) if row.get(f"c{i}") and family(f.dataType) in _HASHED]
    if unsure:
        row |= df.selectExpr(*[f"min({groupable_sql(f)}) = max({groupable_sql(f)}) AS c{i}"
                               for i, f in unsure]).first().asDict()
    columns = []
    for i, f in enumerate(df.schema.fields):
        columns.append(ColumnStats(
            name=f.name, position=i, dtype=f.dataType.simpleString(),
            kind=family(f.dataType), label=type_label(f.dataType, f.name in categorical),
            present=row[f"p{i}"], missing=n - row[f"p{i}"],
            constant=bool(row.get(f"c{i}")),
            mean=row.get(f"a{i}"), std=row.get(f"s{i}"),
            low=row.get(f"l{i}"), high=row.get(f"h{i}"),
            span=None if row.get(f"w{i}") is None else int(row[f"w{i}"]),
        ))
    return TableStats(n, tuple(columns))


def stats_frame(spark: SparkSession, stats: TableStats, extra: dict | None = None) -> DataFrame:
    """The collected statistics as a local relation, one row per column of the table.

    ``extra`` adds columns: name -> (arrow type, {column name: value}).
    """
    cols = stats.columns
    data = {
        "position": (pa.int32(), [c.position for c in cols]),
        "column_name": (pa.string(), [c.name for c in cols]),
        "dtype": (pa.string(), [c.dtype for c in cols]),
        "kind": (pa.string(), [c.kind for c in cols]),
        "data_type": (pa.string(), [c.label for c in cols]),
        "total_count": (pa.int64(), [stats.rows for _ in cols]),
        "null_count": (pa.int64(), [c.missing for c in cols]),
        "present_count": (pa.int64(), [c.present for c in cols]),
        "is_constant": (pa.bool_(), [c.constant for c in cols]),
        "mean": (pa.float64(), [c.mean for c in cols]),
        "std": (pa.float64(), [c.std for c in cols]),
        "min_value": (pa.float64(), [c.low for c in cols]),
        "max_value": (pa.float64(), [c.high for c in cols]),
        "span": (pa.decimal128(20, 0), [None if c.span is None else Decimal(c.span) for c in cols]),
    }
    for name, (kind, values) in (extra or {}).items():
        data[name] = (kind, [values.get(c.name) for c in cols])
    return local_frame(spark, data)
