"""Type families and missing-value rules.

A value is missing when it is NULL or, for floating-point columns, NaN.  Every
operator works on ``present(...)`` columns so that NaN never reaches an aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

NUMERIC_FAMILIES = ("integer", "float", "decimal")


def family(dtype: T.DataType) -> str:
    """integer, float, decimal, datetime, boolean, string, interval or nested."""
    if isinstance(dtype, T.IntegralType):
        return "integer"
    if isinstance(dtype, T.FractionalType):
        return "decimal" if isinstance(dtype, T.DecimalType) else "float"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return "nested"
    if isinstance(dtype, (T.DayTimeIntervalType, T.YearMonthIntervalType)):
        return "interval"
    return "string"


def type_label(dtype: T.DataType, categorical: bool = False) -> str:
    """The label a profile shows; nested and interval columns report as ``string``."""
    if categorical:
        return "categorical"
    kind = family(dtype)
    return kind if kind not in ("nested", "interval") else "string"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def is_floating(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.FloatType, T.DoubleType))


def present_sql(field: T.StructField) -> str:
    """The column with NaN turned into NULL.

    Wide operators build SQL text: one expression per table column is then one call.
    """
    col = quoted(field.name)
    return f"CASE WHEN NOT isnan({col}) THEN {col} END" if is_floating(field) else col


def missing_sql(field: T.StructField) -> str:
    col = quoted(field.name)
    return f"({col} IS NULL OR isnan({col}))" if is_floating(field) else f"({col} IS NULL)"


def groupable_sql(field: T.StructField) -> str:
    """A form of the column that can be a grouping key and has an order."""
    col, kind = quoted(field.name), family(field.dataType)
    if kind == "nested":
        if isinstance(field.dataType, T.VariantType):
            return f"to_json({col})"
        # a struct wrapper lets to_json take any nested type; NULL stays NULL
        return f"CASE WHEN {col} IS NOT NULL THEN to_json(named_struct('v', {col})) END"
    return f"CAST({col} AS STRING)" if kind == "interval" else present_sql(field)


def double_sql(field: T.StructField) -> str:
    return f"CAST({present_sql(field)} AS DOUBLE)"


def number(value: float) -> str:
    """A double as a SQL literal, exact and safe for infinities."""
    return f"CAST('{value!r}' AS DOUBLE)"


def raw(field: T.StructField) -> Column:
    return F.col(quoted(field.name))


def is_missing(field: T.StructField) -> Column:
    return F.expr(missing_sql(field))


def as_double(field: T.StructField) -> Column:
    return F.expr(double_sql(field))


def normalise(df: DataFrame) -> DataFrame:
    """NaN to NULL everywhere; nested values to text so that rows can be compared."""
    return df.selectExpr(*[f"{groupable_sql(f)} AS {quoted(f.name)}" for f in df.schema.fields])


def numeric_fields(df: DataFrame) -> list[T.StructField]:
    return [f for f in df.schema.fields if family(f.dataType) in NUMERIC_FAMILIES]


def string_fields(df: DataFrame) -> list[T.StructField]:
    return [f for f in df.schema.fields if family(f.dataType) == "string"]


def drop_missing(df: DataFrame, column: str) -> DataFrame:
    """Rows in which ``column`` holds a value."""
    return df.where(~is_missing(df.schema[column]))


def outside(value: Column, lower, upper) -> Column:
    """Strictly outside the closed range."""
    return (value < lower) | (value > upper)
