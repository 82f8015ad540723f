"""Differences between two snapshots, as rows.

Snapshots are one row per dataset with the columns packed inside, so a comparison is a
projection over one pair of rows: nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.sizing import ratio
from plumbline.functions.text import fixed, grouped, signed

CHANGE = "array<struct<rank:int,type:string,severity:string,description:string>>"
# Severity weights of the change score.
WEIGHTS = {"low": 1, "medium": 3, "high": 5}
# Advice by change type, in reporting order.
ADVICE = [
    ("columns_removed", "Critical: Column removal detected - verify ETL pipeline integrity"),
    ("columns_removed", "Review data source schema changes and update mappings"),
    ("data_type_changes", "Data type changes detected - validate downstream processes"),
    ("data_type_changes", "Update data validation rules to handle type changes"),
    ("quality_degraded", "Data quality degradation detected - investigate data sources"),
    ("quality_improved", "Data quality improvement detected - document successful changes"),
    ("fingerprint_changes", "Significant data changes detected - perform detailed audit"),
    ("fingerprint_changes", "Consider implementing change tracking for critical datasets"),
    ("row_count_change", "Row count changes - verify data loading completeness"),
    ("row_count_change", "Check if changes align with expected data refresh cycles"),
    ("many_changes", "Multiple changes detected - consider comprehensive data validation"),
    ("no_changes", "No significant changes detected - datasets appear consistent"),
]


def _pair(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both snapshots as one row: structs ``o`` and ``n``, ``cols`` (name, old, new) sorted by
    name, and the lists added, removed and retyped."""
    pair = old.select(F.struct("*").alias("o")).crossJoin(F.broadcast(new.select(F.struct("*").alias("n"))))  # one row each
    return pair.selectExpr(
        "o", "n", "map_from_entries(transform(o.columns, c -> struct(c.name, c))) AS was",
        "map_from_entries(transform(n.columns, c -> struct(c.name, c))) AS now",
    ).selectExpr(
        "o", "n", """transform(array_sort(array_union(map_keys(was), map_keys(now))),
            x -> named_struct('name', x, 'old', try_element_at(was, x), 'new', try_element_at(now, x))) AS cols""",
    ).selectExpr(
        "o", "n", "cols", "transform(filter(cols, c -> c.old IS NULL), c -> c.name) AS added",
        "transform(filter(cols, c -> c.new IS NULL), c -> c.name) AS removed",
        """transform(filter(cols, c -> c.old.data_type <> c.new.data_type),
            c -> named_struct('name', c.name, 'was', c.old.data_type, 'now', c.new.data_type)) AS retyped""")


def column_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Columns of two snapshots side by side: name, old, new, change.

    change is added, removed, retyped or kept.
    """
    return _pair(old, new).select(F.inline("cols")).withColumn(
        "change", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed")
        .when(F.col("old.data_type") != F.col("new.data_type"), "retyped").otherwise("kept"))


def _change(rank: int, test: Column, kind, severity, text: Column) -> Column:
    lit = lambda v: F.lit(v) if isinstance(v, str) else v
    return F.when(test, F.struct(F.lit(rank).alias("rank"), lit(kind).alias("type"),
                                 lit(severity).alias("severity"), text.alias("description")))


def simple_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Change rows: added and removed columns, type changes, row and missing-cell counts."""
    sides = _pair(old, new)
    rows = F.col("n.row_count") - F.col("o.row_count")
    nulls = F.col("n.total_null_count") - F.col("o.total_null_count")

    def moved(field: str, delta: Column) -> Column:
        return F.concat(grouped(F.col(f"o.{field}")), F.lit(" → "), grouped(F.col(f"n.{field}")),
                        F.lit(" ("), signed(delta), F.lit(")"))

    fixed_changes = F.array_compact(F.array(
        _change(1, F.size("added") > 0, "schema", "high",
                F.concat(F.lit("Added columns: "), F.concat_ws(", ", "added"))),
        _change(2, F.size("removed") > 0, "schema", "high",
                F.concat(F.lit("Removed columns: "), F.concat_ws(", ", "removed"))),
        _change(4, rows != 0, "data",
                F.when(F.abs(rows) > F.col("o.row_count") * 0.1, "high").otherwise("medium"),
                F.concat(F.lit("Row count changed: "), moved("row_count", rows))),
        _change(5, nulls != 0, "data", F.when(F.abs(nulls) > 100, "high").otherwise("medium"),
                F.concat(F.lit("Total null count changed: "), moved("total_null_count", nulls)))))
    typed = F.transform("retyped", lambda c: F.struct(
        F.lit(3).alias("rank"), F.lit("schema").alias("type"), F.lit("medium").alias("severity"),
        F.concat(F.lit("Column '"), c["name"], F.lit("' type changed: "), c["was"], F.lit(" → "), c["now"])
        .alias("description")))
    return sides.select(F.inline(F.array_sort(F.concat(fixed_changes.cast(CHANGE), typed.cast(CHANGE)))))


def simple_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row: what changed, change score, advice and size deltas."""
    found = simple_changes(old, new).agg(
        F.count(F.lit(1)).alias("total_changes"),
        F.coalesce(F.max(F.col("type") == "schema"), F.lit(False)).alias("schema_changed"),
        F.coalesce(F.max(F.col("type") == "data"), F.lit(False)).alias("data_changed"))
    sizes = old.select(F.col("row_count").alias("r1"), F.col("column_count").alias("c1")).crossJoin(
        F.broadcast(new.select(F.col("row_count").alias("r2"), F.col("column_count").alias("c2"))))  # one row each
    return found.crossJoin(F.broadcast(sizes)).select(
        "schema_changed", "data_changed", "total_changes",
        F.least(F.lit(100), F.when(F.col("schema_changed"), 50).otherwise(0)
                + F.when(F.col("data_changed"), 30).otherwise(0)).cast("bigint").alias("change_score"),
        (F.col("r2") - F.col("r1")).alias("row_count_change"),
        (F.col("c2") - F.col("c1")).alias("column_count_change"),
        F.array_compact(F.array(
            F.when(F.col("schema_changed"), F.lit("Review schema changes to ensure compatibility")),
            F.when(F.col("data_changed"), F.lit("Validate data changes and update downstream processes")),
            F.when(F.col("total_changes") == 0, F.lit("No significant changes detected")))).alias("recommendations"))


def _details(c: Column) -> Column:
    """Detail changes of one column present on both sides."""
    mean1, mean2 = c["old"]["mean_value"], c["new"]["mean_value"]
    u1, u2 = c["old"]["unique_count"], c["new"]["unique_count"]
    finite = (F.abs(mean1) < float("inf")) & (F.abs(mean2) < float("inf"))  # NaN is above infinity
    mean_pct = F.when(finite & (mean1 != 0), F.abs(F.try_divide(mean2 - mean1, mean1) * 100)).otherwise(0.0)
    unique_pct = F.when(u1 > 0, F.abs(ratio(u2 - u1, u1) * 100)).otherwise(0.0)

    def detail(test: Column, kind: str, text: Column, amount: Column) -> Column:
        return F.when(test, F.struct(c["name"].alias("column_name"), F.lit(kind).alias("change_type"),
                                     text.alias("description"), amount.cast("double").alias("amount")))

    return F.array_compact(F.array(
        detail(c["old"]["value_hash"] != c["new"]["value_hash"], "content_changed",
               F.concat(F.lit("Content in column '"), c["name"], F.lit("' has changed")), u2 - u1),
        detail(mean1.isNotNull() & mean2.isNotNull() & (mean_pct > 10), "statistical_change",
               F.concat(F.lit("Mean value in '"), c["name"], F.lit("' changed by "), fixed(mean_pct, 1), F.lit("%")), mean_pct),
        detail(unique_pct > 20, "cardinality_change",
               F.concat(F.lit("Unique values in '"), c["name"], F.lit("' changed by "), fixed(unique_pct, 1), F.lit("%")),
               unique_pct)))


def _detail_list() -> Column:
    kept = F.filter("cols", lambda c: c["old"].isNotNull() & c["new"].isNotNull())
    return F.flatten(F.transform(kept, _details))


def column_level_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Common columns whose content, mean (> 10 %) or cardinality (> 20 %) changed."""
    return _pair(old, new).select(F.inline(_detail_list()))


# Digest, name, description, impact.
PRINTS = [("structure_hash", "structure", "Dataset structure has changed", "Schema or indexing changes detected"),
          ("content_hash", "content", "Dataset content has changed", "Data values have been modified"),
          ("stats_hash", "statistics", "Statistical properties have changed",
           "Data distribution or quality metrics changed")]


def _print_list() -> Column:
    return F.array_compact(F.array(*[
        F.when(F.col(f"o.{h}") != F.col(f"n.{h}"), F.struct(
            F.lit(k).alias("hash_type"), F.lit(d).alias("description"), F.lit(i).alias("impact")))
        for h, k, d, i in PRINTS]))


def fingerprint_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Digests that differ: hash_type, description, impact."""
    return _pair(old, new).select(F.inline(_print_list()))


def extended_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Change rows of two extended snapshots: size, schema, quality, columns, fingerprints."""
    sides = _pair(old, new).withColumns({"detail_count": F.size(_detail_list()), "print_count": F.size(_print_list())})
    rows_pct = F.when(F.col("o.row_count") > 0, ratio(
        F.col("n.row_count") - F.col("o.row_count"), F.col("o.row_count")) * 100).otherwise(0.0)
    score = F.col("n.data_quality_score") - F.col("o.data_quality_score")
    nulls = F.col("n.total_null_count") - F.col("o.total_null_count")
    dups = F.col("n.total_duplicate_rows") - F.col("o.total_duplicate_rows")

    def text(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    found = F.array_compact(F.array(
        _change(1, F.abs(rows_pct) > 5, "row_count_change",
                F.when(F.abs(rows_pct) > 20, "high").otherwise("medium"),
                text("Row count changed by ", fixed(rows_pct, 1), "%")),
        _change(2, F.size("added") > 0, "columns_added", "medium",
                text("Added ", F.size("added").cast("string"), " new columns")),
        _change(3, F.size("removed") > 0, "columns_removed", "high",
                text("Removed ", F.size("removed").cast("string"), " columns")),
        _change(4, F.size("retyped") > 0, "data_type_changes", "high",
                text("Data type changes in ", F.size("retyped").cast("string"), " columns")),
        _change(5, F.col("o.schema_hash") != F.col("n.schema_hash"), "schema_structure_change", "medium",
                text("Overall schema structure has changed")),
        _change(6, F.abs(score) > 5, "quality_score_change", F.when(F.abs(score) > 15, "high").otherwise("medium"),
                text("Data quality ", F.when(score > 0, "improved").otherwise("degraded"), " by ",
                     fixed(F.abs(score), 1), " points")),
        _change(7, nulls != 0, "null_count_change", F.when(F.abs(nulls) < 100, "low").otherwise("medium"),
                text("Total null values changed by ", nulls.cast("string"))),
        _change(8, dups != 0, "duplicate_count_change", F.when(F.abs(dups) < 10, "low").otherwise("medium"),
                text("Duplicate rows changed by ", dups.cast("string"))),
        _change(9, F.col("detail_count") > 0, "column_level_changes", "medium",
                text("Changes detected in ", F.col("detail_count").cast("string"), " columns")),
        _change(10, F.col("print_count") > 0, "fingerprint_changes", "high",
                text("Hash-based change detection: ", F.col("print_count").cast("string"), " changes"))))
    return sides.select(F.inline(found))


def change_score(changes: DataFrame) -> DataFrame:
    """One row: changes and their weighted score, 0 (none) to 100 (all severe)."""
    weight = F.coalesce(*[F.when(F.col("severity") == s, w) for s, w in WEIGHTS.items()], F.lit(1))
    return changes.agg(F.count(F.lit(1)).alias("total_changes"),
                       F.coalesce(F.sum(weight), F.lit(0)).alias("weight")).select(
        "total_changes", F.coalesce(ratio(F.col("weight"), F.col("total_changes") * 5) * 100, F.lit(0.0))
        .alias("change_score"))


def change_advice(changes: DataFrame) -> DataFrame:
    """Advice for the change types present: rank, advice."""
    facts = changes.agg(F.collect_set("type").alias("types"), F.count(F.lit(1)).alias("n"),
                        F.max(F.col("description").startswith("Data quality improved")).alias("better"))
    better = F.coalesce("better", F.lit(False))
    scored = F.array_contains("types", "quality_score_change")

    def test(kind: str) -> Column:
        return {"quality_degraded": scored & ~better, "quality_improved": scored & better,
                "many_changes": F.col("n") > 5, "no_changes": F.col("n") == 0,
                }.get(kind, F.array_contains("types", kind))

    return facts.select(F.inline(F.array_compact(F.array(*[
        F.when(test(kind), F.struct(F.lit(i + 1).alias("rank"), F.lit(text).alias("advice")))
        for i, (kind, text) in enumerate(ADVICE)]))))


def size_difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row: row, column and byte differences of two extended snapshots."""
    o = old.select(F.struct("row_count", "column_count", "size_bytes").alias("o"))
    n = new.select(F.struct("row_count", "column_count", "size_bytes").alias("n"))
    rows = F.col("n.row_count") - F.col("o.row_count")
    return o.crossJoin(F.broadcast(n)).select(  # one row each
        rows.alias("row_diff"), (F.col("n.column_count") - F.col("o.column_count")).alias("column_diff"),
        F.when(F.col("o.row_count") > 0, ratio(rows, F.col("o.row_count")) * 100).otherwise(0.0).alias("row_diff_pct"),
        (F.col("n.size_bytes") - F.col("o.size_bytes")).alias("size_diff"))
