"""Model replies as a table: find the JSON, read its fields, rank and group the advice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fields and defaults of a recommendation, and the fallback texts.
SUMMARY_DEFAULT = "AI-generated data quality recommendations"
SUMMARY_FALLBACK = "Unable to parse structured recommendations, but analysis was performed."
REPLY_SCHEMA = """
summary string,
recommendations array<struct<
  type:string, category:string, priority:string, title:string, description:string,
  suggested_actions:array<string>, action_items:array<string>, affected_columns:array<string>,
  estimated_impact:string>>
"""
SUITABILITY_SCHEMA = """
overall_verdict string, confidence_score double, readiness_level string, key_blockers array<string>,
recommended_actions array<string>, timeline_estimate string, executive_summary string,
analytics_impact struct<machine_learning:string, statistical_analysis:string, sql_queries:string, visualization:string>
"""
ASSESSMENT_KEYS = ["data_quality_assessment", "data_cleaning_recommendations", "prioritized_action_items"]
ANOMALY_KEYS = ["analysisSummary", "treatmentStrategies", "recommendations"]
IMPACTS = ["machine_learning", "statistical_analysis", "sql_queries", "visualization"]


def without_fences(text: Column) -> Column:
    """The reply without a surrounding code fence."""
    opened = F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), r"^(?:```json)?(?:```)?", "")
    return F.regexp_replace(F.regexp_replace(opened, r"```$", ""), r"(?U)^\s+|\s+$", "")


def json_part(text: Column) -> Column:
    """Text from the first opening to the last closing brace when it is valid JSON, else NULL."""
    body = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when((body != "") & F.try_parse_json(body).isNotNull(), body)


def parse_replies(replies: DataFrame, text: str = "text", keys: list[str] = ("reply_id",)) -> DataFrame:
    """One row per recommendation: keys, summary, item, type, priority, title, description,
    suggested_actions, affected_columns, estimated_impact, parsed, raw_text.

    ``raw_text`` is the whole reply where it cannot be read, and null elsewhere.  A reply without readable JSON gives one fallback row; a reply whose list is empty or
    absent gives one row without an item.
    """
    raw = F.col(text)
    read = replies.select(*keys, raw.alias("__raw"), json_part(raw).alias("__json"))
    parsed = read.withColumn("__r", F.from_json("__json", REPLY_SCHEMA))
    fallback = F.array(F.struct(
        F.lit("general").alias("type"), F.lit("medium").alias("priority"), F.lit("AI Analysis Result").alias("title"),
        F.concat(F.lit("Raw AI response: "), F.substring("__raw", 1, 200), F.lit("...")).alias("description"),
        F.array(F.lit("Review the raw response for insights")).alias("suggested_actions"),
        F.array().cast("array<string>").alias("affected_columns"), F.lit("Varies").alias("estimated_impact")))
    none = F.array().cast("array<string>")
    items = F.transform(F.col("__r.recommendations"), lambda r: F.struct(
        F.coalesce(r["type"], r["category"], F.lit("data_validation")).alias("type"),
        F.coalesce(r["priority"], F.lit("medium")).alias("priority"),
        F.coalesce(r["title"], F.lit("Data Quality Improvement")).alias("title"),
        F.coalesce(r["description"], F.lit("")).alias("description"),
        F.coalesce(r["suggested_actions"], r["action_items"], none).alias("suggested_actions"),
        F.coalesce(r["affected_columns"], none).alias("affected_columns"),
        F.coalesce(r["estimated_impact"], F.lit("")).alias("estimated_impact")))
    ok = F.col("__json").isNotNull()
    shaped = parsed.select(
        *keys, ok.alias("parsed"), F.when(~ok, F.col("__raw")).alias("raw_text"),
        F.when(ok, F.coalesce(F.col("__r.summary"), F.lit(SUMMARY_DEFAULT))).otherwise(SUMMARY_FALLBACK).alias("summary"),
        F.when(ok, items).otherwise(fallback).alias("__items"))
    return shaped.select(*keys, "parsed", "raw_text", "summary", F.posexplode_outer("__items").alias("item", "__i")).select(
        *keys, "parsed", "raw_text", "summary", "item", "__i.*")


def route(replies: DataFrame, text: str = "text", keys: list[str] = ("reply_id",)) -> DataFrame:
    """Each reply with the view its top-level keys call for."""
    body = json_part(without_fences(F.col(text)))
    top = F.json_object_keys(body)
    any_of = lambda names: F.arrays_overlap(top, F.array(*[F.lit(n) for n in names]))
    return replies.select(*keys, F.when(body.isNull(), "text")
                          .when(F.array_contains(top, "analytics_suitability"), "suitability")
                          .when(any_of(ASSESSMENT_KEYS), "assessment")
                          .when(any_of(ANOMALY_KEYS), "anomaly").otherwise("other").alias("view"))


def action_priority(item: Column) -> tuple[Column, Column]:
    """(priority, action) of an item such as ``**High Priority:** do x`` or ``High: do x``.

    Anything but High, Medium or Low counts as Medium; text without a priority is the action.
    """
    starred = item.contains("**") & item.contains(":**")
    plain = item.contains(": ")
    star_head = F.substring_index(item, ":**", 1)
    star_tail = F.trim(F.substring(item, F.length(star_head) + 4, F.length(item)))
    plain_head = F.substring_index(item, ": ", 1)
    plain_tail = F.substring(item, F.length(plain_head) + 3, F.length(item))
    named = F.when(starred, F.trim(F.replace(F.replace(star_head, F.lit("**")), F.lit("Priority")))).when(plain, plain_head)
    level = F.when(named.isin("High", "Medium", "Low"), named).otherwise("Medium")
    return level, F.when(starred, star_tail).when(plain, plain_tail).otherwise(item)


def prioritized_items(replies: DataFrame, text: str = "text", keys: list[str] = ("reply_id",)) -> DataFrame:
    """Cleaning recommendations and action items of assessment replies, with their priority."""
    schema = "data_cleaning_recommendations array<string>, prioritized_action_items array<string>"
    read = replies.select(*keys, F.from_json(json_part(without_fences(F.col(text))), schema).alias("r"))
    lists = F.array_compact(F.array(
        F.when(F.size("r.data_cleaning_recommendations") > 0, F.struct(
            F.lit("recommendation").alias("section"), F.col("r.data_cleaning_recommendations").alias("items"))),
        F.when(F.size("r.prioritized_action_items") > 0, F.struct(
            F.lit("action").alias("section"), F.col("r.prioritized_action_items").alias("items")))))
    flat = read.select(*keys, F.inline(lists)).select(*keys, "section", F.posexplode("items").alias("item", "text"))
    level, action = action_priority(F.col("text"))
    return flat.select(*keys, "section", "item", level.alias("priority"), action.alias("action"))


def priority_groups(items: DataFrame, column: str = "priority") -> DataFrame:
    """Recommendations per group: high, medium, and low for everything else."""
    low = F.lower(F.coalesce(F.col(column), F.lit("Medium")))
    group = F.when(low.isin("high", "medium"), low).otherwise("low")
    return items.groupBy(group.alias("priority_group")).agg(F.count(F.lit(1)).alias("items"))


def suitability(replies: DataFrame, text: str = "text", keys: list[str] = ("reply_id",)) -> DataFrame:
    """Suitability verdicts: headline, confidence note, blockers, actions, impact ratings."""
    body = json_part(without_fences(F.col(text)))
    schema = f"analytics_suitability struct<{_struct(SUITABILITY_SCHEMA)}>"
    read = replies.select(*keys, F.from_json(body, schema)["analytics_suitability"].alias("s")).where("s is not null")
    verdict = F.coalesce("s.overall_verdict", F.lit("UNKNOWN"))
    sure = F.coalesce("s.confidence_score", F.lit(0.0))

    def rated(kind: str) -> Column:
        told = F.col(f"s.analytics_impact.{kind}")
        return F.when(told.contains("Good"), "good").when(told.contains("Fair"), "fair").when(
            told.isNotNull(), "poor").alias(kind)

    return read.select(
        *keys, verdict.alias("verdict"), sure.alias("confidence"),
        F.coalesce("s.readiness_level", F.lit("Unknown")).alias("readiness_level"),
        F.when(verdict == "SUITABLE", "ANALYTICS READY").when(verdict == "CONDITIONALLY_SUITABLE", "CONDITIONALLY SUITABLE")
        .otherwise("NOT SUITABLE").alias("headline"),
        F.when(verdict == "SUITABLE", F.when(sure > 80, "High Confidence").otherwise("Medium Confidence"))
        .when(verdict == "CONDITIONALLY_SUITABLE", "Review Required").otherwise("Major Issues Found").alias("confidence_note"),
        F.col("s.executive_summary").alias("executive_summary"),
        F.coalesce("s.timeline_estimate", F.lit("Unknown")).alias("timeline"),
        F.coalesce("s.key_blockers", F.array().cast("array<string>")).alias("key_blockers"),
        F.coalesce("s.recommended_actions", F.array().cast("array<string>")).alias("recommended_actions"),
        *[rated(k) for k in IMPACTS])


def _struct(ddl: str) -> str:
    """A column list as struct fields: ``a int, b string`` to ``a:int, b:string``."""
    from pyspark.sql import types as T
    return T.StructType.fromDDL(ddl).simpleString()[len("struct<"):-1]
