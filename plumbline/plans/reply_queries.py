"""Reply parsing over replies derived from the conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import replies
from plumbline.plans.catalog import query
from plumbline.plans.fixtures import sql, view

R = sql("replies")
FENCED = r"""regexp_replace(regexp_replace(regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '^(```json)?(```)?', ''), '```$', '')"""
BODY = "CASE WHEN b <> '' AND json_valid(b) THEN CAST(b AS JSON) END"


def body(text: str = "text") -> str:
    return f"(SELECT reply_id, text, {BODY} AS j FROM (SELECT *, regexp_extract({text}, '(?s)\\{{.*\\}}', 0) AS b FROM {R} r))"


@query("parse_replies", f"""
WITH p AS (SELECT * FROM {body()}),
items AS (SELECT reply_id, j, CAST(i AS INTEGER) AS item, json_extract(j, '$.recommendations[' || i || ']') AS r
  FROM (SELECT *, unnest(range(CAST(json_array_length(j, '$.recommendations') AS BIGINT))) AS i FROM p WHERE j IS NOT NULL AND json_array_length(j, '$.recommendations') > 0))
SELECT reply_id, TRUE AS parsed, coalesce(j->>'$.summary', 'AI-generated data quality recommendations') AS summary, item,
  coalesce(r->>'$.type', r->>'$.category', 'data_validation') AS type, coalesce(r->>'$.priority', 'medium') AS priority,
  coalesce(r->>'$.title', 'Data Quality Improvement') AS title, coalesce(r->>'$.description', '') AS description,
  coalesce(array_to_string(coalesce(CAST(r->'$.suggested_actions' AS VARCHAR[]), CAST(r->'$.action_items' AS VARCHAR[])), '|'), '') AS actions,
  coalesce(array_to_string(CAST(r->'$.affected_columns' AS VARCHAR[]), '|'), '') AS columns, coalesce(r->>'$.estimated_impact', '') AS estimated_impact, NULL AS raw_text
FROM items
UNION ALL
SELECT reply_id, TRUE, coalesce(j->>'$.summary', 'AI-generated data quality recommendations'), NULL, NULL, NULL, NULL, NULL, '', '', NULL, NULL
FROM p WHERE j IS NOT NULL AND coalesce(json_array_length(j, '$.recommendations'), 0) = 0
UNION ALL
SELECT reply_id, FALSE, 'Unable to parse structured recommendations, but analysis was performed.', 0, 'general', 'medium', 'AI Analysis Result',
  'Raw AI response: ' || substring(text, 1, 200) || '...', 'Review the raw response for insights', '', 'Varies', text
FROM p WHERE j IS NULL""")
def parse_replies(spark, sf_dir):
    got = replies.parse_replies(view(spark, sf_dir, "replies"))
    return got.select("reply_id", "parsed", "summary", "item", "type", "priority", "title", "description",
                      F.concat_ws("|", "suggested_actions").alias("actions"),
                      F.concat_ws("|", "affected_columns").alias("columns"), "estimated_impact", "raw_text")


@query("reply_routes", f"""
SELECT reply_id, CASE WHEN j IS NULL THEN 'text' WHEN json_exists(j, '$.analytics_suitability') THEN 'suitability'
  WHEN json_exists(j, '$.data_quality_assessment') OR json_exists(j, '$.data_cleaning_recommendations') OR json_exists(j, '$.prioritized_action_items') THEN 'assessment'
  WHEN json_exists(j, '$.analysisSummary') OR json_exists(j, '$.treatmentStrategies') OR json_exists(j, '$.recommendations') THEN 'anomaly'
  ELSE 'other' END AS view FROM {body(FENCED)}""")
def reply_routes(spark, sf_dir):
    return replies.route(view(spark, sf_dir, "replies"))


ITEMS = f"""WITH p AS (SELECT * FROM {body(FENCED)} WHERE j IS NOT NULL),
flat AS (SELECT reply_id, section, CAST(i AS INTEGER) AS item, CAST(l AS VARCHAR[])[i + 1] AS t FROM (
  SELECT *, unnest(range(len(CAST(l AS VARCHAR[])))) AS i FROM (
    SELECT reply_id, 'recommendation' AS section, j->'$.data_cleaning_recommendations' AS l FROM p
    UNION ALL SELECT reply_id, 'action', j->'$.prioritized_action_items' FROM p) WHERE l IS NOT NULL)),
cut AS (SELECT *, CASE WHEN contains(t, '**') AND contains(t, ':**') THEN trim(replace(replace(split_part(t, ':**', 1), '**', ''), 'Priority', ''))
    WHEN contains(t, ': ') THEN split_part(t, ': ', 1) END AS named,
  CASE WHEN contains(t, '**') AND contains(t, ':**') THEN trim(substring(t, length(split_part(t, ':**', 1)) + 4))
    WHEN contains(t, ': ') THEN substring(t, length(split_part(t, ': ', 1)) + 3) ELSE t END AS action FROM flat),
items AS (SELECT reply_id, section, item, CASE WHEN named IN ('High', 'Medium', 'Low') THEN named ELSE 'Medium' END AS priority, action FROM cut)"""


@query("reply_priority", ITEMS + " SELECT * FROM items")
def reply_priority(spark, sf_dir):
    return replies.prioritized_items(view(spark, sf_dir, "replies"))


@query("priority_groups", ITEMS + " SELECT lower(priority) AS priority_group, count(*) AS items FROM items GROUP BY 1")
def priority_groups(spark, sf_dir):
    return replies.priority_groups(replies.prioritized_items(view(spark, sf_dir, "replies")))


def rating(kind: str) -> str:
    told = f"s->>'$.analytics_impact.{kind}'"
    return (f"CASE WHEN contains({told}, 'Good') THEN 'good' WHEN contains({told}, 'Fair') THEN 'fair' "
            f"WHEN ({told}) IS NOT NULL THEN 'poor' END AS {kind}")


@query("suitability", f"""
WITH p AS (SELECT reply_id, j->'$.analytics_suitability' AS s FROM {body(FENCED)} WHERE json_exists(j, '$.analytics_suitability')),
q AS (SELECT *, coalesce(s->>'$.overall_verdict', 'UNKNOWN') AS verdict, coalesce(CAST(s->>'$.confidence_score' AS DOUBLE), 0.0) AS confidence FROM p)
SELECT reply_id, verdict, confidence, coalesce(s->>'$.readiness_level', 'Unknown') AS readiness_level,
  CASE verdict WHEN 'SUITABLE' THEN 'ANALYTICS READY' WHEN 'CONDITIONALLY_SUITABLE' THEN 'CONDITIONALLY SUITABLE' ELSE 'NOT SUITABLE' END AS headline,
  CASE verdict WHEN 'SUITABLE' THEN CASE WHEN confidence > 80 THEN 'High Confidence' ELSE 'Medium Confidence' END
    WHEN 'CONDITIONALLY_SUITABLE' THEN 'Review Required' ELSE 'Major Issues Found' END AS confidence_note,
  coalesce(s->>'$.timeline_estimate', 'Unknown') AS timeline, array_to_string(CAST(s->'$.key_blockers' AS VARCHAR[]), '|') AS key_blockers,
  array_to_string(CAST(s->'$.recommended_actions' AS VARCHAR[]), '|') AS recommended_actions,
  {', '.join(rating(k) for k in replies.IMPACTS)} FROM q""")
def suitability(spark, sf_dir):
    got = replies.suitability(view(spark, sf_dir, "replies"))
    return got.drop("executive_summary").withColumns({
        "key_blockers": F.concat_ws("|", "key_blockers"), "recommended_actions": F.concat_ws("|", "recommended_actions")})
