"""The article, ledger and page views of the test tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

START = datetime(2024, 1, 1)
CATEGORIES = ["Models", "Agents", "Infrastructure", "Open Source", "Research"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clock(spark: SparkSession, sf_dir: str) -> datetime:
    """An hour after the newest article."""
    top = table(spark, sf_dir, "documents").agg(F.max("doc_id")).first()[0]
    return START + timedelta(hours=(top or 0) + 1)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles; flags and scores follow from ids and lengths by whole-number arithmetic."""
    bad = table(spark, sf_dir, "labels").filter("quality = 0").select("doc_id").distinct().withColumn("bad", F.lit(True))
    docs = table(spark, sf_dir, "documents").join(bad, "doc_id", "left")
    return docs.selectExpr(
        "doc_id AS id",
        "source AS source_name",
        "lang AS language",
        "text AS content",
        "substr(split_part(text, '\n', 1), 1, 500) AS title",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, CAST(doc_id AS INT), 0, 0) AS published_at",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, CAST(doc_id AS INT), CAST(doc_id % 7 AS INT) * 10, 0) AS created_at",
        "CASE WHEN doc_id % 4 = 0 THEN NULL ELSE doc_id DIV 4 + 1 END AS event_id",
        "doc_id % 11 <> 0 AS is_processed",
        "doc_id % 13 = 0 AS is_archived",
        "CASE WHEN doc_id % 5 = 0 THEN true WHEN doc_id % 5 = 1 THEN NULL ELSE false END AS is_sent",
        "coalesce(bad, false) AS filtered_out",
        "CASE doc_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'D' END AS tier",
        "CASE doc_id % 7 WHEN 0 THEN 'Models' WHEN 1 THEN 'Agents' WHEN 2 THEN 'Infrastructure' WHEN 3 THEN 'Open Source' WHEN 4 THEN 'Research' WHEN 5 THEN '' END AS category",
        "CAST((n_chars * 13 + doc_id) % 400 AS DOUBLE) AS heat",
        "((n_chars * 7919 + doc_id * 31) % 1000) / 10.0D AS final_score",
        "n_chars",
        "doc_id % 9 = 0 AS is_free_offer",
        "CASE doc_id % 3 WHEN 0 THEN 'Hosting' WHEN 1 THEN 'Editor' ELSE 'Search' END AS free_tool",
        "(n_chars % 100) / 100.0D AS free_confidence",
        "CASE doc_id % 6 WHEN 0 THEN NULL WHEN 3 THEN false ELSE true END AS subject_in_title",
        "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE concat('t', doc_id) END AS title_zh",
        "CASE WHEN doc_id % 5 = 0 THEN NULL ELSE concat('s', doc_id) END AS summary_zh",
        "CASE doc_id % 4 WHEN 0 THEN '{}' WHEN 1 THEN concat('{\"key_points_tried\": ', doc_id % 3, '}') WHEN 2 THEN '{\"key_points_zh\": [\"a\"]}' ELSE '{\"breaking_defer\": {\"tries\": 1}}' END AS meta",
    )


ARTICLES = """clock AS (SELECT TIMESTAMP '2024-01-01' + to_hours(CAST(max(doc_id) + 1 AS INTEGER)) AS as_of FROM documents),
art AS (SELECT d.doc_id AS id, d.source AS source_name, d.lang AS language, d.text AS content,
  substr(split_part(d.text, chr(10), 1), 1, 500) AS title,
  TIMESTAMP '2024-01-01' + to_hours(CAST(d.doc_id AS INTEGER)) AS published_at,
  TIMESTAMP '2024-01-01' + to_hours(CAST(d.doc_id AS INTEGER)) + to_minutes(CAST(d.doc_id % 7 * 10 AS INTEGER)) AS created_at,
  CASE WHEN d.doc_id % 4 = 0 THEN NULL ELSE d.doc_id // 4 + 1 END AS event_id,
  d.doc_id % 11 <> 0 AS is_processed, d.doc_id % 13 = 0 AS is_archived,
  CASE WHEN d.doc_id % 5 = 0 THEN true WHEN d.doc_id % 5 = 1 THEN NULL ELSE false END AS is_sent,
  coalesce(b.bad, false) AS filtered_out,
  CASE d.doc_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'D' END AS tier,
  CASE d.doc_id % 7 WHEN 0 THEN 'Models' WHEN 1 THEN 'Agents' WHEN 2 THEN 'Infrastructure' WHEN 3 THEN 'Open Source' WHEN 4 THEN 'Research' WHEN 5 THEN '' END AS category,
  CAST((d.n_chars * 13 + d.doc_id) % 400 AS DOUBLE) AS heat,
  CAST((d.n_chars * 7919 + d.doc_id * 31) % 1000 AS DOUBLE) / CAST(10 AS DOUBLE) AS final_score,
  d.n_chars, d.doc_id % 9 = 0 AS is_free_offer,
  CASE d.doc_id % 3 WHEN 0 THEN 'Hosting' WHEN 1 THEN 'Editor' ELSE 'Search' END AS free_tool,
  CAST(d.n_chars % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS free_confidence,
  CASE d.doc_id % 6 WHEN 0 THEN NULL WHEN 3 THEN false ELSE true END AS subject_in_title,
  CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE 't' || d.doc_id END AS title_zh,
  CASE WHEN d.doc_id % 5 = 0 THEN NULL ELSE 's' || d.doc_id END AS summary_zh,
  CASE d.doc_id % 4 WHEN 0 THEN '{}' WHEN 1 THEN '{"key_points_tried": ' || (d.doc_id % 3) || '}' WHEN 2 THEN '{"key_points_zh": ["a"]}' ELSE '{"breaking_defer": {"tries": 1}}' END AS meta
  FROM documents d LEFT JOIN (SELECT DISTINCT doc_id, true AS bad FROM labels WHERE quality = 0) b ON d.doc_id = b.doc_id),
vis AS (SELECT * FROM art WHERE NOT is_archived AND NOT filtered_out AND is_processed),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(-event_id, id) ORDER BY final_score DESC, published_at DESC, id DESC) AS rn FROM vis) WHERE rn = 1)
"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as pushes to readers."""
    return table(spark, sf_dir, "events").selectExpr("event_id AS id", "user_id", "event_type AS kind", "CASE WHEN event_id % 10 = 0 THEN NULL ELSE event_id % 997 END AS article_id", "ts AS created_at")


LEDGER = "led AS (SELECT event_id AS id, user_id, event_type AS kind, CASE WHEN event_id % 10 = 0 THEN NULL ELSE event_id % 997 END AS article_id, ts AS created_at FROM events)"
