"""Registered queries: streams that keep state by key, run to the end of their tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming.ingest import event_stream
from ..streaming.ordered import run_stream
from ..streaming.remembered import ACTIONS, last_shown
from ..streaming.stories import stories
from .registry import query

_SHOWN = """
WITH a AS (SELECT user_id, event_id AS tie, epoch_us(ts) // 1000 AS ms, event_type AS t, event_id % 5 AS place, CASE WHEN event_id % 2 = 0 THEN 't' || event_id END AS title,
                  CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 50 AS INTEGER) END AS total, CAST(event_id % 7 AS INTEGER) AS days FROM events),
b AS (SELECT *, last_value(CASE WHEN t IN ('signup', 'error', 'purchase') THEN t END IGNORE NULLS) OVER w AS last_t, max(CASE WHEN t IN ('signup', 'error', 'purchase') THEN ms END) OVER w AS last_ms
      FROM a WINDOW w AS (PARTITION BY user_id ORDER BY ms, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, coalesce(last_t <> 'purchase' AND ms - last_ms <= 21600000, false) AS alive FROM b),
d AS (SELECT *, sum(CASE WHEN t IN ('signup', 'error') AND NOT alive THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ms, tie) AS island FROM c),
e AS (SELECT *, sum(CASE WHEN t = 'signup' THEN 1 ELSE 0 END) OVER w AS lists, last_value(CASE WHEN t = 'signup' THEN tie END IGNORE NULLS) OVER w AS first,
             last_value(CASE WHEN t = 'signup' THEN title END IGNORE NULLS) OVER w AS name, last_value(CASE WHEN t = 'signup' THEN total END IGNORE NULLS) OVER w AS n
      FROM d WINDOW w AS (PARTITION BY user_id, island ORDER BY ms, tie)),
f AS (SELECT *, last_value(CASE WHEN t = 'error' THEN days END IGNORE NULLS) OVER (PARTITION BY user_id, island, lists ORDER BY ms, tie) AS span FROM e),
g AS (SELECT user_id, ms, t, lead(ms) OVER (PARTITION BY user_id ORDER BY ms, tie) AS next_ms FROM a WHERE t IN ('signup', 'error', 'purchase'))
SELECT user_id, ms, tie, CASE t WHEN 'view' THEN 'nth' ELSE 'recall' END AS answer, CASE WHEN t = 'view' AND alive AND lists > 0 AND place BETWEEN 1 AND 3 THEN first + place - 1 END AS article_id,
       CASE WHEN alive THEN span END AS days, CASE WHEN alive THEN name END AS title, CASE WHEN alive THEN n END AS total, CASE WHEN alive THEN CASE WHEN lists > 0 THEN 3 ELSE 0 END END AS shown
FROM f WHERE t IN ('view', 'click')
UNION ALL SELECT user_id, ms + 21600000, NULL, 'expired', NULL, NULL, NULL, NULL, NULL FROM g WHERE t <> 'purchase' AND (next_ms IS NULL OR next_ms - ms > 21600000)
"""


@query(_SHOWN)
def stm12_last_shown(spark, sf_dir):
    """Events as readers' actions: lists remembered for six hours, spans of days, questions by place, and what expired."""
    event = event_stream(spark, f"{sf_dir}/events.parquet", files_per_batch=None)
    action = F.element_at(F.create_map(*map(F.lit, ("signup", "list", "error", "days", "purchase", "forget", "view", "nth", "click", "recall"))), F.col("event_type"))
    whole = {
        "action": action,
        "items": F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda k: F.col("event_id") + k),
        "kind": F.lit("news"),
        "title": F.expr("CASE WHEN event_id % 2 = 0 THEN concat('t', event_id) END"),
        "total": F.expr("CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 50 AS INT) END"),
        "days": F.expr("CAST(event_id % 7 AS INT)"),
        "place": F.expr("CAST(event_id % 5 AS INT)"),
    }
    actions = event.withColumns(whole).select("user_id", "ts", "event_id", *whole)
    return run_stream(spark, lambda pulse: last_shown(actions.unionByName(pulse)), ts="ts", columns=f"user_id bigint, ts timestamp_ntz, event_id bigint, {ACTIONS}")


_ARTICLE = "id bigint, title string, lane string, hash string, published_at timestamp_ntz, created_at timestamp_ntz"


@query()
def stm01_story_stream(spark, sf_dir):
    """Documents as articles that arrive by id, grouped into stories within their language; a test folds the same in a loop."""
    docs = event_stream(spark, f"{sf_dir}/documents.parquet", files_per_batch=None)
    hour = "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, CAST(doc_id AS INT), {}, 0)"
    late = "CAST(doc_id % 40 = 7 AS INT) * -3000"  # some were published two days before they came in
    art = docs.selectExpr("doc_id AS id", "substr(split_part(text, '\n', 1), 1, 500) AS title", "lang AS lane", "sha1(text) AS hash", f"{hour.format(late)} AS published_at", f"{hour.format(0)} AS created_at")
    found = run_stream(spark, lambda pulse: stories(art.unionByName(pulse)), ts="created_at", columns=_ARTICLE)
    return found.select("lane", "id", "leader", "score", "method")
