"""Registered queries: folds over ordered rows whose state is carried from slice to slice."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import messages, pacing
from ..sources import conditional
from .articles import ARTICLES, articles, table
from .registry import query

_PACED = """
WITH RECURSIVE a AS (SELECT user_id, date_trunc('hour', ts) AS tm, event_id % 2003 AS art, event_id % 3 = 0 AS again, event_id AS place,
                            row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('hour', ts), event_id % 3 = 0, event_id) AS n FROM events),
r AS (SELECT user_id, n, tm, art, place, 'sent' AS verdict, tm AS last, CAST(tm AS DATE) AS day, 1 AS used, [art] AS sent FROM a WHERE n = 1
      UNION ALL SELECT user_id, n, tm, art, place, v, CASE WHEN v = 'sent' THEN tm ELSE last END, CASE WHEN v = 'sent' THEN CAST(tm AS DATE) ELSE day END,
                       CASE WHEN v <> 'sent' THEN used WHEN day = CAST(tm AS DATE) THEN used + 1 ELSE 1 END, CASE WHEN v = 'sent' THEN list_append(sent, art) ELSE sent END
      FROM (SELECT a.user_id, a.n, a.tm, a.art, a.place, r.last, r.day, r.used, r.sent,
                   CASE WHEN list_contains(r.sent, a.art) THEN 'already sent' WHEN CASE WHEN r.day = CAST(a.tm AS DATE) THEN r.used ELSE 0 END >= 2 THEN 'cap'
                        WHEN epoch(a.tm) - epoch(r.last) < 10800 AND NOT (a.tm = r.last AND NOT a.again) THEN 'cooldown' ELSE 'sent' END AS v
            FROM r JOIN a ON a.user_id = r.user_id AND a.n = r.n + 1))
"""


def _attempts(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("user_id", "date_trunc('HOUR', ts) AS round_at", "event_id % 2003 AS article_id", "event_id % 3 = 0 AS reissue", "event_id AS place")


@query(_PACED + "SELECT user_id, place, art AS article_id, verdict FROM r")
def gte03_paced_rounds(spark, sf_dir):
    """Events as offers of articles to readers in hourly rounds, a cooldown of three hours and two a day."""
    return pacing.paced_rounds(_attempts(spark, sf_dir), cooldown_minutes=180, per_day=2).select("user_id", "place", "article_id", "verdict")


@query(_PACED + "SELECT strftime(tm, '%Y-%m-%d %H') AS round, art AS article_id, bool_or(verdict IN ('cap', 'cooldown')) AS keep, bool_or(verdict = 'sent') AS delivered FROM r GROUP BY 1, 2")
def gte04_settled_rounds(spark, sf_dir):
    """After each round, which articles stay booked for some reader and which marks are cleared."""
    done = pacing.settled(pacing.paced_rounds(_attempts(spark, sf_dir), cooldown_minutes=180, per_day=2))
    return done.select(F.date_format("round_at", "yyyy-MM-dd HH").alias("round"), "article_id", "keep", "delivered")


@query(
    """
WITH RECURSIVE a AS (SELECT user_id, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, CASE event_type WHEN 'view' THEN 200 WHEN 'purchase' THEN 200 WHEN 'click' THEN 304 WHEN 'error' THEN 404 ELSE 500 END AS status,
                            CASE WHEN event_type = 'view' THEN 'e' || (event_id % 3) END AS etag, props AS body FROM events),
r AS (SELECT user_id, n, seq, status, CAST(NULL AS VARCHAR) AS sent, CAST(NULL AS VARCHAR) AS had, CASE WHEN status = 200 THEN body END AS used, CASE WHEN status = 200 AND etag IS NOT NULL THEN etag END AS tag,
             CASE WHEN status = 200 AND etag IS NOT NULL THEN body END AS kept, CASE WHEN status = 200 AND etag IS NOT NULL THEN 1 ELSE 0 END AS version, etag FROM a WHERE n = 1
      UNION ALL SELECT a.user_id, a.n, a.seq, a.status, r.tag, r.kept, CASE a.status WHEN 200 THEN a.body WHEN 304 THEN r.kept END,
                       CASE WHEN a.status = 200 AND a.etag IS NOT NULL THEN a.etag ELSE r.tag END, CASE WHEN a.status = 200 AND a.etag IS NOT NULL THEN a.body ELSE r.kept END,
                       r.version + CASE WHEN a.status = 200 AND a.etag IS NOT NULL AND (r.tag IS NULL OR r.tag <> a.etag OR r.kept <> a.body) THEN 1 ELSE 0 END, a.etag
      FROM r JOIN a ON a.user_id = r.user_id AND a.n = r.n + 1)
SELECT user_id, seq, sent AS sent_etag, CASE WHEN status = 200 AND etag IS NOT NULL THEN 'stored' WHEN status = 200 THEN 'fresh' WHEN status = 304 AND had IS NOT NULL THEN 'replayed' WHEN status = 304 THEN 'empty' WHEN status = 404 THEN 'missing' ELSE 'error' END AS outcome,
       used, status <> 304 AS metered, CAST(version AS BIGINT) AS version FROM r
"""
)
def src11_replay(spark, sf_dir):
    """Events as answers of addresses: what is stored, replayed for a 304, or empty."""
    status = F.element_at(F.create_map(*map(F.lit, ("view", 200, "purchase", 200, "click", 304, "error", 404, "signup", 500))), F.col("event_type"))
    answers = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("url"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), status.alias("status"), F.expr("CASE WHEN event_type = 'view' THEN concat('e', event_id % 3) END AS etag"), F.col("props").alias("body"))
    return conditional.replay(answers).select(F.col("url").cast("long").alias("user_id"), "seq", "sent_etag", "outcome", "used", "metered", "version")


@query(
    "WITH RECURSIVE " + ARTICLES + """,
b AS (SELECT source_name AS l, title AS t, row_number() OVER (PARTITION BY source_name ORDER BY id) AS n FROM art WHERE title <> ''),
r(l, n, cur, pend, msg, m) AS (
  SELECT l, CAST(1 AS BIGINT), CAST('' AS VARCHAR), t, CAST(NULL AS VARCHAR), 0 FROM b WHERE n = 1
  UNION ALL
  SELECT r.l, CASE WHEN k = 'B' THEN r.n + 1 ELSE r.n END, CASE k WHEN 'B' THEN CASE WHEN r.cur = '' THEN r.pend ELSE r.cur || chr(10) || chr(10) || r.pend END ELSE '' END,
         CASE k WHEN 'A' THEN substr(r.pend, 121) WHEN 'B' THEN b.t ELSE r.pend END, CASE k WHEN 'A' THEN substr(r.pend, 1, 120) WHEN 'B' THEN NULL ELSE r.cur END, r.m + CASE WHEN k = 'B' THEN 0 ELSE 1 END
  FROM (SELECT *, CASE WHEN pend IS NULL THEN 'D' WHEN cur = '' AND length(pend) > 120 THEN 'A' WHEN cur = '' OR length(cur) + 2 + length(pend) <= 120 THEN 'B' ELSE 'C' END AS k FROM r WHERE pend IS NOT NULL OR cur <> '') r
  LEFT JOIN b ON b.l = r.l AND b.n = r.n + 1)
SELECT l AS list_id, m AS message, '<' || chr(10) || chr(10) || msg AS text FROM r WHERE msg IS NOT NULL
"""
)
def fmt02_messages(spark, sf_dir):
    """The titles of each source, by id, dealt into messages of 123 units with a header."""
    blocks = articles(spark, sf_dir).select(F.col("source_name").alias("list_id"), F.col("id").alias("place"), F.col("title").alias("text"))
    return messages.split_messages(blocks, limit=123, header="<")
