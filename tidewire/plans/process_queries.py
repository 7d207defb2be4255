"""Registered query: a whole round of processing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classify, process, reconcile
from ..operators.feed import at
from .articles import articles, clock, table
from .registry import query
from .text_queries import _TAXONOMY, AGE, KEYWORDS, NOV, W, _category_sql, _D, _PAD

_CATEGORY = _category_sql().removeprefix(W).replace("FROM art)", "FROM a2)")
_CUT = _CATEGORY.index("SELECT id, CASE WHEN m.score > 0")

_ROUND = (
    W
    + ", a2 AS (SELECT * REPLACE (CASE WHEN id % 5 = 0 THEN 'Announcing ' || title ELSE title END AS title) FROM art WHERE NOT is_processed OR id % 2 = 0)"
    + _CATEGORY[:_CUT].rstrip()
    + ", cat AS ("
    + _CATEGORY[_CUT:]
    + f"""), k AS (SELECT id, len(list_concat(list_filter(['the','and','haus','token'], lambda k: contains({_PAD.replace('title', 'tx')}, ' ' || k) OR contains({_PAD.replace('title', 'tx')}, k || ' ')), list_filter(['licens'], lambda k: contains({_PAD.replace('title', 'tx')}, k)))) AS n
  FROM (SELECT id, coalesce(title, '') || '. ' || substr(coalesce(content, ''), 1, 800) AS tx FROM a2)),
v AS (SELECT a2.id, n, tier, heat, source_name, title, {AGE} AS age, CAST({NOV} AS DOUBLE) AS nov, CAST(CASE tier WHEN 'A' THEN 95 WHEN 'B' THEN 80 WHEN 'C' THEN 65 ELSE 45 END AS DOUBLE) AS src, CAST(CASE tier WHEN 'A' THEN 100 WHEN 'B' THEN 100 WHEN 'C' THEN 78 ELSE 68 END AS DOUBLE) AS cap FROM a2 JOIN k ON k.id = a2.id, clock),
p AS (SELECT *, least(heat, 100) AS warm, least({_D(85)}, {_D(28)} + {_D(4.5)} * n + CASE WHEN tier = 'A' THEN 12 ELSE 0 END) AS imp, least({_D(88)}, {_D(32)} + {_D(4.5)} * n) AS rel FROM v),
b AS (SELECT *, imp * {_D(0.35)} + rel * {_D(0.30)} + nov * {_D(0.15)} + src * {_D(0.10)} AS base FROM p),
f AS (SELECT *, floor(greatest({_D(0)}, least(cap, CASE WHEN warm > 0 THEN base + warm * {_D(0.10)} ELSE base / {_D(0.9)} END)) * {_D(10)} + {_D(0.5)}) / {_D(10)} AS score FROM b),
g AS (SELECT *, regexp_matches(source_name, '{classify.NO_SOURCE}') AS crowd, regexp_matches(title, '{classify.EVENT}') AND NOT regexp_matches(title, '{classify.NO_TITLE}') AS event, src < 80 AND heat < 250 AS weak, score < 45 AND heat < 250 AS low FROM f),
h AS (SELECT *, CASE WHEN crowd THEN 'blocked source' WHEN NOT event THEN 'no event' WHEN (weak OR low) AND age <= 400 THEN 'wait for heat' WHEN weak THEN 'weak source' WHEN low THEN 'low score' WHEN age > 400 THEN 'too old' ELSE 'pass' END AS verdict FROM g),
o AS (SELECT *, CASE WHEN n < 1 THEN 'filtered' WHEN id % 17 = 5 AND id % 3 + 1 >= 3 THEN 'abandoned' WHEN id % 17 = 5 THEN 'retry' WHEN verdict = 'pass' THEN 'breaking' WHEN verdict = 'wait for heat' THEN 'watch' ELSE 'processed' END AS outcome FROM h)
SELECT o.id, outcome, CAST(id % 3 + CASE WHEN outcome = 'filtered' THEN 0 ELSE 1 END AS INTEGER) AS attempts, CASE WHEN outcome IN ('retry', 'abandoned') THEN NULL WHEN outcome = 'filtered' THEN 'Other' ELSE coalesce(rule_category, 'Other') END AS category,
       CASE WHEN outcome = 'filtered' THEN CAST(0 AS DOUBLE) WHEN outcome NOT IN ('retry', 'abandoned') THEN score END AS final_score FROM o JOIN cat USING (id)"""
)


@query(_ROUND)
def stm04_process_round(spark, sf_dir):
    """Open articles through gate, category, score, story and alert, with strikes for those that break."""
    pending = articles(spark, sf_dir).filter("NOT is_processed OR id % 2 = 0").withColumn("title", F.expr("CASE WHEN id % 5 = 0 THEN concat('Announcing ', title) ELSE title END"))
    out = process.process(
        pending.withColumn("attempts", F.expr("CAST(id % 3 AS INT)")),
        as_of=at(clock(spark, sf_dir)),
        keywords=KEYWORDS,
        taxonomy=_TAXONOMY,
        broken=F.col("id") % 17 == 5,
        gate={"max_age_hours": 400},
    )
    return out.select("id", "outcome", "attempts", "category", "final_score")


#: Articles with what the repairs look at, by whole-number arithmetic on ids.
_BOOKS = [
    "id", "title", "content", "CASE WHEN id % 9 = 0 THEN 'Trending' ELSE source_name END AS source_name", "CAST(CASE WHEN id % 18 = 0 THEN 0 WHEN id % 27 = 0 THEN NULL ELSE id END AS INT) AS stars", "event_id",
    "filtered_out OR id % 5 = 2 AS filtered_out", "is_processed", "is_archived", "is_sent", "published_at", "created_at", "CASE WHEN id % 4 = 1 THEN NULL ELSE created_at END AS processed_at", "CAST(id % 3 AS INT) AS attempts",
    "CASE WHEN id % 6 = 0 THEN 'known' END AS why_it_matters", "CAST(95 AS DOUBLE) AS source_quality", "final_score", "heat", "CASE WHEN id % 7 = 0 THEN 'event' END AS breaking_reason", "id % 14 = 0 AS deferred", "CASE WHEN id % 21 = 0 THEN 'old' END AS lost_reason",
]


@query(
    W
    + f""", a0 AS (SELECT {', '.join(x.replace('CAST(id % 3 AS INT)', 'CAST(id % 3 AS INTEGER)').replace('id END AS INT)', 'id END AS INTEGER)') for x in _BOOKS)} FROM art),
h AS (SELECT id, len(list_concat(list_filter(['the','haus','token'], lambda k: contains({_PAD.replace('title', 'tx')}, ' ' || k) OR contains({_PAD.replace('title', 'tx')}, k || ' ')), [])) AS n FROM (SELECT id, coalesce(title, '') || '. ' || substr(coalesce(content, ''), 1, 800) AS tx FROM art)),
a1 AS (SELECT a0.*, contains(source_name, 'Trending') AND coalesce(stars = 0, false) AS trash, filtered_out AND NOT is_archived AND published_at >= as_of - INTERVAL 7 DAY AND n > 0 AND NOT (contains(source_name, 'Trending') AND coalesce(stars = 0, false)) AS back
       FROM a0 JOIN h USING (id), clock),
a2 AS (SELECT * REPLACE (CASE WHEN back THEN false WHEN trash THEN true ELSE filtered_out END AS filtered_out, CASE WHEN back THEN false WHEN trash AND NOT filtered_out THEN true ELSE is_processed END AS is_processed,
                         CASE WHEN back THEN NULL ELSE processed_at END AS processed_at, CASE WHEN back THEN 0 ELSE attempts END AS attempts), trash AND NOT filtered_out AS dropped FROM a1),
s AS (SELECT event_id, list_sort(list(DISTINCT source_name)) AS sides FROM a2 WHERE NOT filtered_out AND NOT is_archived AND event_id IS NOT NULL GROUP BY event_id),
m AS (SELECT a2.*, [x FOR x IN coalesce(s.sides, []) IF x <> source_name] AS others FROM a2 LEFT JOIN s ON s.event_id = a2.event_id),
r AS (SELECT *, concat_ws('; ', CASE WHEN len(others) > 0 THEN 'also in ' || array_to_string(others[1:3], ', ') END, CASE WHEN heat >= 125 THEN 'discussed, heat ' || CAST(CAST(heat AS INTEGER) AS VARCHAR) END) AS reason FROM m),
g AS (SELECT *, is_processed AND NOT is_archived AND NOT filtered_out AND why_it_matters IS NULL AND reason <> '' AS told, {AGE} AS age, regexp_matches(source_name, '{classify.NO_SOURCE}') AS crowd, regexp_matches(title, '{classify.EVENT}') AND NOT regexp_matches(title, '{classify.NO_TITLE}') AS event,
             final_score < 45 AND heat < 250 AS low FROM r, clock),
v AS (SELECT *, CASE WHEN crowd THEN 'blocked source' WHEN NOT event THEN 'no event' WHEN low AND age <= 24 THEN 'wait for heat' WHEN low THEN 'low score' WHEN age > 24 THEN 'too old' ELSE 'pass' END AS verdict FROM g),
w AS (SELECT *, NOT coalesce(is_sent, false) AND breaking_reason IS NOT NULL AND NOT deferred AND lost_reason IS NULL AND verdict <> 'pass' AS lost FROM v)
SELECT id, filtered_out, is_processed, attempts, strftime(CASE WHEN is_processed AND processed_at IS NULL THEN created_at ELSE processed_at END, '%Y-%m-%d %H:%M') AS processed_at, CASE WHEN told THEN reason ELSE why_it_matters END AS why_it_matters,
       CASE WHEN lost THEN 'held back, and now: ' || verdict ELSE lost_reason END AS lost_reason,
       concat_ws(',', CASE WHEN back THEN 'regate' END, CASE WHEN dropped THEN 'spam' END, CASE WHEN told THEN 'matters' END, CASE WHEN is_processed AND processed_at IS NULL THEN 'processed' END, CASE WHEN lost THEN 'lost' END) AS notes
FROM w"""
)
def flt14_repaired_books(spark, sf_dir):
    """The articles after all repairs."""
    books = articles(spark, sf_dir).selectExpr(*_BOOKS)
    events = table(spark, sf_dir, "events").select("user_id")
    rows, _, _ = reconcile.reconcile(books, events.distinct(), events, as_of=at(clock(spark, sf_dir)), keywords=["the", "haus", "token"], phantom=-1)
    return rows.select("id", "filtered_out", "is_processed", "attempts", F.date_format("processed_at", "yyyy-MM-dd HH:mm").alias("processed_at"), "why_it_matters", "lost_reason", F.array_join("notes", ",").alias("notes"))
