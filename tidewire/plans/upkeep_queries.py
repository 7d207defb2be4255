"""Registered queries: repairs of columns, readers and their audits, the health report, offers written back."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import present
from ..functions import present, terms
from ..operators import classify, offers, rounds, similar, upkeep
from ..operators.feed import at
from ..sources import state
from ..sources.shared import written
from .articles import ARTICLES, LEDGER, articles, clock, ledger, table
from .registry import SQL, query
from .vocabulary_queries import _OFFERS

W = "WITH " + ARTICLES
NOW = datetime(2024, 1, 30, 12)


@query(W + ", t AS (SELECT id, title, regexp_extract(title, '(?i)(?:(?:\\bthe [a-z]+)|(?:\\bversion\\b))', 0) AS hit FROM art) SELECT t.id, CASE WHEN regexp_matches(t.title, '(?i)(?:(?:\\bund\\b)|(?:^die))') OR hit = '' THEN NULL ELSE hit END AS trigger, regexp_matches(source_name, '(?i)(?:(?:src1[0-4]))') AS blocked_source FROM t JOIN art ON art.id = t.id")
def flt09_event_trigger(spark, sf_dir):
    found = upkeep.event_trigger(articles(spark, sf_dir), [r"\bthe [a-z]+", r"\bversion\b"], exclude=[r"\bund\b", "^die"], blocked=["src1[0-4]"])
    return found.select("id", "trigger", "blocked_source")


@query()
def flt10_cut_summaries(spark, sf_dir):
    """Summaries cut in a word, cut anew from the content; a test has the cases."""
    art = articles(spark, sf_dir).withColumns({"pipeline": F.when(F.col("id") % 3 > 0, "rule").otherwise("ai"), "summary": F.substring(F.regexp_replace("content", r"\s+", " "), 1, 160)})
    return upkeep.recut_summaries(art, as_of=at(clock(spark, sf_dir)), hours=2400).select("id", "summary")


@query(W + ", f AS (SELECT * FROM art, clock WHERE is_processed AND NOT is_archived AND published_at >= as_of - INTERVAL 240 HOUR AND length(content) < 600 ORDER BY final_score DESC, id DESC LIMIT 30) SELECT id FROM f WHERE id % 3 <> 0 ORDER BY final_score DESC, id DESC LIMIT 10")
def flt11_requeue_stubs(spark, sf_dir):
    art = articles(spark, sf_dir).withColumn("enriched", F.when(F.col("id") % 3 == 0, False))
    return upkeep.requeue_stubs(art, as_of=at(clock(spark, sf_dir)), hours=240, limit=10)


@query(W + "SELECT id FROM art WHERE summary_zh IS NOT NULL AND length(content) >= 600 AND id % 3 = 0 AND id % 12 <> 0 ORDER BY id DESC LIMIT 200")
def flt12_stale_translations(spark, sf_dir):
    art = articles(spark, sf_dir).withColumns({"enriched": F.col("id") % 3 == 0, "translation_reset": F.col("id") % 12 == 0})
    return upkeep.stale_translations(art)


@query(
    f"WITH f AS ({SQL['off02_offer_spans']}), a AS (SELECT doc_id AS id, doc_id % 9 = 0 AS was, CASE doc_id % 3 WHEN 0 THEN 'Hosting' WHEN 1 THEN 'Editor' ELSE 'Search' END AS old FROM documents) "
    "SELECT a.id, f.tool IS NOT NULL AS is_free_offer, f.tool AS free_tool, f.kind AS free_kind, coalesce(f.confidence, CAST(0 AS DOUBLE)) AS free_confidence, (f.tool IS NOT NULL) <> a.was OR (f.tool IS NOT NULL AND f.tool <> a.old) AS changed FROM a LEFT JOIN f ON f.id = a.id"
)
def off03_annotate_offers(spark, sf_dir):
    """What the detector finds in every article is written back, and what it doesn't find is cleared."""
    art = articles(spark, sf_dir)
    found = written(_found(spark, art))
    kinds = found.select("id", F.col("kind").alias("free_kind"))
    return rounds.normalized_offers(art, found).join(kinds, "id", "left").select("id", "is_free_offer", "free_tool", "free_kind", "free_confidence", "changed")


def _found(spark, art):
    words = spark.createDataFrame([(term, role, name, rank, kind, strong, place) for place, (role, term, name, rank, kind, strong) in enumerate(_OFFERS)], offers.ROLES)
    return offers.detect_offers(art, words, friends=["with the"], body_limit=2500)  # as the SQL has it


@query(f"WITH x AS ({SQL['off03_annotate_offers']}), b AS (SELECT doc_id AS id, doc_id % 13 = 0 AS away FROM documents) SELECT count(*) AS checked, count(*) FILTER (WHERE changed) AS changed FROM x JOIN b ON b.id = x.id WHERE NOT away")
def flt13_backfill_offers(spark, sf_dir):
    """How many articles that aren't archived the detector of today marks otherwise than they are."""
    art = articles(spark, sf_dir).filter("NOT is_archived")
    return rounds.normalized_offers(art, _found(spark, art)).agg(F.count("*").alias("checked"), F.count_if("changed").alias("changed"))


_CUSTOMERS = "SELECT c_custkey AS user_id, 'topic' AS kind, lower(c_mktsegment) AS value, CAST(1 + c_custkey % 3 AS DOUBLE) AS weight FROM customer UNION ALL SELECT c_custkey, 'nation', 'n' || c_nationkey, CAST(1 AS DOUBLE) FROM customer UNION ALL SELECT c_custkey, 'topic', lower(c_mktsegment), CAST(0.5 AS DOUBLE) FROM customer WHERE c_custkey % 2 = 0"


def _wishes(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    own = c.selectExpr("c_custkey AS user_id", "'Topic' AS kind", "concat(' ', c_mktsegment) AS value", "CAST(1 + c_custkey % 3 AS DOUBLE) AS weight")
    own = own.unionByName(c.selectExpr("c_custkey AS user_id", "'nation' AS kind", "concat('N', c_nationkey) AS value", "CAST(NULL AS DOUBLE) AS weight"))
    return own.unionByName(c.filter("c_custkey % 2 = 0").selectExpr("c_custkey AS user_id", "'topic' AS kind", "lower(c_mktsegment) AS value", "CAST(0.5 AS DOUBLE) AS weight"))


@query(f"WITH w AS (SELECT user_id, kind, value, max(weight) AS weight FROM ({_CUSTOMERS}) GROUP BY 1, 2, 3) SELECT kind, value, round(avg(weight), 6) AS weight, count(*) AS readers FROM w GROUP BY 1, 2 ORDER BY readers DESC, weight DESC, kind, value LIMIT 20")
def agg14_interest_payload(spark, sf_dir):
    return upkeep.interest_payload(_wishes(spark, sf_dir), limit=20)


@query(
    "SELECT c_custkey AS user_id, '{\"user_id\":' || c_custkey || ',\"name\":\"' || c_name || '\",\"paused\":' || CASE WHEN c_custkey % 7 = 0 THEN 'true' ELSE 'null' END || ',\"interests\":{\"nation\":[\"n' || c_nationkey || '\"],\"topic\":[\"' || lower(c_mktsegment) || '\"]}}' AS doc FROM customer"
)
def usr04_user_view(spark, sf_dir):
    """Customers as readers, with what they wish for."""
    readers = table(spark, sf_dir, "customer").selectExpr("c_custkey AS user_id", "c_name AS name", "CASE WHEN c_custkey % 7 = 0 THEN true END AS paused")
    return upkeep.reader_views(readers, _wishes(spark, sf_dir))


@query(
    "WITH s AS (SELECT c_custkey AS k, c_name AS name, c_mktsegment AS zone FROM customer WHERE c_custkey % 2 = 0), n AS (SELECT o_custkey AS k, arg_max(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus || o_orderkey END, o_orderkey) FILTER (WHERE o_orderkey % 3 <> 0) AS name, arg_max(o_orderpriority, o_orderkey) AS zone FROM orders GROUP BY 1) "
    "SELECT coalesce(s.k, n.k) AS user_id, coalesce(n.name, s.name) AS name, coalesce(n.zone, s.zone) AS zone FROM s FULL JOIN n ON s.k = n.k"
)
def usr01_upsert_users(spark, sf_dir):
    """Orders as changes of customers: the last that gives a field counts."""
    stored = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").selectExpr("c_custkey AS user_id", "c_name AS name", "c_mktsegment AS zone")
    changes = table(spark, sf_dir, "orders").selectExpr("o_custkey AS user_id", "CASE WHEN o_orderkey % 3 <> 0 THEN concat(o_orderstatus, o_orderkey) END AS name", "o_orderpriority AS zone", "o_orderkey AS at")
    return upkeep.upsert_readers(stored, changes, fields=("name", "zone"))


@query("SELECT n_nationkey AS user_id FROM nation WHERE n_regionkey = 2")
def usr03_chat_ids(spark, sf_dir):
    """The nations of a region as allowlist, customers' nations as known readers: only the listed are written to."""
    allow = table(spark, sf_dir, "nation").filter("n_regionkey = 2").selectExpr("n_nationkey AS user_id", "-n_nationkey AS place")
    return upkeep.reader_ids(allow, table(spark, sf_dir, "customer").selectExpr("c_nationkey AS user_id"))


@query("SELECT e.event_id, e.user_id FROM events e WHERE e.user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def gte08_allowed(spark, sf_dir):
    allow = table(spark, sf_dir, "customer").filter("c_acctbal > 0").selectExpr("c_custkey AS user_id")
    return upkeep.allowed(table(spark, sf_dir, "events"), allow).select("event_id", "user_id")


@query("SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS first_id FROM events GROUP BY 1, 2")
def gte07_warn_once(spark, sf_dir):
    once = upkeep.warn_once(table(spark, sf_dir, "events"), key=("user_id", "event_type"), order=("ts", "event_id"))
    return once.select("user_id", "event_type", F.col("event_id").alias("first_id"))


_ZONE = "CASE c_custkey % 3 WHEN 0 THEN 'UTC' WHEN 1 THEN 'Asia/Tokyo' ELSE 'America/New_York' END"


@query(
    "WITH " + LEDGER + f", u AS (SELECT CAST(c_custkey AS BIGINT) AS user_id, {_ZONE} AS zone FROM customer), l AS (SELECT u.user_id, count(*) AS used FROM led JOIN u ON u.user_id = led.user_id WHERE kind = 'view' AND CAST(timezone(zone, timezone('UTC', created_at)) AS DATE) = CAST(timezone(zone, timezone('UTC', TIMESTAMP '2024-01-30 12:00:00')) AS DATE) GROUP BY 1) "
    'SELECT u.user_id, coalesce(used, 0) AS used, greatest(0, 1 - coalesce(used, 0)) AS "left" FROM u LEFT JOIN l ON l.user_id = u.user_id'
)
def gte06_quota(spark, sf_dir):
    readers = table(spark, sf_dir, "customer").selectExpr("CAST(c_custkey AS BIGINT) AS user_id", f"{_ZONE} AS zone")
    return upkeep.quota(readers, ledger(spark, sf_dir), now=at(NOW), kind="view", per_day=1)


_AUDIT = "WITH " + LEDGER + f"""
, u AS (SELECT CAST(c_custkey AS BIGINT) AS user_id, {_ZONE} AS zone, c_custkey % 7 = 0 AS paused, c_custkey % 5 <> 0 AS view_on, CASE WHEN c_custkey % 2 = 0 THEN '06:00' ELSE '23:30' END AS view_at, true AS click_on, '12:00' AS click_at FROM customer),
k AS (SELECT user_id, zone, paused, 'view' AS kind, view_on AS "on", view_at AS due FROM u UNION ALL SELECT user_id, zone, paused, 'click', click_on, click_at FROM u),
s AS (SELECT user_id, kind, max(created_at) AS last, count(*) FILTER (WHERE created_at >= TIMESTAMP '2024-01-28 12:00:00') AS n FROM led GROUP BY 1, 2),
x AS (SELECT k.*, s.last, coalesce(s.n, 0) AS n, timezone(zone, timezone('UTC', last)) AS here, timezone(zone, timezone('UTC', TIMESTAMP '2024-01-30 12:00:00')) AS now FROM k LEFT JOIN s ON s.user_id = k.user_id AND s.kind = k.kind),
t AS (SELECT user_id, string_agg(line, '|' ORDER BY ts) AS tail FROM (SELECT user_id, ts, 'sent ' || event_id AS line, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn FROM events WHERE event_type = 'purchase') WHERE rn <= 2 GROUP BY 1)
SELECT x.user_id, kind, n, CASE WHEN paused THEN 'paused' WHEN NOT "on" THEN 'off' WHEN last IS NULL THEN 'never' WHEN CAST(here AS DATE) = CAST(now AS DATE) THEN 'delivered today' WHEN strftime(now, '%H:%M') >= due THEN 'overdue' ELSE 'pending' END AS verdict,
       strftime(here, '%m-%d %H:%M:%S') AS last_local, coalesce(tail, '') AS tail FROM x LEFT JOIN t ON t.user_id = x.user_id
"""


@query(_AUDIT)
def gte09_jn11_delivery_audit(spark, sf_dir):
    """Customers as readers in three zones: two kinds of push against the ledger, with the sender's last lines."""
    readers = table(spark, sf_dir, "customer").selectExpr("CAST(c_custkey AS BIGINT) AS user_id", f"{_ZONE} AS zone", "c_custkey % 7 = 0 AS paused", "c_custkey % 5 <> 0 AS view_on", "CASE WHEN c_custkey % 2 = 0 THEN '06:00' ELSE '23:30' END AS view_at", "true AS click_on", "'12:00' AS click_at")
    logs = table(spark, sf_dir, "events").filter("event_type = 'purchase'").selectExpr("user_id", "ts AS at", "concat('sent ', event_id) AS line")
    audit = upkeep.delivery_audit(readers, ledger(spark, sf_dir), logs, now=at(NOW), kinds=("view", "click"), tail=2)
    return audit.withColumn("tail", F.array_join("tail", "|"))


@query()
def enr01_enrich(spark, sf_dir):
    """Short documents get the body of their page where it is longer; a test holds the whole table to a loop."""
    pages = similar.strip_pages(table(spark, sf_dir, "pages").withColumn("url", F.concat(F.lit("u"), "page_id"))).select("url", "body")
    art = articles(spark, sf_dir).withColumns({"url": F.concat(F.lit("u"), "id"), "enriched": F.lit(None).cast("boolean")})
    return upkeep.enrich(art, pages).select("id", F.length("content").alias("chars"), "enriched", F.col("summary_zh").isNotNull().alias("translated"))


@query(
    "WITH " + ARTICLES + """, e AS (SELECT TIMESTAMP '2024-01-30 12:00:00' AS now),
o AS (SELECT count(*) AS n, coalesce(max(date_sub('second', created_at, as_of) / CAST(3600 AS DOUBLE)), 0) AS oldest FROM art, clock WHERE NOT is_processed AND NOT is_archived),
s AS (SELECT s_suppkey % 11 AS n, s_name AS name, s_suppkey % 13 <> 0 AS on_ FROM supplier),
d AS (SELECT arg_max(CAST(l_quantity AS INTEGER) * 100, (l_shipdate, l_orderkey, l_linenumber)) AS free FROM lineitem),
x AS (SELECT 'backlog' AS "check", CASE WHEN oldest >= 6 THEN 'warning' ELSE 'info' END AS level, n FROM o
      UNION ALL SELECT CASE WHEN n >= 5 THEN 'failing' ELSE 'blip' END, CASE WHEN n >= 5 THEN 'warning' ELSE 'info' END, n FROM s WHERE n > 0 AND on_
      UNION ALL SELECT 'parked', 'info', CAST(greatest(1, ceil(date_sub('second', now, ts + INTERVAL 30 MINUTE) / CAST(60 AS DOUBLE))) AS BIGINT) FROM events, e WHERE event_type = 'error' AND ts + INTERVAL 30 MINUTE > now)
SELECT "check", level, n FROM x UNION ALL SELECT 'parked', 'info', 0 WHERE NOT EXISTS (SELECT 1 FROM x WHERE "check" = 'parked') UNION ALL SELECT 'disk', 'info', 0
UNION ALL SELECT 'failing', 'info', 0 WHERE NOT EXISTS (SELECT 1 FROM x WHERE "check" = 'failing')"""
)
def ops01_health(spark, sf_dir):
    """One report: the articles' backlog, suppliers as sources, errors as hosts that asked for quiet, no disk samples."""
    sources = table(spark, sf_dir, "supplier").selectExpr("s_name AS name", "s_suppkey % 13 <> 0 AS enabled", "CAST(s_suppkey % 11 AS INT) AS error_count", "'HTTP 500' AS last_error")
    hosts = table(spark, sf_dir, "events").filter("event_type = 'error'").selectExpr("concat('host', event_id) AS host", "ts + INTERVAL 30 MINUTES AS until")
    disks = table(spark, sf_dir, "lineitem").filter("l_quantity < 0").selectExpr("l_shipdate AS at", "CAST(l_quantity AS INT) AS free_mb")
    art, now = articles(spark, sf_dir), clock(spark, sf_dir)
    own = upkeep.health(art, sources.limit(0), disks, hosts.limit(0), now=at(now)).filter("check = 'backlog'")
    rest = upkeep.health(art.limit(0), sources, disks, hosts, now=at(NOW)).filter("check <> 'backlog'")
    return own.unionByName(rest).select("check", "level", "n")


@query("WITH w AS (SELECT lower(c_mktsegment) AS name, arg_max(CAST(c_custkey % 10 AS DOUBLE), c_custkey) AS weight FROM customer GROUP BY 1) SELECT name, weight / (SELECT sum(weight) FROM w WHERE weight > 0) AS weight FROM w WHERE weight > 0")
def cfgx2_weights(spark, sf_dir):
    """Segments as weights, the last customer's number each, brought to a sum of one."""
    named = table(spark, sf_dir, "customer").selectExpr("c_mktsegment AS name", "CAST(c_custkey % 10 AS DOUBLE) AS weight", "c_custkey AS place")
    return upkeep.weights(named)


@query("SELECT e.event_id FROM events e WHERE user_id % 3 <> 0 OR contains(' ' || lower(event_type || '. ' || props) || ' ', ' view') OR contains(' ' || lower(event_type || '. ' || props) || ' ', 'view ')")
def src18_wants_keyword(spark, sf_dir):
    """Every third user is a firehose, of which only events that name a view pass."""
    items = table(spark, sf_dir, "events").selectExpr("event_id", "CAST(user_id AS STRING) AS source_name", "event_type AS title", "props AS content")
    sources = items.select(F.col("source_name").alias("name")).distinct().withColumn("firehose", F.col("name").cast("long") % 3 == 0)
    return upkeep.wants_keyword(items, sources, ["view"]).select("event_id")


@query("SELECT s_suppkey, CAST(CASE WHEN s_suppkey % 12 = 0 THEN 0 ELSE least(3600, 30 * pow(2, s_suppkey % 12 - 1)) END AS BIGINT) AS wait FROM supplier")
def src18_backoff(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", upkeep.backoff(F.col("s_suppkey") % 12).alias("wait"))


@query(
    W + ", d AS (SELECT id, coalesce(replace(title_zh, 't1', 'T1'), title) AS t, substr(content, 1, 200) AS own, summary_zh FROM art), "
    "m AS (SELECT id, regexp_replace(regexp_replace(t, '[A-Za-z0-9._%+-]+@([A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+)', '***@\\1', 'g'), '\\b(sk|ghp|xoxb)[-_][A-Za-z0-9_-]{8,}', '\\1-***', 'g') AS t, summary_zh FROM d) "
    "SELECT id, t AS display_title, summary_zh IS NOT NULL AND id % 4 = 0 AS translated, CASE WHEN summary_zh IS NOT NULL AND id % 4 = 0 THEN '中' || summary_zh ELSE t END AS display_line FROM m"
)
def prj02_display(spark, sf_dir):
    art = articles(spark, sf_dir).withColumns({"summary_zh": F.when(F.col("id") % 4 == 0, F.concat(F.lit("中"), "summary_zh")).otherwise(F.col("summary_zh")), "summary": F.substring("content", 1, 200), "points": F.array("title"), "points_zh": F.lit(None).cast("array<string>")})
    shown = present.display(art, senses=[("(?s).*", "t1", "T1")])
    return shown.select("id", "display_title", F.col("translated_summary").isNotNull().alias("translated"), "display_line")


@query(W + "SELECT id, '{\"id\":' || id || ',\"source_name\":\"' || source_name || '\",\"published_at\":\"' || strftime(published_at, '%Y-%m-%dT%H:%M') || '\",\"is_sent\":' || coalesce(CAST(is_sent AS VARCHAR), 'null') || ',\"event_id\":' || coalesce(CAST(event_id AS VARCHAR), 'null') || '}' AS doc, strftime(timezone('Asia/Tokyo', timezone('UTC', published_at)), '%m-%d %H:%M') AS shown FROM art")
def prj03_to_dict(spark, sf_dir):
    art = articles(spark, sf_dir)
    return art.select("id", present.as_json(art, ["id", "source_name", "published_at", "is_sent", "event_id"]).alias("doc"), present.local_time(F.col("published_at"), "Asia/Tokyo").alias("shown"))


@query(
    "WITH t AS (SELECT conv_id, turn, lower(coalesce(text, '')) AS low, [w FOR w IN string_split_regex(regexp_replace(coalesce(text, ''), '(?i)[^\\p{L}\\p{N}_\\s.\\-]|please|tell me|show me|news about', ' ', 'g'), '\\s+') IF length(w) >= 2] AS terms FROM conversations), "
    "i AS (SELECT *, regexp_matches(low, 'summary|in detail|analysis') AND regexp_matches(low, '\\b(no\\.?|number|item)\\s*[1-9][0-9]?\\b') AS more, regexp_matches(low, '[?？]|what|which|how|why|today|yesterday|this week|latest|recent') AS asks FROM t) "
    "SELECT conv_id, turn, CASE WHEN more THEN 'summarize' WHEN regexp_matches(low, 'setting|timezone|mute|interest|notify') OR (contains(low, 'follow') AND NOT asks) THEN 'settings' WHEN regexp_matches(low, 'source|status') THEN 'sources' WHEN regexp_matches(low, 'help|what can you do') THEN 'help' WHEN len(terms) = 0 THEN 'latest' ELSE 'search' END AS intent, "
    "CASE WHEN more OR regexp_matches(low, 'setting|timezone|mute|interest|notify|source|status|help|what can you do') OR (contains(low, 'follow') AND NOT asks) THEN 14 WHEN contains(low, 'today') THEN 1 WHEN contains(low, 'yesterday') THEN 2 WHEN contains(low, 'this week') THEN 7 WHEN regexp_matches(low, 'latest|recent') THEN 3 ELSE 14 END AS days FROM i"
)
def sch05_rule_intent(spark, sf_dir):
    return classify.rule_intent(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "intent", "days")


_TERMS = ["the", "of the", "and", "token"]
_PROTECT = r"(?:of the|token|and|the)"


@query(
    W + rf", p AS (SELECT id, title, regexp_extract_all(title, '\b{_PROTECT}\b(?: +{_PROTECT}\b)*') AS k FROM art) "
    "SELECT id, CAST(least(len(k), 35) AS INTEGER) AS kept, coalesce(k[1], '') AS first, title AS restored, len(k) = 0 OR id % 2 = 0 AS intact FROM p"
)
def trl01_protect_terms(spark, sf_dir):
    """Terms go out as marks and come back; of every second text a mark is lost on the way, which must be seen."""
    guarded = articles(spark, sf_dir).select("id", terms.protect_terms(F.col("title"), _TERMS).alias("p"))
    came = F.when(F.col("id") % 2 == 0, F.col("p.text")).otherwise(F.replace(F.col("p.text"), F.lit(terms.PLACEHOLDERS[0]), F.lit("")))
    return guarded.select("id", F.size("p.kept").alias("kept"), F.coalesce(F.get("p.kept", F.lit(0)), F.lit("")).alias("first"), terms.restore_terms(F.col("p.text"), F.col("p.kept")).alias("restored"), terms.kept_intact(came, F.col("p.kept")).alias("intact"))


@query()
def sch08_offer_search(spark, sf_dir):
    """The first words of the benchmark's items, and the tools' names, as queries for offers; a test has every kind of answer."""
    art, words = articles(spark, sf_dir), spark.createDataFrame([(term, role, name, rank, kind, strong, place) for place, (role, term, name, rank, kind, strong) in enumerate(_OFFERS)], offers.ROLES)
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.expr("concat_ws(' ', CASE item_id % 4 WHEN 0 THEN 'version' WHEN 1 THEN '90' END, CASE WHEN item_id % 4 > 1 THEN split_part(text, ' ', 2) END)").alias("query"))
    aliases = queries.limit(0).select(F.col("query_id").alias("group_id"), F.col("query").alias("word"))
    return offers.offers_for(queries, art, words, aliases, as_of=at(clock(spark, sf_dir)), friends=["with the"])


@query(_AUDIT.replace("SELECT x.user_id, kind, n,", "SELECT x.user_id, kind, n, length(coalesce(tail, '')) > 0 AS logged,").replace(", coalesce(tail, '') AS tail FROM x", " FROM x"))
def jn11_audit_with_logs(spark, sf_dir):
    """The same audit, with whether the sender's log knows the reader."""
    return gte09_jn11_delivery_audit(spark, sf_dir).withColumn("logged", F.col("tail") != "").drop("tail")


@query(
    "WITH v AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]{4,}')[1:6])) AS w FROM benchmark), m AS (SELECT conv_id * 100000 + turn AS id, string_split_regex(lower(coalesce(text, '')), '[,，、;；\\n]') AS ps FROM conversations WHERE role = 'user'), "
    "p AS (SELECT id, unnest(range(0, len(ps))) AS n, unnest(ps) AS part FROM m), h AS (SELECT id, n, CASE WHEN regexp_matches(part, 'the|without') THEN 'exclude' ELSE 'topic' END AS type, w AS value FROM p JOIN v ON contains(part, w)), "
    "f AS (SELECT id, type, value, min(n) AS n FROM h GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n, length(value) DESC, value, type) AS place FROM f) SELECT id, CAST(place AS INTEGER) AS place, type, value FROM r WHERE place <= 20"
)
def sch09_rule_interests(spark, sf_dir):
    """What users' messages ask for and exclude, by the first words of the benchmark's items as a vocabulary."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.slice(F.regexp_extract_all("text", F.lit("([A-Za-z]{4,})"), F.lit(1)), 1, 6)).alias("word"))
    said = table(spark, sf_dir, "conversations").filter("role = 'user'").selectExpr("conv_id * 100000 + turn AS id", "text")
    return upkeep.rule_interests(said, words, refusals="the|without")


@query(
    "WITH a AS (SELECT 'https://h' || (user_id % 40) || '.example/x' AS url, 'h' || (user_id % 40) || '.example' AS host, ts, least(greatest(event_id * 7 % 90000, 30), 21600) AS wait FROM events), "
    "l AS (SELECT host, arg_max(wait, (ts, wait)) AS wait, max(ts) AS at_ FROM a GROUP BY 1), u AS (SELECT host, at_ + to_seconds(wait) AS til FROM l) SELECT host, strftime(til, '%Y-%m-%d %H:%M') AS until FROM u WHERE til > TIMESTAMP '2024-01-30 12:00:00'"
)
def src13_parked_hosts(spark, sf_dir):
    """Events as refusals of forty hosts: who still has the quiet that they asked for."""
    asks = table(spark, sf_dir, "events").selectExpr("concat('https://h', user_id % 40, '.example/x') AS url", "ts AS at", "event_id * 7 % 90000 AS seconds")
    return state.cooldowns(asks, now=at(NOW)).select("host", F.date_format("until", "yyyy-MM-dd HH:mm").alias("until"))
