"""Repairs, audits, queues, presentation and reader state, each with its SQL where there is one."""

from __future__ import annotations


from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import present, text
from ..operators import feed, policy, search, similar
from ..sources import readers
from ..sources.shared import written
from .articles import ARTICLES, articles, clock, table
from .registry import query
from .text_queries import WORDS

W = "WITH " + ARTICLES


@query(W + "SELECT 'regate' AS step, count(*) AS checked, count(*) FILTER (WHERE n_chars < 100) AS would_change FROM art WHERE NOT filtered_out UNION ALL SELECT 'processed', count(*), count(*) FILTER (WHERE final_score = 0) FROM art WHERE is_processed UNION ALL SELECT 'ghost', count(*), count(*) FILTER (WHERE event_id IS NULL) FROM art")
def flt14_reconcile(spark, sf_dir):
    art = articles(spark, sf_dir)
    audit = lambda step, rows, bad: rows.agg(F.lit(step).alias("step"), F.count("*").alias("checked"), F.count_if(bad).alias("would_change"))
    return (
        audit("regate", art.filter("NOT filtered_out"), F.col("n_chars") < 100)
        .unionByName(audit("processed", art.filter("is_processed"), F.col("final_score") == 0))
        .unionByName(audit("ghost", art, F.col("event_id").isNull()))
    )


@query("SELECT 'ERROR net order # is ' || o_orderstatus AS signature, count(*) AS n, strftime(min(o_orderdate), '%Y-%m-%d') AS first, strftime(max(o_orderdate), '%Y-%m-%d') AS last FROM orders WHERE o_orderkey % 2 = 0 GROUP BY o_orderstatus")
def agg15_win07_log_incidents(spark, sf_dir):
    """Orders as log lines: a header for each, and a line after it that belongs to it."""
    head = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit(",000 "), F.when(F.col("o_orderkey") % 2 == 0, "ERROR").otherwise("INFO"), F.lit(" [net] a.py:1 - order "), F.col("o_orderkey"), F.lit(" is "), F.col("o_orderstatus"))
    both = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 50).alias("file"), F.col("o_orderkey").alias("k"), F.posexplode(F.array(head, F.lit("  more"))).alias("p", "line"))
    lines = both.select("file", (F.col("k") * 2 + F.col("p")).alias("line_no"), "line")
    got = readers.log_incidents(readers.log_records(lines))
    return got.select("signature", "n", F.date_format("first", "yyyy-MM-dd").alias("first"), F.date_format("last", "yyyy-MM-dd").alias("last"))


@query(W + f", t AS (SELECT id, list_distinct({WORDS}) AS t FROM art), p AS (SELECT a.id, a.t AS a, b.t AS b FROM t a JOIN t b ON b.id = a.id + 1) SELECT id, CASE WHEN len(a) = 0 OR len(b) = 0 THEN CAST(0 AS DOUBLE) ELSE len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE) END AS jaccard, CASE WHEN len(a) = 0 OR len(b) = 0 THEN CAST(0 AS DOUBLE) ELSE len(list_intersect(a, b)) / CAST(least(len(a), len(b)) AS DOUBLE) END AS coverage FROM p")
def set02_token_sets(spark, sf_dir):
    t = articles(spark, sf_dir).select("id", text.title_tokens(F.col("title")).alias("t"))
    p = t.join(t.select((F.col("id") - 1).alias("id"), F.col("t").alias("u")), "id")
    return p.select("id", text.jaccard(F.col("t"), F.col("u")).alias("jaccard"), text.coverage(F.col("t"), F.col("u")).alias("coverage"))


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)read full topic', '', 'g'), '(?i)[0-9]+ posts? - [0-9]+ participants?', '', 'g'), '(?i)submitted by +/?u/[A-Za-z0-9_-]+', '', 'g'), '(?i)\[(link|comments)\]', '', 'g')) AS text FROM documents")
def str04_strip_boilerplate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", present.strip_boilerplate(F.col("text")).alias("text"))


@query()
def str05_collapse_repeats(spark, sf_dir):
    return articles(spark, sf_dir).select("id", present.collapse_repeats(F.col("title")).alias("title"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?m)^#{1,6} +', '', 'g'), '\[([^\]\[]*)\]\([^)]*\)', '\1', 'g'), '\*\*([^*]+)\*\*', '\1', 'g'), '(?m)^[*+-] +', '', 'g') AS text FROM documents")
def str07_demote_markdown(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", present.demote_markdown(F.col("text")).alias("text"))


@query("SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN '✗ ' || s_name WHEN s_suppkey % 12 = 0 THEN '✓ ' || s_name ELSE '! ' || s_name || ' (' || (s_suppkey % 12) || ')' END AS line FROM supplier")
def fmt04_status_lines(spark, sf_dir):
    n = F.col("s_suppkey") % 12
    line = F.when(F.col("s_acctbal") < 0, F.concat(F.lit("✗ "), "s_name")).when(n == 0, F.concat(F.lit("✓ "), "s_name")).otherwise(F.concat(F.lit("! "), "s_name", F.lit(" ("), n, F.lit(")")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", line.alias("line"))


@query("SELECT doc_id, latin > 8 AND cjk < greatest(3, n * 0.1) AS needed FROM (SELECT doc_id, length(text) AS n, length(text) - length(regexp_replace(text, '[一-鿿]', '', 'g')) AS cjk, length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')) AS latin FROM documents)")
def trl04_needs_translation(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", present.needs_translation(F.col("text")).alias("needed"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'a/b' || p_partkey || ': v1.' || p_size WHEN 1 THEN 'a/b' || p_partkey || ' ★' || p_size ELSE p_name END AS title FROM part")
def trl03_localize_title(spark, sf_dir):
    raw = F.expr("CASE p_partkey % 3 WHEN 0 THEN concat('v1.', p_size, ' released in a/b', p_partkey) WHEN 1 THEN concat('a/b', p_partkey, ' (', p_size, ' stars)') ELSE p_name END")
    return table(spark, sf_dir, "part").select("p_partkey", present.localize_title(raw).alias("title"))


_FLAT = "trim(regexp_replace(regexp_replace(replace(coalesce(content, ''), chr(8203), ''), chr(160), ' ', 'g'), '[ \\t\\r\\f\\x0B]+', ' ', 'g'), ' ')"


@query(
    W + f", s AS (SELECT id, title, [trim(x, ' ') FOR x IN string_split(regexp_replace({_FLAT}, '([.!?。！？])\\s+', '\\1' || chr(1), 'g'), chr(1)) IF length(trim(x, ' ')) >= 30] AS s FROM art), "
    "o AS (SELECT id, title, [x FOR x IN s IF substr(x, 1, 70) <> substr(title, 1, 70)] AS own FROM s), f AS (SELECT *, trim(regexp_replace(own[1], '\\s+', ' ', 'g')) AS flat FROM o), "
    "h AS (SELECT *, substr(flat, 1, 159) AS head, regexp_extract(substr(flat, 1, 159), '^(.*[.!?;,。！？；，])', 1) AS clause FROM f) "
    "SELECT id, CASE WHEN len(own) = 0 THEN title WHEN length(flat) <= 160 THEN flat WHEN length(clause) >= 96 THEN rtrim(regexp_replace(clause, '[.!?;,。！？；，]$', '')) || '…' ELSE rtrim(head) || '…' END AS summary, CAST(least(greatest(len(own) - 1, 0), 2) AS INTEGER) AS points FROM h"
)
def sum01_fallback_summary(spark, sf_dir):
    s = present.fallback_summary(F.col("title"), F.col("content"))
    return articles(spark, sf_dir).select("id", s.alias("s")).select("id", "s.summary", F.size("s.points").alias("points"))


@query(W + "SELECT id, concat_ws(',', source_name, free_tool, CASE WHEN trim(coalesce(category, '')) <> '' AND lower(category) <> lower(free_tool) THEN category END) AS tags FROM art")
def tag02_merge_tags(spark, sf_dir):
    return articles(spark, sf_dir).select("id", F.array_join(present.merge_tags(F.array("source_name", "free_tool"), F.array(F.upper("source_name"), "category")), ",").alias("tags"))


@query("SELECT conv_id, turn, turn + 1 AS position FROM conversations WHERE turn < 99")
def ord01_ordinals(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter("turn < 99")
    said = F.concat(F.lit("第 "), (F.col("turn") + 1).cast("string"), F.lit(" 条"))
    return c.select("conv_id", "turn", present.ordinal(said).cast("long").alias("position"))


@query("SELECT event_id, least(greatest(value, 0), 100) AS score FROM events")
def jsn02_clamp(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", present.clamp_score(F.col("value")).alias("score"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def dt01_parse_date(spark, sf_dir):
    """The order dates written in three formats and read back."""
    raw = F.expr("CASE o_orderkey % 3 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 1 THEN date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") ELSE date_format(o_orderdate, \"EEE, dd MMM yyyy HH:mm:ss 'GMT'\") END")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(readers.parse_date(raw), "yyyy-MM-dd").alias("day"))


@query(W + "SELECT id, greatest(CAST(0 AS DOUBLE), 24 - date_sub('second', published_at, as_of) / CAST(3600 AS DOUBLE)) AS hours_left FROM art, clock")
def dt04_freshness_left(spark, sf_dir):
    age = F.timestamp_diff("SECOND", F.col("published_at"), feed.at(clock(spark, sf_dir))) / 3600.0
    return articles(spark, sf_dir).select("id", F.greatest(F.lit(0.0), 24 - age).alias("hours_left"))


@query("SELECT event_id, CASE WHEN m < 480 THEN 480 WHEN m < 720 THEN 720 WHEN m < 1260 THEN 1260 ELSE 480 END AS slot FROM (SELECT event_id, hour(ts) * 60 + minute(ts) AS m FROM events)")
def dt06_next_slot(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", present.next_slot(policy.minute_of_day(F.col("ts"), "UTC"), [480, 720, 1260]).alias("slot"))


@query("SELECT l_partkey, date_diff('day', CAST(min(l_shipdate) AS DATE), DATE '1999-01-01') AS days FROM lineitem GROUP BY 1")
def dt07_days_free(spark, sf_dir):
    first = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.min("l_shipdate").alias("f"))
    return first.select("l_partkey", F.datediff(F.lit("1999-01-01").cast("date"), F.to_date("f")).cast("long").alias("days"))


@query(W + ", h AS (SELECT id, lower(concat_ws(chr(10), title, content, title_zh, summary_zh)) AS hay FROM art), w AS (SELECT id, CASE WHEN contains(hay, 'the and') THEN 3 ELSE 0 END + CASE WHEN contains(hay, 'the') THEN 2 ELSE 0 END + CASE WHEN contains(hay, 'and') THEN 2 ELSE 0 END AS weight, CAST(contains(hay, 'the') OR contains(hay, 'token') AS INTEGER) + CAST(contains(hay, 'and') OR contains(hay, 'license') AS INTEGER) AS touched FROM h) SELECT id, weight, touched FROM w WHERE weight >= 2 AND touched >= 2")
def sch04_concept_search(spark, sf_dir):
    groups = [["the", "token"], ["and", "license"]]
    return search.search(articles(spark, sf_dir), "the and", concepts=groups).select("id", "weight", "touched")


@query("""WITH RECURSIVE p AS (SELECT user_id, event_id, ts, epoch(ts) AS s, CAST(timezone('Europe/Berlin', timezone('UTC', ts)) AS DATE) AS d, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'view'),
r AS (SELECT user_id, n, event_id, ts, s AS last, d AS day, 1 AS used, true AS ok FROM p WHERE n = 1
UNION ALL SELECT user_id, n, event_id, ts, CASE WHEN ok THEN s ELSE last END, CASE WHEN ok THEN d ELSE day END, CASE WHEN ok THEN had + 1 ELSE used END, ok
FROM (SELECT p.*, r.last, r.day, r.used, CASE WHEN r.day = p.d THEN r.used ELSE 0 END AS had, p.s - r.last >= 5400 AND CASE WHEN r.day = p.d THEN r.used ELSE 0 END < 4 AS ok FROM r JOIN p ON p.user_id = r.user_id AND p.n = r.n + 1))
SELECT user_id, ts, event_id FROM r WHERE ok""")
def gte05_paced_offers(spark, sf_dir):
    """The offer alerts: four a day, an hour and a half apart; a test folds the same in a loop."""
    return policy.paced(table(spark, sf_dir, "events").filter("event_type = 'view'"), cooldown_minutes=90, per_day=4, zone="Europe/Berlin")


@query()
def stm01_stm02_resolve_duplicates(spark, sf_dir):
    """Exact copies, then same headlines, grouped in order of arrival; a test folds the same in a loop."""
    art = written(articles(spark, sf_dir).select("id", "title", "published_at", F.sha1("content").alias("h")))
    first = art.groupBy("h").agg(F.min("id").alias("first_id"))
    exact = art.join(first, "h").filter("id <> first_id").select("id", F.col("first_id").alias("matched_id"), F.lit(2.0).alias("score"))
    return similar.lead_by_arrival(exact.unionByName(similar.title_links(art, linked=exact)), art)


@query(W + ", q AS (SELECT id, length(title) AS cost, row_number() OVER (ORDER BY CASE WHEN title_zh IS NULL THEN 0 ELSE 1 END, final_score DESC, id DESC) AS n, source_name FROM art WHERE is_processed AND (title_zh IS NULL OR summary_zh IS NULL)), s AS (SELECT id, sum(cost) OVER (PARTITION BY source_name ORDER BY n ROWS UNBOUNDED PRECEDING) AS spent FROM q) SELECT id, CAST(spent AS BIGINT) AS spent FROM s WHERE spent <= 2000")
def stm05_translation_queue(spark, sf_dir):
    q = articles(spark, sf_dir).filter("is_processed AND (title_zh IS NULL OR summary_zh IS NULL)").withColumn("cost", F.length("title"))
    order = [F.when(F.col("title_zh").isNull(), 0).otherwise(1), F.desc("final_score"), F.desc("id")]
    return policy.within_budget(q, cost="cost", order=order, budget=2000, key="source_name").select("id", "spent")


@query(W + "SELECT id, coalesce(title_zh, summary_zh, 'route ' || source_name) AS routed FROM art")
def stm07_route(spark, sf_dir):
    return articles(spark, sf_dir).select("id", F.coalesce("title_zh", "summary_zh", F.concat(F.lit("route "), "source_name")).alias("routed"))


@query(W + ", p AS (SELECT id, row_number() OVER (PARTITION BY source_name ORDER BY published_at DESC, id DESC) - 1 AS n, source_name FROM art WHERE is_processed) SELECT id, source_name, CAST(n // 10 AS INTEGER) AS batch FROM p WHERE n < 60")
def stm09_round_batches(spark, sf_dir):
    order = Window.partitionBy("source_name").orderBy(F.desc("published_at"), F.desc("id"))
    n = articles(spark, sf_dir).filter("is_processed").withColumn("n", F.row_number().over(order) - 1).filter("n < 60")
    return n.select("id", "source_name", F.floor(F.col("n") / 10).cast("int").alias("batch"))


@query("SELECT p_partkey AS stars, p_name AS full_name FROM part WHERE p_partkey >= 10 ORDER BY p_partkey DESC, p_name LIMIT 30")
def src05_repositories(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("stargazers_count"), F.concat_ws("#", "p_name", "p_partkey").alias("full_name"), "p_name")
    return readers.repositories(p.union(p)).select(F.col("stargazers_count").alias("stars"), F.col("p_name").alias("full_name"))


@query("SELECT count(*) AS n, sum(l_quantity) AS total FROM lineitem WHERE l_returnflag = 'N' AND l_quantity > 10")
def ops02_budget_estimate(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").filter("l_returnflag = 'N' AND l_quantity > 10").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("total"))


@query("SELECT count(*) AS rows, count(*) - count(text) AS null_texts, count(*) - count(DISTINCT doc_id) AS repeated_ids FROM documents")
def ops04_self_check(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("rows"), (F.count("*") - F.count("text")).alias("null_texts"), (F.count("*") - F.countDistinct("doc_id")).alias("repeated_ids"))


@query("SELECT n_nationkey, coalesce(CASE n_regionkey WHEN 0 THEN 'south' WHEN 2 THEN 'east' END, r_name) AS label FROM nation JOIN region ON n_regionkey = r_regionkey")
def cfgx1_labels(spark, sf_dir):
    names = F.create_map(F.lit(0), F.lit("south"), F.lit(2), F.lit("east"))
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select("n_nationkey", F.coalesce(F.try_element_at(names, F.col("n_regionkey").cast("int")), "r_name").alias("label"))


