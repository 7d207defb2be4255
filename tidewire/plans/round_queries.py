"""Rounds, links, retries, terms and readers' references over the test tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import terms
from ..operators import classify, feed, rounds
from ..sources import readers
from .articles import ARTICLES, articles, table
from .registry import query

W = "WITH " + ARTICLES


@query(W + ", h AS (SELECT id, CASE WHEN contains(lower(source_name), '1') THEN 'Research' WHEN contains(lower(source_name), '2') THEN 'Models' END AS c, CASE WHEN contains(lower(source_name), '1') THEN 1.5 WHEN contains(lower(source_name), '2') THEN 0.5 ELSE 0 END AS w FROM art) SELECT id, c AS hint_category, CAST(w AS DOUBLE) AS hint_weight FROM h")
def cls03_source_hint(spark, sf_dir):
    return rounds.source_hint(articles(spark, sf_dir), {"1": ("Research", 1.5), "2": ("Models", 0.5)}).select("id", "hint_category", "hint_weight")


_MERGE = """, a AS (SELECT id, category AS rule_category, 0.5 AS conf, CAST(n_chars % 100 AS DOUBLE) AS imp,
  CASE WHEN id % 3 = 0 THEN 'Research' WHEN id % 3 = 1 THEN ' ' END AS ai_category, CASE WHEN id % 3 = 0 THEN 0.9 END AS ai_conf,
  CASE WHEN id % 4 = 0 THEN id % 101 END AS ai_imp, id % 90 AS ai_rel, CASE WHEN id % 5 = 0 THEN false WHEN id % 5 = 1 THEN true END AS ai_on FROM art),
v AS (SELECT *, CAST(coalesce(ai_imp, imp) AS DOUBLE) AS v, coalesce(NOT ai_on AND ai_rel < 40, false) AS off FROM a)
SELECT id, CASE WHEN id % 3 = 0 THEN 'Research' ELSE rule_category END AS category, CAST(coalesce(ai_conf, conf) AS DOUBLE) AS confidence,
  CASE WHEN off THEN least(v, 25) ELSE v END AS importance FROM v"""


@query(W + _MERGE)
def cls04_merge_model(spark, sf_dir):
    art = articles(spark, sf_dir).selectExpr(
        "id",
        "category AS rule_category",
        "0.5D AS confidence",
        "CAST(n_chars % 100 AS DOUBLE) AS rule_importance",
        "CASE WHEN id % 3 = 0 THEN 'Research' WHEN id % 3 = 1 THEN ' ' END AS ai_category",
        "CASE WHEN id % 3 = 0 THEN 0.9D END AS ai_confidence",
        "CASE WHEN id % 4 = 0 THEN id % 101 END AS ai_importance",
        "id % 90 AS ai_relevance",
        "CASE WHEN id % 5 = 0 THEN false WHEN id % 5 = 1 THEN true END AS ai_on_topic",
    )
    return rounds.merge_model(art).select("id", "category", "confidence", "importance")


_SUBS = {"Models": {"common": ["the", "of"], "rare": ["to", "from"]}, "Agents": {"articles": ["der", "die"], "joins": ["und", "mit"]}}


def _subcategory_sql() -> str:
    from .text_queries import SQ, _category_sql

    hit = lambda col, w: f"CASE WHEN regexp_matches({col}, '(^|[^a-z0-9]){w}([^a-z0-9]|$)') THEN 1 ELSE 0 END"
    ladder = ""
    for category, names in _SUBS.items():
        hits = {n: "(" + " + ".join(f"2 * ({hit('t', w)}) + ({hit('b', w)})" for w in ws) + ")" for n, ws in names.items()}
        (a, ha), (b, hb) = hits.items()
        ladder += f" WHEN m.m.name = '{category}' THEN CASE WHEN greatest({ha}, {hb}) >= 2 THEN CASE WHEN {ha} >= {hb} THEN '{a}' ELSE '{b}' END END"
    whole = _category_sql()
    head = whole[: whole.index("SELECT id, CASE WHEN m.score > 0 THEN m.name END")]
    assert SQ
    return head + f"SELECT m.id, CASE WHEN m.m.score > 0 THEN CASE{ladder} END END AS rule_subcategory FROM m JOIN x ON m.id = x.id"


@query(_subcategory_sql())
def cls02_subcategory(spark, sf_dir):
    from .text_queries import _TAXONOMY

    return classify.categorize(articles(spark, sf_dir), _TAXONOMY, subcategories=_SUBS).select("id", "rule_subcategory")


@query(W + ", s AS (SELECT id, n_chars % 3 <> 0 AS keep, id % 4 = 0 AS failed, id % 5 AS att FROM art WHERE NOT is_processed) SELECT id, CASE WHEN NOT keep THEN 'filtered' WHEN failed AND att + 1 >= 3 THEN 'abandoned' WHEN failed THEN 'retry' ELSE 'processed' END AS state, CASE WHEN NOT keep THEN att ELSE att + CAST(failed AS INTEGER) END AS attempts_after FROM s")
def stm04_settle_pending(spark, sf_dir):
    pending = articles(spark, sf_dir).filter("NOT is_processed").withColumn("attempts", F.col("id") % 5)
    return rounds.settle(pending, keep=F.col("n_chars") % 3 != 0, failed=F.col("id") % 4 == 0).select("id", "state", "attempts_after")


_LEAD = W + """, l AS (SELECT id, min(id) OVER (PARTITION BY sha1(content)) AS leader, count(*) OVER (PARTITION BY sha1(content)) AS n FROM art),
p AS (SELECT a.*, CASE WHEN l.n > 1 THEN coalesce(b.event_id, l.leader) ELSE a.event_id END AS ev, l.n > 1 AND a.id <> l.leader AS sib
  FROM art a JOIN l ON a.id = l.id JOIN art b ON b.id = l.leader),
s AS (SELECT ev, count(*) AS article_count, count(DISTINCT source_name) AS source_count, arg_max(id, (final_score, published_at, id)) AS best_id, max(final_score) AS best_score FROM p WHERE ev IS NOT NULL GROUP BY ev)
"""


@query(_LEAD + "SELECT p.id, p.ev AS event_id, p.sib AS sibling, CASE WHEN p.sib THEN coalesce(s.best_score, p.final_score) ELSE p.final_score END AS final_score FROM p LEFT JOIN s ON p.ev = s.ev")
def stm03_link_siblings(spark, sf_dir):
    return _linked(spark, sf_dir)[0].select("id", "event_id", "sibling", "final_score")


@query(_LEAD + "SELECT ev AS event_id, article_count, source_count, best_id FROM s")
def stm03_stories(spark, sf_dir):
    return _linked(spark, sf_dir)[1].select("event_id", "article_count", "source_count", "best_id")


def _linked(spark, sf_dir):
    art = articles(spark, sf_dir)
    hashed = art.select("id", F.sha1("content").alias("h"))
    leaders = hashed.join(hashed.groupBy("h").agg(F.min("id").alias("leader")), "h").select("id", "leader")
    return rounds.link_stories(art, leaders)


@query("WITH st AS (SELECT doc_id AS id, doc_id % 14 AS tries, 'wait for heat' AS reason FROM documents WHERE doc_id % 3 = 0), v AS (SELECT doc_id AS id, CASE doc_id % 5 WHEN 0 THEN 'wait for heat' WHEN 1 THEN 'quota' ELSE 'pass' END AS verdict FROM documents WHERE doc_id % 2 = 0), b AS (SELECT coalesce(st.id, v.id) AS id, coalesce(tries, 0) + CASE WHEN v.id IS NULL THEN 0 ELSE 1 END AS tries, coalesce(verdict, reason) AS reason, verdict FROM st FULL JOIN v ON st.id = v.id) SELECT id, tries, reason FROM b WHERE (verdict IS NULL OR verdict IN ('wait for heat', 'quota')) AND tries <= 12")
def gte02_deferrals(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    stored = d.filter("doc_id % 3 = 0").selectExpr("doc_id AS id", "doc_id % 14 AS tries", "'wait for heat' AS reason")
    seen = d.filter("doc_id % 2 = 0").selectExpr("doc_id AS id", "CASE doc_id % 5 WHEN 0 THEN 'wait for heat' WHEN 1 THEN 'quota' ELSE 'pass' END AS verdict")
    return rounds.deferrals(stored, seen, timing=("wait for heat", "quota"))


@query("WITH m AS (SELECT user_id, max(ts) + INTERVAL 6 HOUR AS til FROM events WHERE event_type = 'view' GROUP BY 1) SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM m WHERE til > TIMESTAMP '2024-01-30 12:00:00')")
def src12_negative_cache(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    missing = rounds.missing_until(e.filter("event_type = 'view'"), key="user_id", at="ts")
    return rounds.may_fetch(e.select("user_id").distinct(), missing, key="user_id", now=F.lit("2024-01-30 12:00:00").cast("timestamp_ntz"))


@query("WITH v AS (SELECT DISTINCT lower(p_brand) AS vendor FROM part), h AS (SELECT vendor, p_partkey AS id, row_number() OVER (PARTITION BY vendor ORDER BY p_partkey) AS n FROM part JOIN v ON contains(lower(p_partkey || ' ' || p_name || ' ' || p_brand), vendor)) SELECT vendor, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM h WHERE n <= 4 GROUP BY 1")
def jn12_vendor_models(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    models = p.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_brand").alias("name"))
    return rounds.vendor_models(models, p.select(F.col("p_brand").alias("vendor"))).select("vendor", F.array_join("ids", ",").alias("ids"))


@query("WITH q AS (SELECT o_orderkey, o_custkey AS user_id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE NULL END AS direct, CASE WHEN o_orderkey % 2 = 1 THEN o_orderkey % 4 END AS pos FROM orders), l AS (SELECT o_custkey AS user_id, o_orderkey AS article_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS pos FROM orders) SELECT o_orderkey, coalesce(direct, article_id) AS article_id FROM q LEFT JOIN l ON q.user_id = l.user_id AND q.pos = l.pos")
def sch10_resolve_reference(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    asked = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("more on #"), "o_orderkey")).otherwise(F.concat(F.lit("tell me no. "), F.col("o_orderkey") % 4, F.lit(" please")))
    latest = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    listed = o.select(F.col("o_custkey").alias("user_id"), F.row_number().over(latest).alias("position"), F.col("o_orderkey").alias("article_id"))
    return rounds.resolve_reference(o.select("o_orderkey", F.col("o_custkey").alias("user_id"), asked.alias("text")), listed).select("o_orderkey", "article_id")


@query("SELECT o_orderkey, CASE WHEN o_custkey % 50 = 0 THEN 'nothing found' WHEN o_custkey % 50 <= 10 THEN (o_custkey % 50) || ' in all' ELSE printf('%d in all, %d shown, page %d of %d', o_custkey % 50, 10, 1, CAST(ceil((o_custkey % 50) / 10.0) AS BIGINT)) END AS header FROM orders")
def top08_page_header(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", rounds.page_header(F.col("o_custkey") % 50, F.lit(10), F.lit(1), 10).alias("header"))


@query(W + "SELECT id, final_score >= 80 AS breaking FROM art")
def scr08_is_breaking(spark, sf_dir):
    return rounds.is_breaking(articles(spark, sf_dir)).select("id", "breaking")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(date_trunc('second', ts)) RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) AS n_rolling FROM events")
def stm10_rolling_day(spark, sf_dir):
    return rounds.rolling(table(spark, sf_dir, "events"), key="user_id", ts="ts").select("event_id", "n_rolling")


@query("SELECT DISTINCT lower(w) AS word FROM (SELECT p_brand AS w FROM part UNION ALL SELECT trim(v) FROM (SELECT unnest(string_split(p_name, ' ')) AS v FROM part) WHERE length(trim(v)) >= 4)")
def off03_vocabulary(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return rounds.extend_vocabulary(p.select(F.col("p_brand").alias("word")), p.select(F.explode(F.split("p_name", " ")).alias("word")))


@query(W + "SELECT id, source_name, title FROM art WHERE id = 17")
def api02_article(spark, sf_dir):
    return articles(spark, sf_dir).filter("id = 17").select("id", "source_name", "title")


@query(W + "SELECT source_name, count(*) AS n FROM art GROUP BY 1 ORDER BY 1")
def api02_all_sources(spark, sf_dir):
    return articles(spark, sf_dir).groupBy("source_name").agg(F.count("*").alias("n")).orderBy("source_name")


_TERMS = ["the", "of the", "and", "token"]
_PROTECT = r"(?:of the|token|and|the)"


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '(^|[^A-Za-z0-9])token([^A-Za-z0-9]|$)') THEN replace(lower(text), 'token', 'TOKEN') ELSE lower(text) END AS text FROM documents")
def trl02_wrong_sense(spark, sf_dir):
    fixed = terms.fix_wrong_sense(F.col("text"), F.lower("text"), [(r"(?<![A-Za-z0-9])token(?![A-Za-z0-9])", "token", "TOKEN")])
    return table(spark, sf_dir, "documents").select("doc_id", fixed.alias("text"))


@query("SELECT doc_id, regexp_replace(text, '&#?[A-Za-z0-9]{0,8}$', '') AS text FROM documents")
def str02_unescape(spark, sf_dir):
    """Texts escaped twice come back as they were, but for a cut entity or a mark alone at the end."""
    twice = F.col("text")
    for _ in range(2):
        twice = F.replace(F.replace(twice, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return table(spark, sf_dir, "documents").select("doc_id", terms.resolve_entities(twice).alias("text"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def jsn01_extract_json(spark, sf_dir):
    """An object within talk and a fence, with a stray brace before it."""
    chat = F.concat(F.lit("Sure {not json}. ```json\n"), "props", F.lit("\n``` Done."))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(terms.first_json_object(chat), "$.k").cast("long").alias("k"))


@query("SELECT o_custkey AS full_name, max(o_orderdate) AS published_at FROM orders GROUP BY 1 HAVING max(o_orderdate) >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 1440 HOUR ORDER BY published_at DESC, CAST(full_name AS VARCHAR) LIMIT 30")
def src06_releases(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    found = o.select(F.col("o_custkey").cast("string").alias("full_name"), F.col("o_orderkey").cast("string").alias("tag_name"), F.lit("u").alias("html_url"), F.lit(None).cast("string").alias("body"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published_at"))
    newest = feed.at(o.agg(F.max("o_orderdate")).first()[0])
    return readers.releases(found, as_of=newest, fresh_hours=1440).select(F.col("full_name").cast("long").alias("full_name"), "published_at")


@query("SELECT p_name AS full_name, p_partkey AS updated_at FROM part WHERE starts_with(lower(p_brand || '/' || p_name), lower('Brand#11') || '/') ORDER BY p_partkey DESC LIMIT 30")
def src07_organisation(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.concat_ws("/", "p_brand", "p_name").alias("full_name"), F.lit("u").alias("html_url"), F.col("p_partkey").alias("updated_at"))
    own = readers.organisation(p, "brand#11")
    return own.select(F.expr("substr(full_name, instr(full_name, '/') + 1)").alias("full_name"), "updated_at")


@query(W + "SELECT id, lag(final_score) OVER w AS before, lead(final_score) OVER w AS after, ntile(4) OVER w AS quarter, percent_rank() OVER w AS part, avg(final_score) OVER (PARTITION BY source_name ORDER BY published_at, id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM art WINDOW w AS (PARTITION BY source_name ORDER BY published_at, id)")
def win08_frames(spark, sf_dir):
    order = Window.partitionBy("source_name").orderBy("published_at", "id")
    near = F.avg("final_score").over(order.rowsBetween(-2, 2))
    art = articles(spark, sf_dir)
    return art.select("id", F.lag("final_score").over(order).alias("before"), F.lead("final_score").over(order).alias("after"), F.ntile(4).over(order).cast("long").alias("quarter"), F.percent_rank().over(order).alias("part"), near.alias("near"))


@query(W + ", k AS (SELECT id, is_processed, filtered_out, is_archived, content, title, event_id, final_score FROM art), c AS (SELECT event_id, count(*) AS n FROM k WHERE NOT is_archived GROUP BY 1) SELECT 'regate' AS step, count(*) AS n FROM k WHERE filtered_out AND length(content) >= 600 UNION ALL SELECT 'spam', count(*) FROM k WHERE NOT filtered_out AND regexp_matches(lower(title), 'token|password') UNION ALL SELECT 'matters', count(*) FROM k WHERE is_processed AND final_score >= 90 AND NOT filtered_out UNION ALL SELECT 'processed', count(*) FROM k WHERE NOT is_processed AND filtered_out UNION ALL SELECT 'ghost', count(*) FROM c WHERE event_id IS NOT NULL AND n = 1 UNION ALL SELECT 'lost', count(*) FROM k WHERE event_id IS NULL AND NOT is_archived")
def flt14_reconcile_steps(spark, sf_dir):
    """The six audits of a reconciliation that only looks: what each would change. One scan counts five of them."""
    art = articles(spark, sf_dir)
    tests = {
        "regate": "filtered_out AND length(content) >= 600",
        "spam": "NOT filtered_out AND lower(title) RLIKE 'token|password'",
        "matters": "is_processed AND final_score >= 90 AND NOT filtered_out",
        "processed": "NOT is_processed AND filtered_out",
        "lost": "event_id IS NULL AND NOT is_archived",
    }
    counted = art.agg(*[F.count_if(F.expr(t)).alias(n) for n, t in tests.items()])
    rows = counted.select(F.explode(F.array(*[F.struct(F.lit(n).alias("step"), F.col(n).alias("n")) for n in tests])).alias("r")).select("r.step", "r.n")
    ghosts = art.filter("NOT is_archived AND event_id IS NOT NULL").groupBy("event_id").agg(F.count("*").alias("n")).filter("n = 1")
    return rows.unionByName(ghosts.agg(F.lit("ghost").alias("step"), F.count("*").alias("n")))


@query("SELECT l_orderkey, l_linenumber, 'https://www.reddit.com/' || l_orderkey AS url, CAST(l_quantity AS DOUBLE) AS heat FROM lineitem WHERE l_quantity >= 20 AND l_linenumber >= 5 AND l_returnflag <> 'R'")
def flt15_reddit_rows(spark, sf_dir):
    posts = table(spark, sf_dir, "lineitem").select(
        F.struct("l_orderkey", "l_linenumber").alias("id"),
        F.lit("t").alias("title"),
        F.lit("Feeds").alias("subreddit"),
        F.col("l_quantity").alias("ups"),
        F.col("l_linenumber").alias("num_comments"),
        (F.col("l_returnflag") == "R").alias("stickied"),
        F.lit(True).alias("is_self"),
        F.lit(None).cast("string").alias("url"),
        F.concat(F.lit("/"), "l_orderkey").alias("permalink"),
        F.lit("someone").alias("author"),
    )
    return readers.reddit(posts, subreddit="feeds").select("id.l_orderkey", "id.l_linenumber", "url", "heat")


@query("SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS heat FROM orders WHERE floor(o_totalprice) >= 200000 AND epoch(o_orderdate) > epoch(TIMESTAMP '1998-07-01')")
def src04_hacker_news(spark, sf_dir):
    hits = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("objectID"), F.lit("t").alias("title"), F.lit("").alias("url"), F.floor("o_totalprice").cast("long").alias("points"), F.lit(1).alias("num_comments"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("created_at_i")
    )
    kept = readers.hacker_news(hits, as_of=F.lit("1998-07-03 00:00:00").cast("timestamp"), min_points=200_000)
    return kept.select(F.col("objectID").alias("o_orderkey"), F.col("heat").cast("long").alias("heat"))
