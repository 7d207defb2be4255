"""Reads over the article table, each with the SQL that gives the same rows."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import feed
from .articles import ARTICLES, CATEGORIES, LEDGER, articles, clock, ledger, table
from .registry import query

W = "WITH " + ARTICLES
ROW = "id, source_name, final_score, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published"


def _row(df: DataFrame) -> DataFrame:
    return df.select("id", "source_name", "final_score", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published"))


@query(W + f"SELECT {ROW} FROM best ORDER BY final_score DESC, published_at DESC, id DESC LIMIT 20")
def top_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _row(feed.page(feed.best_of_story(feed.eligible(articles(spark, sf_dir)))))


@query(W + f"SELECT {ROW} FROM art, clock WHERE NOT is_archived AND NOT filtered_out AND is_processed AND is_sent IS NOT TRUE AND published_at >= as_of - INTERVAL 240 HOUR AND published_at <= as_of AND final_score >= 45")
def flt01_eligible(spark, sf_dir):
    now = clock(spark, sf_dir)
    return _row(feed.eligible(articles(spark, sf_dir), since=now - timedelta(hours=240), until=now, min_score=45, skip_sent=True))


@query(W + f"SELECT {ROW} FROM art WHERE NOT is_processed AND NOT is_archived ORDER BY published_at DESC, id DESC LIMIT 40")
def flt02_unprocessed(spark, sf_dir):
    return _row(feed.unprocessed(articles(spark, sf_dir)))


@query(W + f"SELECT {ROW} FROM art WHERE is_processed AND NOT is_archived AND (title_zh IS NULL OR summary_zh IS NULL) ORDER BY CASE WHEN title_zh IS NULL THEN 0 ELSE 1 END, final_score DESC, published_at DESC, id DESC LIMIT 60")
def flt03_untranslated(spark, sf_dir):
    return _row(feed.untranslated(articles(spark, sf_dir)))


@query(W + f"SELECT {ROW} FROM art WHERE json_extract(meta, '$.key_points_zh') IS NULL AND coalesce(CAST(json_extract_string(meta, '$.key_points_tried') AS INTEGER), 0) < 2 ORDER BY final_score DESC, id DESC LIMIT 120")
def flt04_needing_key_points(spark, sf_dir):
    return _row(feed.needing_key_points(articles(spark, sf_dir)))


@query(W + f"SELECT {ROW} FROM art WHERE json_extract(meta, '$.breaking_defer') IS NOT NULL ORDER BY final_score DESC, id DESC LIMIT 20")
def flt05_deferred_alerts(spark, sf_dir):
    return _row(feed.deferred_alerts(articles(spark, sf_dir)))


@query(W + f"SELECT {ROW} FROM vis, clock WHERE is_free_offer AND lower(free_tool) = 'hosting' AND published_at >= as_of - INTERVAL 7 DAY")
def flt06_free_offers(spark, sf_dir):
    return _row(feed.free_offers(articles(spark, sf_dir), as_of=clock(spark, sf_dir), tool="HOSTING"))


@query(W + "SELECT id, is_archived OR published_at < as_of - INTERVAL 20 DAY AS is_archived FROM art, clock")
def snk06_archive(spark, sf_dir):
    return feed.archive(articles(spark, sf_dir), as_of=clock(spark, sf_dir), days=20).select("id", "is_archived")


@query(W + ", st AS (SELECT event_id, count(*) AS member_count, list_sort(list(DISTINCT source_name)) AS outlets, max(final_score) AS top_score, arg_max(id, (final_score, published_at, id)) AS canonical_id, arg_max(title, (final_score, published_at, id)) AS title FROM art WHERE event_id IS NOT NULL GROUP BY event_id) SELECT event_id, member_count, array_to_string(outlets, ',') AS outlets, top_score, canonical_id, title FROM st")
def agg10_story_roll_up(spark, sf_dir):
    return feed.roll_up(articles(spark, sf_dir)).select("event_id", "member_count", F.array_join("outlets", ",").alias("outlets"), "top_score", "canonical_id", "title")


@query(W + ", st AS (SELECT event_id, list_sort(list(DISTINCT source_name)) AS outlets FROM art WHERE event_id IS NOT NULL GROUP BY event_id) SELECT a.id, array_to_string(list_filter(coalesce(outlets, []), lambda x: x <> a.source_name), ',') AS other_outlets, CAST(greatest(len(coalesce(outlets, [])), 1) AS INTEGER) AS members FROM art a LEFT JOIN st ON a.event_id = st.event_id")
def prj01_article_view(spark, sf_dir):
    art = articles(spark, sf_dir)
    return feed.with_story(art, feed.roll_up(art)).select("id", F.array_join("other_outlets", ",").alias("other_outlets"), "members")


@query(W + "SELECT id, event_id, final_score FROM best")
def win01_best_per_story(spark, sf_dir):
    return feed.best_of_story(feed.eligible(articles(spark, sf_dir))).select("id", "event_id", "final_score")


@query("SELECT o_orderkey AS id, o_custkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def jn01_best_order_of_customer(spark, sf_dir):
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "o_custkey AS event_id", "o_totalprice AS final_score", "o_orderdate AS published_at", "o_custkey", "o_totalprice")
    return feed.best_of_story(o).select("id", "o_custkey", "o_totalprice")


@query(W + ", " + LEDGER + f", told AS (SELECT DISTINCT article_id FROM led WHERE user_id = 3 AND kind = 'view' AND article_id IS NOT NULL), fresh AS (SELECT vis.* FROM vis, clock WHERE is_free_offer AND published_at >= as_of - INTERVAL 7 DAY AND id NOT IN (SELECT article_id FROM told)), first AS (SELECT * FROM fresh ORDER BY created_at DESC, id DESC LIMIT 12) SELECT {ROW} FROM first WHERE free_confidence >= 0.6 AND coalesce(subject_in_title, true) ORDER BY free_confidence DESC, id DESC LIMIT 3")
def jn02_unannounced_offers(spark, sf_dir):
    return _row(feed.unannounced_offers(articles(spark, sf_dir), ledger(spark, sf_dir), as_of=clock(spark, sf_dir), user_id=3, kind="view"))


@query("WITH " + LEDGER + " SELECT DISTINCT user_id FROM led a WHERE EXISTS (SELECT 1 FROM led b WHERE b.user_id = a.user_id AND b.kind = 'purchase' AND b.article_id = a.article_id)")
def jn03_already_pushed(spark, sf_dir):
    led = ledger(spark, sf_dir)
    bought = led.filter("kind = 'purchase'").select("user_id", "article_id")
    return led.join(bought, ["user_id", "article_id"], "left_semi").select("user_id").distinct()


@query(W + "SELECT event_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY published_at, id) AS members FROM art WHERE event_id IS NOT NULL GROUP BY event_id")
def jn04_story_members(spark, sf_dir):
    m = articles(spark, sf_dir).filter("event_id IS NOT NULL").groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("published_at", "id"))).alias("m"))
    return m.select("event_id", F.array_join(F.transform("m.id", lambda x: x.cast("string")), ",").alias("members"))


@query(W + "SELECT DISTINCT id, lower(t) AS tag FROM (SELECT id, unnest([free_tool, source_name, upper(source_name)]) AS t FROM art)")
def jn05_tag_links(spark, sf_dir):
    tagged = articles(spark, sf_dir).withColumn("tags", F.array("free_tool", "source_name", F.upper("source_name")))
    return feed.tag_links(tagged).select("id", F.lower("tag").alias("tag"))


@query(W + "SELECT a.id, s.n AS source_articles FROM art a LEFT JOIN (SELECT source_name, count(*) AS n FROM art GROUP BY 1) s ON a.source_name = s.source_name")
def jn06_eager_source(spark, sf_dir):
    art = articles(spark, sf_dir)
    return art.join(art.groupBy("source_name").agg(F.count("*").alias("source_articles")), "source_name", "left").select("id", "source_articles")


@query(W + "SELECT coalesce(category, '') AS category, count(*) AS n FROM vis GROUP BY 1")
def agg01_category_counts(spark, sf_dir):
    return feed.category_counts(feed.eligible(articles(spark, sf_dir)))


@query(W + "SELECT CASE WHEN coalesce(category, '') = '' THEN 'Other' ELSE category END AS topic, count(*) AS n FROM vis GROUP BY 1")
def agg02_topics(spark, sf_dir):
    return feed.topics(feed.eligible(articles(spark, sf_dir)), CATEGORIES, "Other").select("topic", "n")


@query(W + "SELECT count(DISTINCT coalesce(-event_id, id)) AS stories FROM vis")
def agg03_count_eligible(spark, sf_dir):
    return feed.count_stories(feed.eligible(articles(spark, sf_dir)))


@query(W + "SELECT count(*) AS n FROM art, clock WHERE created_at >= as_of - INTERVAL 72 HOUR")
def agg04_count_since(spark, sf_dir):
    return articles(spark, sf_dir).filter(F.col("created_at") >= feed.at(clock(spark, sf_dir) - timedelta(hours=72))).agg(F.count("*").alias("n"))


@query(W + "SELECT count(*) AS waiting, floor(date_sub('second', min(created_at), min(as_of)) / CAST(3600 AS DOUBLE) * 10 + 0.5) / CAST(10 AS DOUBLE) AS oldest_hours FROM art, clock WHERE NOT is_processed AND NOT is_archived")
def agg05_backlog(spark, sf_dir):
    return feed.backlog(articles(spark, sf_dir), as_of=clock(spark, sf_dir))


@query(W + "SELECT free_tool, count(*) AS n FROM vis, clock WHERE is_free_offer AND published_at >= as_of - INTERVAL 30 DAY GROUP BY 1 ORDER BY n DESC, free_tool LIMIT 2")
def agg06_offer_tools(spark, sf_dir):
    return feed.free_offers(articles(spark, sf_dir), as_of=clock(spark, sf_dir), days=30).groupBy("free_tool").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "free_tool").limit(2)


@query(W + "SELECT source_name, count(*) AS n FROM art, clock WHERE published_at >= as_of - INTERVAL 14 DAY GROUP BY 1")
def agg07_counts_by_source(spark, sf_dir):
    since = feed.at(clock(spark, sf_dir) - timedelta(days=14))
    return articles(spark, sf_dir).filter(F.col("published_at") >= since).groupBy("source_name").agg(F.count("*").alias("n"))


@query(W + "SELECT DISTINCT source_name FROM art, clock WHERE created_at >= as_of - INTERVAL 24 HOUR")
def agg08_delivering_sources(spark, sf_dir):
    return articles(spark, sf_dir).filter(F.col("created_at") >= feed.at(clock(spark, sf_dir) - timedelta(hours=24))).select("source_name").distinct()


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 12 >= 5 THEN 'failing' ELSE 'blipping' END AS state, s_suppkey % 12 AS errors FROM supplier WHERE s_acctbal > 0 AND s_suppkey % 12 > 0")
def agg09_sources_needing_attention(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").withColumn("errors", F.col("s_suppkey") % 12).filter("s_acctbal > 0 AND errors > 0")
    return s.select("s_suppkey", F.when(F.col("errors") >= 5, "failing").otherwise("blipping").alias("state"), "errors")


@query(W + "SELECT count(*) AS articles, count(*) FILTER (WHERE is_processed) AS processed, count(*) FILTER (WHERE filtered_out) AS filtered, count(DISTINCT event_id) AS stories, count(DISTINCT source_name) AS sources, count(*) FILTER (WHERE is_free_offer) AS offers, max(final_score) AS top_score FROM art")
def agg13_stats(spark, sf_dir):
    return articles(spark, sf_dir).agg(
        F.count("*").alias("articles"),
        F.count_if("is_processed").alias("processed"),
        F.count_if("filtered_out").alias("filtered"),
        F.countDistinct("event_id").alias("stories"),
        F.countDistinct("source_name").alias("sources"),
        F.count_if("is_free_offer").alias("offers"),
        F.max("final_score").alias("top_score"),
    )


@query(W + "SELECT CASE WHEN is_archived THEN 'archived' WHEN filtered_out THEN 'filtered' WHEN NOT is_processed THEN 'pending' ELSE 'stored' END AS outcome, count(*) AS n FROM art GROUP BY 1")
def agg16_outcomes(spark, sf_dir):
    outcome = F.when(F.col("is_archived"), "archived").when(F.col("filtered_out"), "filtered").when(~F.col("is_processed"), "pending").otherwise("stored")
    return articles(spark, sf_dir).groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("SELECT count(*) FILTER (WHERE p AND l) AS tp, count(*) FILTER (WHERE p AND NOT l) AS fp, count(*) FILTER (WHERE NOT p AND l) AS missed, count(*) FILTER (WHERE p AND l) / CAST(greatest(count(*) FILTER (WHERE p), 1) AS DOUBLE) AS precision, count(*) FILTER (WHERE p AND l) / CAST(greatest(count(*) FILTER (WHERE l), 1) AS DOUBLE) AS recall FROM (SELECT contains(lower(text), 'idiot') OR contains(lower(text), 'trash') AS p, toxic = 1 AS l FROM documents JOIN labels USING (doc_id))")
def agg17_eval_metrics(spark, sf_dir):
    low = F.lower("text")
    j = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select((F.contains(low, F.lit("idiot")) | F.contains(low, F.lit("trash"))).alias("p"), (F.col("toxic") == 1).alias("l"))
    m = j.agg(F.count_if(F.expr("p AND l")).alias("tp"), F.count_if(F.expr("p AND NOT l")).alias("fp"), F.count_if(F.expr("NOT p AND l")).alias("missed"))
    return m.withColumn("precision", F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)).cast("double")).withColumn("recall", F.col("tp") / F.greatest(F.col("tp") + F.col("missed"), F.lit(1)).cast("double"))


@query(W + ", top AS (SELECT * FROM best, clock WHERE published_at >= as_of - INTERVAL 72 HOUR), r AS (SELECT id, final_score, rank() OVER (ORDER BY final_score DESC) - 1 AS r, count(*) OVER () AS n FROM top) SELECT id, CASE WHEN final_score < 49 THEN 'dim' WHEN n >= 3 THEN CASE WHEN r < greatest(1, n // 3) THEN 'hot' WHEN r < 2 * greatest(1, n // 3) THEN 'star' ELSE 'plain' END ELSE CASE WHEN final_score >= 62 THEN 'hot' WHEN final_score >= 54 THEN 'star' ELSE 'plain' END END AS band FROM r")
def win02_score_bands(spark, sf_dir):
    recent = feed.eligible(articles(spark, sf_dir))
    best = feed.best_of_story(recent).filter(F.col("published_at") >= feed.at(clock(spark, sf_dir) - timedelta(hours=72)))
    return feed.score_band(best).select("id", "band")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn = 2")
def win03_nth_latest(spark, sf_dir):
    from pyspark.sql import Window

    return table(spark, sf_dir, "conversations").withColumn("rn", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).filter("rn = 2").select("conv_id", "turn", "role")


@query(W + ", lead AS (SELECT id FROM best ORDER BY final_score DESC, id DESC LIMIT 3), top AS (SELECT * FROM best ORDER BY final_score DESC, published_at DESC, id DESC LIMIT 30), b AS (SELECT t.id, CASE WHEN l.id IS NOT NULL THEN 'Top' WHEN coalesce(category, '') = '' THEN 'Other' ELSE category END AS block, CASE WHEN l.id IS NOT NULL THEN -1 WHEN category = 'Models' THEN 0 WHEN category = 'Agents' THEN 1 WHEN category = 'Infrastructure' THEN 2 WHEN category = 'Open Source' THEN 3 WHEN category = 'Research' THEN 4 ELSE 99 END AS place, final_score FROM top t LEFT JOIN lead l ON t.id = l.id) SELECT id, block, CAST(row_number() OVER (ORDER BY place, block, final_score DESC, id DESC) AS INTEGER) AS number FROM b")
def win06_top05_sections(spark, sf_dir):
    top = feed.page(feed.best_of_story(feed.eligible(articles(spark, sf_dir))), limit=30)
    return feed.sections(top, CATEGORIES).select("id", "block", "number")


@query(W + "SELECT quantile_cont(final_score, 0.9) AS p90, quantile_cont(final_score, 0.6) AS p60, quantile_cont(final_score, 0.25) AS p25, max(final_score) AS top FROM best")
def win08_percentiles(spark, sf_dir):
    best = feed.best_of_story(feed.eligible(articles(spark, sf_dir)))
    return best.agg(*[F.percentile("final_score", q).alias(n) for n, q in (("p90", 0.9), ("p60", 0.6), ("p25", 0.25))], F.max("final_score").alias("top"))


@query(W + f"SELECT {ROW} FROM best ORDER BY final_score DESC, published_at DESC, id DESC LIMIT 10 OFFSET 20")
def top01_page_by_score(spark, sf_dir):
    return _row(feed.page(feed.best_of_story(feed.eligible(articles(spark, sf_dir))), limit=10, offset=20))


@query(W + f"SELECT {ROW} FROM best ORDER BY published_at DESC, final_score DESC, id DESC LIMIT 30")
def top02_latest(spark, sf_dir):
    return _row(feed.page(feed.best_of_story(feed.eligible(articles(spark, sf_dir))), by_score=False, limit=30))


@query(W + f", t AS (SELECT * FROM vis, clock WHERE published_at >= as_of - INTERVAL 48 HOUR AND final_score >= 1), b AS (SELECT *, row_number() OVER (PARTITION BY coalesce(-event_id, id) ORDER BY final_score DESC, published_at DESC, id DESC) AS k FROM t) SELECT {ROW} FROM b WHERE k = 1 ORDER BY final_score DESC, published_at DESC, id DESC LIMIT 20")
def top02_trending(spark, sf_dir):
    since = clock(spark, sf_dir) - timedelta(hours=48)
    return _row(feed.page(feed.best_of_story(feed.eligible(articles(spark, sf_dir), since=since, min_score=1))))


@query(W + ", o AS (SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY final_score DESC, id) AS k FROM best), pick AS (SELECT id, source_name, final_score, k, 0 AS part, 0 AS cyc, final_score AS s, id AS i FROM o WHERE k <= 3), over AS (SELECT *, first_value(final_score) OVER (PARTITION BY source_name ORDER BY k) AS s, first_value(id) OVER (PARTITION BY source_name ORDER BY k) AS i FROM o WHERE k > 3), fill AS (SELECT id, source_name, final_score, k, 1 AS part, k - 3 AS cyc, s, i FROM over) SELECT id, source_name, final_score FROM (SELECT * FROM pick UNION ALL SELECT * FROM fill) ORDER BY part, cyc, s DESC, i LIMIT 90")
def top03_briefing(spark, sf_dir):
    return feed.briefing(feed.best_of_story(feed.eligible(articles(spark, sf_dir))), top=90, per_source=3).select("id", "source_name", "final_score")


@query(W + ", n AS (SELECT *, row_number() OVER (PARTITION BY coalesce(-event_id, id) ORDER BY final_score DESC, published_at DESC, id DESC) AS k FROM vis, clock WHERE published_at BETWEEN as_of - INTERVAL 24 HOUR AND as_of AND final_score >= 45 AND is_sent IS NOT TRUE), near AS (SELECT * FROM n WHERE k = 1 ORDER BY final_score DESC, published_at DESC, id DESC LIMIT 200), f AS (SELECT *, row_number() OVER (PARTITION BY coalesce(-event_id, id) ORDER BY final_score DESC, published_at DESC, id DESC) AS k FROM vis, clock WHERE published_at BETWEEN as_of - INTERVAL 48 HOUR AND as_of AND final_score >= 45), far AS (SELECT * FROM f WHERE k = 1 ORDER BY final_score DESC, published_at DESC, id DESC LIMIT 200) SELECT id, 0 AS late FROM near UNION ALL SELECT id, 1 AS late FROM far WHERE id NOT IN (SELECT id FROM near) AND (SELECT count(*) FROM near) < 10")
def top04_briefing_pool(spark, sf_dir):
    return feed.briefing_pool(articles(spark, sf_dir), as_of=clock(spark, sf_dir)).select("id", "late")


@query(W + "SELECT id, title FROM art, clock WHERE NOT is_archived AND published_at >= as_of - INTERVAL 72 HOUR ORDER BY published_at DESC, id DESC LIMIT 400")
def top07_recent_titles(spark, sf_dir):
    since = feed.at(clock(spark, sf_dir) - timedelta(hours=72))
    return articles(spark, sf_dir).filter(~F.col("is_archived") & (F.col("published_at") >= since)).orderBy(F.desc("published_at"), F.desc("id")).limit(400).select("id", "title")


@query("WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01') SELECT k, 'ended' AS change FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT k, 'new' AS change FROM b WHERE k NOT IN (SELECT k FROM a)")
def set03_snapshot_diff(spark, sf_dir):
    from ..sources.state import snapshot_diff

    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "k")
    cut = F.lit("1996-01-01 00:00:00").cast("timestamp_ntz")
    return snapshot_diff(li.filter(F.col("l_shipdate") < cut), li.filter(F.col("l_shipdate") >= cut), "k")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 48 AND l_partkey IS NOT NULL)")
def set04_unannounced(spark, sf_dir):
    told = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' AND l_quantity >= 48").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey").join(told, "p_partkey", "left_anti")


@query(W + "SELECT count(*) AS n FROM (SELECT DISTINCT source_name FROM art, clock WHERE created_at >= as_of - INTERVAL 24 HOUR INTERSECT SELECT DISTINCT source_name FROM art WHERE tier IN ('A', 'B'))")
def set05_delivering_and_enabled(spark, sf_dir):
    art = articles(spark, sf_dir)
    since = feed.at(clock(spark, sf_dir) - timedelta(hours=24))
    return art.filter(F.col("created_at") >= since).select("source_name").intersect(art.filter("tier IN ('A', 'B')").select("source_name")).agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def agg_lineitem_summary(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02 00:00:00").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.count("*").alias("n"))
