"""Reads over the article table: what is visible, best of each story, pages, counts, briefings."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def at(ts: datetime) -> Column:
    return F.lit(ts.isoformat(sep=" ")).cast("timestamp_ntz")


def story_key() -> Column:
    """Stories and single articles in key spaces that don't meet."""
    return F.coalesce(-F.col("event_id"), F.col("id"))


def eligible(
    articles: DataFrame,
    *,
    since: datetime | None = None,
    until: datetime | None = None,
    min_score: float | None = None,
    category: str | None = None,
    subcategory: str | None = None,
    source_name: str | None = None,
    require_processed: bool = True,
    skip_sent: bool = False,
) -> DataFrame:
    """The one definition of a visible article; both ends of the time span belong to it, and unknown flags don't hide."""
    keep = ~F.coalesce(F.col("is_archived"), F.lit(False)) & ~F.coalesce(F.col("filtered_out"), F.lit(False))
    if require_processed:
        keep &= F.coalesce(F.col("is_processed"), F.lit(False))
    if skip_sent:
        keep &= ~F.coalesce(F.col("is_sent"), F.lit(False))
    if since is not None:
        keep &= F.col("published_at") >= at(since)
    if until is not None:
        keep &= F.col("published_at") <= at(until)
    if min_score is not None:
        keep &= F.col("final_score") >= min_score
    for name, value in (("category", category), ("subcategory", subcategory), ("source_name", source_name)):
        if value is not None:
            keep &= F.col(name) == value
    return articles.filter(keep)


def best_of_story(articles: DataFrame) -> DataFrame:
    """One article for each story: best score, then newest, then last id."""
    order = Window.partitionBy(story_key()).orderBy(F.desc("final_score"), F.desc("published_at"), F.desc("id"))
    return articles.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn")


def page(articles: DataFrame, *, by_score: bool = True, limit: int = 20, offset: int = 0) -> DataFrame:
    keys = ["final_score", "published_at"] if by_score else ["published_at", "final_score"]
    out = articles.orderBy(*[F.desc(k) for k in keys], F.desc("id"))
    return (out.offset(offset) if offset else out).limit(limit)


def count_stories(articles: DataFrame) -> DataFrame:
    return articles.agg(F.countDistinct(story_key()).alias("stories"))


def category_counts(articles: DataFrame) -> DataFrame:
    return articles.groupBy(F.coalesce("category", F.lit("")).alias("category")).agg(F.count("*").alias("n"))


def topics(articles: DataFrame, order: list[str], fallback: str) -> DataFrame:
    """Counts in the order of the sections; articles without a section fall to ``fallback``."""
    name = F.when(F.coalesce("category", F.lit("")) == "", F.lit(fallback)).otherwise(F.col("category"))
    place = F.coalesce(*[F.when(F.col("topic") == c, i) for i, c in enumerate(order)], F.lit(99))
    return articles.groupBy(name.alias("topic")).agg(F.count("*").alias("n")).withColumn("place", place).orderBy("place", F.desc("n"), "topic")


def roll_up(articles: DataFrame) -> DataFrame:
    """A row for each story: members, outlets, best score, and the member that stands for it."""
    best = F.struct("final_score", "published_at", "id")
    return (
        articles.filter("event_id IS NOT NULL")
        .groupBy("event_id")
        .agg(
            F.count("*").alias("member_count"),
            F.array_sort(F.collect_set("source_name")).alias("outlets"),
            F.max("final_score").alias("top_score"),
            F.max_by("id", best).alias("canonical_id"),
            F.max_by("title", best).alias("title"),
            F.min("published_at").alias("first_seen"),
        )
    )


def with_story(articles: DataFrame, stories: DataFrame) -> DataFrame:
    """Each article with its story's other outlets; members counts outlets, one at least."""
    joined = articles.join(stories.select("event_id", "outlets", "member_count"), "event_id", "left")
    others = F.array_except(F.coalesce("outlets", F.array().cast("array<string>")), F.array("source_name"))
    return joined.withColumn("other_outlets", others).withColumn("members", F.greatest(F.size(F.coalesce("outlets", F.array().cast("array<string>"))), F.lit(1)))


def briefing(articles: DataFrame, *, top: int = 10, per_source: int = 3) -> DataFrame:
    """The best ``top`` articles with at most ``per_source`` of a source; places left are filled one source after another.

    The fill takes the sources by their best article left over, one of each in
    a cycle. Only the leading ``top`` articles of each source can matter, so
    the global order is over those.
    """
    order = [F.desc("final_score"), F.asc("id")]
    own = articles.withColumn("rn", F.row_number().over(Window.partitionBy("source_name").orderBy(*order))).filter(F.col("rn") <= top + max(per_source, 0))
    if per_source <= 0:
        return own.orderBy(*order).limit(top).select("*", F.lit("pick").alias("part"), F.lit(0).alias("cycle"))
    lead = Window.partitionBy("source_name")
    over = F.when(F.col("rn") > per_source, F.col("final_score"))
    ranked = own.withColumn("first_left", F.max(F.struct(over.alias("s"), F.when(over.isNotNull(), -F.col("id")).alias("i"))).over(lead))
    picked = F.col("rn") <= per_source
    ranked = ranked.withColumn("part", F.when(picked, "pick").otherwise("fill")).withColumn("cycle", F.when(picked, 0).otherwise(F.col("rn") - per_source))
    keys = [F.when(picked, 0).otherwise(1), "cycle", F.when(picked, -F.col("final_score")).otherwise(-F.col("first_left.s")), F.when(picked, F.col("id")).otherwise(-F.col("first_left.i"))]
    return ranked.orderBy(*keys).limit(top).drop("first_left")


def briefing_pool(articles: DataFrame, *, as_of: datetime, hours: int = 24, top: int = 10, floor: float = 45.0) -> DataFrame:
    """Unsent stories of the window; where they are fewer than ``top``, those of twice the window, sent or not, follow."""
    depth = max(4 * top, 200)
    near = page(best_of_story(eligible(articles, since=as_of - timedelta(hours=hours), until=as_of, min_score=floor, skip_sent=True)), limit=depth)
    far = page(best_of_story(eligible(articles, since=as_of - timedelta(hours=2 * hours), until=as_of, min_score=floor)), limit=depth)
    short = near.agg((F.count("*") < top).alias("short"))
    extra = far.join(near.select("id"), "id", "left_anti").join(F.broadcast(short), F.col("short")).drop("short")
    return near.withColumn("late", F.lit(0)).unionByName(extra.withColumn("late", F.lit(1)))


def sections(articles: DataFrame, order: list[str], *, top: int = 3) -> DataFrame:
    """The best ``top`` in a block of their own, then a block for each category; numbers run through all blocks."""
    best = articles.orderBy(F.desc("final_score"), F.desc("id")).limit(top).select("id", F.lit(True).alias("lead"))
    marked = articles.join(F.broadcast(best), "id", "left")
    block = F.when(F.col("lead"), F.lit("Top")).otherwise(F.coalesce(F.nullif("category", F.lit("")), F.lit("Other")))
    place = F.when(F.col("lead"), -1).otherwise(F.coalesce(*[F.when(F.col("category") == c, i) for i, c in enumerate(order)], F.lit(99)))
    # A briefing holds some tens of rows, so one ordered window numbers it.
    number = F.row_number().over(Window.orderBy("place", "block", F.desc("final_score"), F.desc("id")))
    return marked.withColumn("block", block).withColumn("place", place).withColumn("number", number).drop("lead")


def score_band(articles: DataFrame, *, dot: float = 49.0) -> DataFrame:
    """hot, star or plain by thirds of the cohort, ties at their best; below the bar always dim; few rows go by fixed bars."""
    # Ranks of scores, not of rows: the few distinct scores are counted first, and only those are put in order.
    counts = articles.groupBy("final_score").agg(F.count("*").alias("c"))
    above = Window.orderBy(F.col("final_score").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("final_score").alias("s"), F.coalesce(F.sum("c").over(above), F.lit(0)).alias("r"), F.sum("c").over(Window.partitionBy()).alias("n"))
    ranked = articles.join(counts, F.col("final_score").eqNullSafe(F.col("s"))).drop("s")
    third = F.greatest(F.lit(1), F.floor(F.col("n") / 3))
    by_rank = F.when(F.col("r") < third, "hot").when(F.col("r") < 2 * third, "star").otherwise("plain")
    by_bar = F.when(F.col("final_score") >= 62, "hot").when(F.col("final_score") >= 54, "star").otherwise("plain")
    return ranked.withColumn("band", F.when(F.col("final_score") < dot, "dim").when(F.col("n") >= 3, by_rank).otherwise(by_bar)).drop("r", "n")


def unprocessed(articles: DataFrame, limit: int = 40) -> DataFrame:
    return articles.filter("NOT is_processed AND NOT is_archived").orderBy(F.desc("published_at"), F.desc("id")).limit(limit)


def untranslated(articles: DataFrame, limit: int = 60) -> DataFrame:
    missing = F.when(F.col("title_zh").isNull(), 0).otherwise(1)
    return articles.filter("is_processed AND NOT is_archived AND (title_zh IS NULL OR summary_zh IS NULL)").orderBy(missing, F.desc("final_score"), F.desc("published_at"), F.desc("id")).limit(limit)


def needing_key_points(articles: DataFrame, *, limit: int = 120, max_tried: int = 2) -> DataFrame:
    """Rows without key points that weren't tried too often; the filter comes before the limit."""
    points, tried = F.get_json_object("meta", "$.key_points_zh"), F.get_json_object("meta", "$.key_points_tried").cast("int")
    return articles.filter(points.isNull() & (tried.isNull() | (tried < max_tried))).orderBy(F.desc("final_score"), F.desc("id")).limit(limit)


def deferred_alerts(articles: DataFrame, limit: int = 20) -> DataFrame:
    return articles.filter(F.get_json_object("meta", "$.breaking_defer").isNotNull()).orderBy(F.desc("final_score"), F.desc("id")).limit(limit)


def free_offers(articles: DataFrame, *, as_of: datetime, days: int = 7, tool: str | None = None) -> DataFrame:
    """Visible offers of the last ``days``; list, count and tools all start from here."""
    out = eligible(articles, since=as_of - timedelta(days=max(1, days))).filter("is_free_offer")
    return out if tool is None else out.filter(F.lower("free_tool") == tool.lower())


def unannounced_offers(articles: DataFrame, ledger: DataFrame, *, as_of: datetime, user_id: int, kind: str, min_confidence: float = 0.6, limit: int = 3) -> DataFrame:
    """Offers that a reader hasn't had; a null in the ledger hides nothing."""
    told = ledger.filter((F.col("user_id") == user_id) & (F.col("kind") == kind) & F.col("article_id").isNotNull()).select(F.col("article_id").alias("id")).distinct()
    fresh = free_offers(articles, as_of=as_of).join(told, "id", "left_anti")
    first = fresh.orderBy(F.desc("created_at"), F.desc("id")).limit(4 * limit)
    return first.filter((F.col("free_confidence") >= min_confidence) & F.coalesce("subject_in_title", F.lit(True))).orderBy(F.desc("free_confidence"), F.desc("id")).limit(limit)


def backlog(articles: DataFrame, *, as_of: datetime) -> DataFrame:
    """How many wait, and the hours of the oldest."""
    wait = F.timestamp_diff("SECOND", F.min("created_at"), at(as_of)) / 3600.0
    return articles.filter("NOT is_processed AND NOT is_archived").agg(F.count("*").alias("waiting"), (F.floor(wait * 10 + 0.5) / 10.0).alias("oldest_hours"))


def archive(articles: DataFrame, *, as_of: datetime, days: int) -> DataFrame:
    old = F.lit(False) if days <= 0 else F.col("published_at") < at(as_of - timedelta(days=days))
    return articles.withColumn("is_archived", F.col("is_archived") | old)


def tag_links(articles: DataFrame, tags: str = "tags") -> DataFrame:
    """(id, tag): each tag of an article once, in any case."""
    return articles.select("id", F.explode(tags).alias("tag")).withColumn("folded", F.lower("tag")).groupBy("id", "folded").agg(F.min("tag").alias("tag")).select("id", "tag")
