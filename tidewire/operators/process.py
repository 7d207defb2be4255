"""A whole round of processing as one job, and the table of its outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import present, scoring
from ..functions.text import title_key
from ..sources.shared import exists, written
from . import classify, offers

#: What a round says of each article.
OUTCOMES = ("filtered", "retry", "abandoned", "processed", "breaking", "watch")


def process(
    pending: DataFrame,
    *,
    as_of: Column,
    keywords: list[str],
    taxonomy: dict[str, list[str]],
    vocabulary: DataFrame | None = None,
    friends: list[str] = (),
    terms: list[str] = (),
    interests: list[tuple[str, str, float]] = (),
    stored: DataFrame | None = None,
    broken: Column | None = None,
    fallback_category: str = "Other",
    strikes: int = 3,
    gate: dict | None = None,
) -> DataFrame:
    """Gate, category, score, offer, summary, tags, story and alert of pending articles, with an outcome for each.

    Needs id, title, content, source_name, tier, heat, published_at, event_id,
    attempts. ``vocabulary`` is that of ``offers.detect_offers``; ``stored`` has
    (id, title, event_id) of articles that came before.

    An article without a keyword is ``filtered``, whatever else holds. One that
    is ``broken`` (no title or no time, if nothing is given) is tried again,
    and ``abandoned`` with its third failure. Others join the story of the
    first article of an equal title key, are scored and ``processed``; those
    that pass the alert gate are ``breaking``, those that only lack heat and are
    fresh are to be ``watch``-ed. A title without words is a story of its own.
    """
    broken = F.coalesce(broken if broken is not None else (F.col("title").isNull() | F.col("published_at").isNull()), F.lit(False))
    rows = pending.withColumns({"attempts": F.coalesce("attempts", F.lit(0)).cast("int"), "broken": broken, "is_free_offer": F.lit(False)})
    rows = classify.categorize(classify.keyword_gate(rows, keywords), taxonomy)
    n = F.size("hits")
    age = F.timestamp_diff("SECOND", F.col("published_at"), as_of) / 3600.0
    category = F.coalesce("rule_category", F.lit(fallback_category))
    rows = rows.withColumns(
        {
            "category": category,
            "importance": scoring.rule_importance(n, F.col("tier")),
            "relevance": scoring.rule_relevance(n),
            "novelty": scoring.novelty(age).cast("double"),
            "source_quality": scoring.source_quality(F.col("tier")),
            "warmth": F.least(F.coalesce("heat", F.lit(0.0)), F.lit(100.0)),
            "bonus": scoring.interest_bonus(F.lower(F.concat_ws(" ", "title", "content")), F.array().cast("array<string>"), category, list(interests)),
        }
    )
    score = scoring.final_score(F.col("importance"), F.col("relevance"), F.col("novelty"), F.col("source_quality"), F.col("warmth"), F.col("tier"), F.col("bonus"))
    rows = rows.withColumn("final_score", F.coalesce(score, F.lit(0.0)))
    summary = present.fallback_summary(F.col("title"), F.col("content"))
    rows = rows.withColumn("said", summary).withColumns({"summary": F.coalesce("said.summary", "title"), "points": F.col("said.points")}).drop("said")
    rows = classify.tags(rows, list(terms)) if terms else rows.withColumn("tags", F.array("source_name"))
    if vocabulary is not None:
        found = offers.detect_offers(rows.filter("keep AND NOT broken"), vocabulary, friends=friends)
        rows = rows.join(found.select("id", F.col("tool").alias("offer_tool"), F.col("kind").alias("offer_kind"), F.col("confidence").alias("offer_confidence")), "id", "left")
    else:
        rows = rows.withColumns({"offer_tool": F.lit(None).cast("string"), "offer_kind": F.lit(None).cast("string"), "offer_confidence": F.lit(None).cast("double")})
    rows = rows.withColumn("is_free_offer", F.col("offer_tool").isNotNull()).withColumn("tags", F.when(F.col("offer_tool").isNotNull(), F.array_distinct(F.concat("tags", F.array("offer_tool")))).otherwise(F.col("tags")))
    rows = classify.breaking_gate(rows, as_of=as_of, **(gate or {}))
    tries = F.col("attempts") + 1
    rows = rows.withColumn(
        "outcome",
        F.when(~F.col("keep"), "filtered")
        .when(F.col("broken") & (tries >= strikes), "abandoned")
        .when(F.col("broken"), "retry")
        .when(F.col("passes"), "breaking")
        .when(F.col("verdict") == "wait for heat", "watch")
        .otherwise("processed"),
    )
    rows = rows.withColumn("attempts", F.when(F.col("outcome") == "filtered", F.col("attempts")).otherwise(tries))
    rows = _in_stories(rows, stored)
    scored = F.col("outcome").isin("processed", "breaking", "watch")
    keep = lambda c: F.when(scored, F.col(c))
    return rows.select(
        "id",
        "outcome",
        "attempts",
        F.when(F.col("outcome") == "filtered", "no keyword").when(F.col("broken"), "no title or time").alias("error"),
        F.when(scored | (F.col("outcome") == "filtered"), F.when(scored, F.col("category")).otherwise(F.lit(fallback_category))).alias("category"),
        *[keep(c).alias(c) for c in ("importance", "relevance", "novelty", "source_quality", "warmth")],
        F.when(F.col("outcome") == "filtered", 0.0).otherwise(keep("final_score")).alias("final_score"),
        *[keep(c).alias(c) for c in ("summary", "points", "tags", "offer_tool", "offer_kind", "offer_confidence", "story", "verdict")],
    )


def _in_stories(rows: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Adds story: that of the first article with the same title key, its own id if that has none."""
    joined = rows.filter(F.col("outcome").isin("processed", "breaking", "watch")).select("id", "title", "event_id")
    known = joined if stored is None else joined.unionByName(stored.select("id", "title", "event_id"))
    keyed = known.select("id", title_key(F.col("title")).alias("key"), "event_id").filter("key <> ''")
    first = keyed.groupBy("key").agg(F.min("id").alias("lead"), F.min_by("event_id", F.when(F.col("event_id").isNotNull(), F.col("id"))).alias("known"))
    own = rows.withColumn("key", title_key(F.col("title"))).join(first, "key", "left")
    return own.withColumn("story", F.coalesce("event_id", "known", "lead", "id")).drop("key", "lead", "known")


def _round(target: str, number: int) -> str:
    return f"{target.rstrip('/')}/round={number:08d}"


def current(spark: SparkSession, target: str, before: int) -> DataFrame | None:
    """The last outcome of each article in the finished rounds before a number; None if there is none."""
    done = [n for n in range(before) if exists(spark, f"{_round(target, n)}/_SUCCESS")]
    if not done:
        return None
    parts = [spark.read.parquet(_round(target, n)).withColumn("number", F.lit(n)) for n in done]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    columns = [c for c in every.columns if c != "id"]
    return every.groupBy("id").agg(F.max_by(F.struct(*columns), "number").alias("last")).select("id", "last.*")


def run_round(articles: DataFrame, target: str, number: int, **rules) -> DataFrame:
    """Processes what the rounds before ``number`` (from 0 on) left open, and writes the outcomes under ``target``.

    A round is one table, which exists once its job has committed: a run that
    breaks off leaves nothing that later reads see, and is simply run again; a
    round that has been finished is read, not repeated. So attempts rise once a
    round, however often it was started. ``rules`` go to ``process``; the
    stories of earlier rounds go on.
    """
    spark, path = articles.sparkSession, _round(target, number)
    if not exists(spark, f"{path}/_SUCCESS"):
        before = current(spark, target, number)
        if before is None:
            pending, stored = articles.withColumn("attempts", F.lit(0)), None
        else:
            last = before.select("id", F.col("outcome").alias("last_outcome"), F.col("attempts").alias("attempts"), F.col("story").alias("last_story"))
            rows = articles.drop("attempts").join(last, "id", "left")
            pending = rows.filter("last_outcome IS NULL OR last_outcome = 'retry'").drop("last_outcome", "last_story")
            stored = rows.filter("last_story IS NOT NULL").select("id", "title", F.col("last_story").alias("event_id"))
        process(written(pending), stored=stored, **rules).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
