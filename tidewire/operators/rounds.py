"""A round of processing: settle new rows, link them to stories, carry retries, merge a model's answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import rounded
from .vocabulary import contained


def source_hint(articles: DataFrame, hints: dict[str, tuple[str, float]], *, column: str = "source_name", none_for: tuple[str, ...] = ("reddit", "hacker news")) -> DataFrame:
    """Adds hint_category and hint_weight: the first pattern in order that the source's name holds; crowd sources give none."""
    name = F.lower(F.coalesce(F.col(column), F.lit("")))
    crowd = F.lit(False)
    for n in none_for:
        crowd = crowd | F.contains(name, F.lit(n))
    category, weight = F.when(crowd, F.lit(None).cast("string")), F.when(crowd, F.lit(0.0))
    for pattern, (c, w) in hints.items():
        category, weight = category.when(F.contains(name, F.lit(pattern)), c), weight.when(F.contains(name, F.lit(pattern)), float(w))
    return articles.withColumn("hint_category", category).withColumn("hint_weight", weight.otherwise(0.0))


def merge_model(articles: DataFrame, *, low: float = 40.0, cap: float = 25.0) -> DataFrame:
    """Adds category, confidence and importance: a model's answer (columns ai_*) where there is one, else the rule's.

    Needs rule_category, confidence, rule_importance, ai_category,
    ai_confidence, ai_importance, ai_relevance, ai_on_topic. What the model
    calls off topic, at a relevance under ``low``, weighs ``cap`` at most.
    """
    value = F.coalesce(F.col("ai_importance").cast("double"), F.col("rule_importance").cast("double"))
    off = F.coalesce(~F.col("ai_on_topic") & (F.col("ai_relevance") < low), F.lit(False))
    return articles.withColumns(
        {
            "category": F.coalesce(F.nullif(F.trim("ai_category"), F.lit("")), F.col("rule_category")),
            "confidence": F.coalesce(F.col("ai_confidence"), F.col("confidence")),
            "importance": F.when(off, F.least(value, F.lit(cap))).otherwise(value),
        }
    )


def settle(pending: DataFrame, *, keep: Column, failed: Column, strikes: int = 3) -> DataFrame:
    """Adds state and attempts_after: filtered, abandoned, retry or processed, one state for each pending row.

    A row that the gate drops is done, whatever fails. One that failed is tried
    again until it has failed ``strikes`` times. Needs ``attempts``.
    """
    tries = F.coalesce(F.col("attempts"), F.lit(0)) + F.coalesce(failed, F.lit(False)).cast("int")
    state = F.when(~F.coalesce(keep, F.lit(False)), "filtered").when(F.coalesce(failed, F.lit(False)) & (tries >= strikes), "abandoned").when(F.coalesce(failed, F.lit(False)), "retry").otherwise("processed")
    return pending.withColumn("state", state).withColumn("attempts_after", F.when(state == "filtered", F.coalesce(F.col("attempts"), F.lit(0))).otherwise(tries))


def link_stories(articles: DataFrame, leaders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(articles with event_id, stories): siblings join their leader's story, which is made where there is none.

    ``leaders`` has (id, leader). A story that a leader is in already goes on;
    new ones are numbered by their leader's id. The story's columns are worked
    out anew from all of its members: article_count, source_count, best_id (of
    highest score, then newest), first_seen, last_seen. The siblings take the
    best score; each one's novelty falls by 25 for not being the first.
    """
    groups = leaders.select(F.col("id").alias("member"), "leader")
    sizes = groups.groupBy("leader").agg(F.count("*").alias("size"))
    lead = articles.select(F.col("id").alias("leader"), F.col("event_id").alias("lead_event"))
    placed = articles.join(groups, articles["id"] == groups["member"], "left").drop("member")
    placed = placed.join(sizes, "leader", "left").join(lead, "leader", "left")
    grouped = F.coalesce(F.col("size") > 1, F.lit(False))
    event = F.when(grouped, F.coalesce("lead_event", "leader")).otherwise(F.col("event_id"))
    placed = placed.withColumn("event_id", event).withColumn("sibling", grouped & (F.col("id") != F.col("leader")))
    order = F.struct("final_score", "published_at", "id")
    stories = placed.filter("event_id IS NOT NULL").groupBy("event_id").agg(
        F.count("*").alias("article_count"),
        F.count_distinct("source_name").alias("source_count"),
        F.max_by("id", order).alias("best_id"),
        F.max("final_score").alias("best_score"),
        F.min("published_at").alias("first_seen"),
        F.max("published_at").alias("last_seen"),
    )
    best = stories.select("event_id", F.col("best_score").alias("story_score"))
    out = placed.join(best, "event_id", "left").withColumn("final_score", F.when(F.col("sibling"), F.coalesce("story_score", "final_score")).otherwise(F.col("final_score")))
    if "novelty" in articles.columns:
        out = out.withColumn("novelty", F.when(F.col("sibling"), F.greatest(F.lit(0.0), F.col("novelty") - 25)).otherwise(F.col("novelty")))
    return out.select(*articles.columns, "sibling"), stories


def deferrals(stored: DataFrame, verdicts: DataFrame, *, timing: tuple[str, ...], most_tries: int = 12) -> DataFrame:
    """The retry marks after a round: id, tries, reason.

    ``verdicts`` has (id, verdict). A verdict that only waits for its time is
    marked, with one try more than before, until ``most_tries``; any other
    clears the mark. Marks of articles that weren't looked at stay.
    """
    seen = verdicts.select("id", "verdict")
    both = stored.select("id", "tries", "reason").join(seen, "id", "full_outer")
    tries = F.coalesce(F.col("tries"), F.lit(0)) + F.when(F.col("verdict").isNotNull(), 1).otherwise(0)
    waits = F.col("verdict").isNull() | F.col("verdict").isin(*timing)
    return both.filter(waits).select("id", tries.alias("tries"), F.coalesce("verdict", "reason").alias("reason")).filter(F.col("tries") <= most_tries)


def missing_until(failures: DataFrame, *, key: str, at: str, hours: int = 6) -> DataFrame:
    """(key, missing_until): what was not found is not asked for again until then."""
    return failures.groupBy(key).agg(F.max(at).alias("last")).select(key, (F.col("last") + F.expr(f"INTERVAL {hours} HOURS")).alias("missing_until"))


def may_fetch(wanted: DataFrame, missing: DataFrame, *, key: str, now: Column) -> DataFrame:
    """The wanted rows that no negative entry still holds back."""
    return wanted.join(missing.filter(F.col("missing_until") > now).select(key), key, "left_anti")


def vendor_models(models: DataFrame, vendors: DataFrame, *, most: int = 4) -> DataFrame:
    """(vendor, model ids): each vendor's first models by id whose id or name holds the vendor's name, in any case, ``most`` at most.

    The names are a vocabulary table, met by their rarest run of characters, so
    that neither models nor vendors need to be few.
    """
    texts = models.select(F.col("id").cast("string").alias("id"), F.concat_ws(" ", "id", "name").alias("text"))
    hits = contained(texts, vendors, term_col="vendor").withColumnRenamed("term", "vendor").withColumnRenamed("id", "hit")
    own = hits.join(models.select(F.col("id"), F.col("id").cast("string").alias("hit")), "hit")
    first = Window.partitionBy("vendor").orderBy("id")
    ranked = own.withColumn("at", F.row_number().over(first)).filter(F.col("at") <= most)
    return ranked.groupBy("vendor").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def resolve_reference(messages: DataFrame, listed: DataFrame, *, text: str = "text", user: str = "user_id") -> DataFrame:
    """Adds article_id: of ``#123`` the id, of ``no. 3`` the reader's third remembered article, else null.

    ``listed`` has (user_id, position, article_id), the last list a reader was shown.
    """
    direct = F.regexp_extract(text, r"#(\d{1,18})", 1).try_cast("long")
    nth = F.coalesce(F.regexp_extract(text, r"(?i)\b(?:no\.?|number) ?(\d{1,3})\b", 1).try_cast("int"), F.regexp_extract(text, r"第 ?(\d{1,3}) ?条", 1).try_cast("int"))
    asked = messages.withColumn("asked_id", direct).withColumn("position", F.when(direct.isNull(), nth))
    return asked.join(listed.select(user, "position", F.col("article_id").alias("listed_id")), [user, "position"], "left").withColumn("article_id", F.coalesce("asked_id", "listed_id")).drop("asked_id", "listed_id", "position")


def page_header(total: Column, shown: Column, page: Column, size: int) -> Column:
    """What stands above a page of a list."""
    pages = F.greatest(F.lit(1), F.ceil(total / size)).cast("int")
    return F.when(total == 0, "nothing found").when(pages == 1, F.concat(total.cast("string"), F.lit(" in all"))).otherwise(F.format_string("%d in all, %d shown, page %d of %d", total.cast("long"), shown.cast("long"), page.cast("int"), pages))


def is_breaking(articles: DataFrame, threshold: float = 80.0, *, score: str = "final_score") -> DataFrame:
    return articles.withColumn("breaking", F.coalesce(F.col(score) >= threshold, F.lit(False)))


def rolling(events: DataFrame, *, key: str, ts: str, hours: int = 24) -> DataFrame:
    """Adds n_rolling: the key's events in the ``hours`` up to each one, itself included, over any midnight."""
    seconds = F.unix_seconds(F.col(ts).cast("timestamp"))
    frame = Window.partitionBy(key).orderBy(seconds).rangeBetween(-hours * 3600 + 1, 0)
    return events.withColumn("n_rolling", F.count("*").over(frame))


def normalized_offers(articles: DataFrame, found: DataFrame) -> DataFrame:
    """The articles with what an offer detector found (id, tool, confidence) written back: set where found, cleared where not."""
    new = found.select("id", F.col("tool").alias("found_tool"), F.col("confidence").alias("found_confidence"))
    both = articles.join(new, "id", "left")
    is_offer = F.col("found_tool").isNotNull()
    changed = ~is_offer.eqNullSafe(F.coalesce("is_free_offer", F.lit(False))) | (is_offer & ~F.col("found_tool").eqNullSafe(F.col("free_tool")))
    return both.withColumns({"changed": changed, "is_free_offer": is_offer, "free_tool": F.col("found_tool"), "free_confidence": rounded(F.coalesce("found_confidence", F.lit(0.0)), 2)}).drop("found_tool", "found_confidence")


def extend_vocabulary(known: DataFrame, seen: DataFrame, *, least: int = 4) -> DataFrame:
    """(word): a vocabulary with the names seen at run time, lower-case, ``least`` characters or more, each once."""
    new = seen.select(F.lower(F.trim("word")).alias("word")).filter(F.length("word") >= least)
    return known.select(F.lower("word").alias("word")).union(new).distinct()
