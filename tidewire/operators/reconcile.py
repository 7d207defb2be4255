"""Books put right: rows that were decided wrongly or left half decided, changed once and then no more."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import present
from . import classify

#: The repairs, in order; each sees what those before it have changed.
STEPS = ("regate", "spam", "matters", "processed", "ghost", "lost")
#: What articles must have.
ARTICLE = (
    "id long, title string, content string, source_name string, stars int, event_id long, filtered_out boolean, is_processed boolean, is_archived boolean, is_sent boolean, "
    "published_at timestamp_ntz, created_at timestamp_ntz, processed_at timestamp_ntz, attempts int, why_it_matters string, source_quality double, final_score double, heat double, "
    "breaking_reason string, deferred boolean, lost_reason string"
)


def _set(df: DataFrame, step: str, where: Column, changes: dict[str, Column]) -> DataFrame:
    """The rows that ``where`` holds for, changed, with the step in their notes."""
    hit = F.coalesce(where, F.lit(False))
    note = F.when(hit, F.array_append("notes", F.lit(step))).otherwise(F.col("notes"))
    marked = df.withColumn("hit", hit)
    return marked.withColumns({"notes": F.when(F.col("hit"), note).otherwise(F.col("notes")), **{c: F.when(F.col("hit"), v).otherwise(F.col(c)) for c, v in changes.items()}}).drop("hit")


def reconcile(articles: DataFrame, readers: DataFrame, ledger: DataFrame, *, as_of: Column, keywords: list[str], phantom: int, regate_days: int = 7, gate: dict | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(articles, readers, counts) after all repairs; done again, nothing changes.

    - regate: dropped in the last days, but the vocabulary of today keeps it:
      it is to be processed anew. What the next step would drop stays dropped.
    - spam: a trending repository without a star is no news.
    - matters: a visible article without a reason to read it gets one, if other
      sources have its story or it is much discussed.
    - processed: a decision without a time takes that of its arrival.
    - ghost: the reader of tests goes, unless the ledger knows them.
    - lost: an alert that was held back and never booked, and which the gate no
      longer passes, says why it won't come.

    ``articles`` has ``ARTICLE``; the result adds ``notes``, the steps that
    changed a row. ``counts`` has (step, n) for every step. Nulls count as
    false, an unknown number of stars isn't 0.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    rows = articles.withColumn("notes", F.array().cast("array<string>"))
    trash = F.contains(F.coalesce("source_name", F.lit("")), F.lit("Trending")) & F.coalesce(F.col("stars") == 0, F.lit(False))
    gated = classify.keyword_gate(rows.withColumn("is_free_offer", F.lit(False)), keywords).drop("is_free_offer")
    late = F.col("published_at") >= as_of - F.expr(f"INTERVAL {regate_days} DAYS")
    rows = _set(gated, "regate", yes("filtered_out") & ~yes("is_archived") & late & F.col("keep") & ~trash, {"filtered_out": F.lit(False), "is_processed": F.lit(False), "processed_at": F.lit(None).cast("timestamp_ntz"), "attempts": F.lit(0)}).drop("keep", "hits")
    rows = _set(rows, "spam", trash & ~yes("filtered_out"), {"filtered_out": F.lit(True), "is_processed": F.lit(True)})

    # The other sources of a story, of articles that can be seen now.
    seen = rows.filter(~yes("filtered_out") & ~yes("is_archived") & F.col("event_id").isNotNull())
    sides = seen.groupBy(F.col("event_id").alias("story")).agg(F.array_sort(F.collect_set("source_name")).alias("sources"))
    rows = rows.join(sides, rows["event_id"] == sides["story"], "left").drop("story")
    others = F.array_except(F.coalesce("sources", F.array().cast("array<string>")), F.array("source_name"))
    reason = present.why_it_matters(others, F.col("heat"), F.lit(False))
    visible = yes("is_processed") & ~yes("is_archived") & ~yes("filtered_out")
    rows = _set(rows, "matters", visible & F.col("why_it_matters").isNull() & (reason != ""), {"why_it_matters": reason}).drop("sources")
    rows = _set(rows, "processed", yes("is_processed") & F.col("processed_at").isNull() & F.col("created_at").isNotNull(), {"processed_at": F.col("created_at")})
    asked = classify.breaking_gate(rows, as_of=as_of, **(gate or {}))
    held = ~yes("is_sent") & F.col("breaking_reason").isNotNull() & ~yes("deferred") & F.col("lost_reason").isNull()
    rows = _set(asked, "lost", held & ~F.col("passes"), {"lost_reason": F.concat(F.lit("held back, and now: "), F.col("verdict"))}).drop("verdict", "passes")
    rows = rows.select(*articles.columns, "notes")

    known = ledger.select("user_id").distinct()
    ghosts = readers.filter(F.col("user_id") == phantom).join(known, "user_id", "left_anti")
    left = readers.join(ghosts.select("user_id"), "user_id", "left_anti").select(*readers.columns)
    counted = rows.select(F.explode("notes").alias("step")).groupBy("step").agg(F.count("*").alias("n"))
    counted = counted.unionByName(ghosts.agg(F.lit("ghost").alias("step"), F.count("*").alias("n")))
    every = articles.sparkSession.createDataFrame([(s,) for s in STEPS], "step string")
    counts = every.join(counted, "step", "left").select("step", F.coalesce("n", F.lit(0)).alias("n"))
    return rows, left, counts
