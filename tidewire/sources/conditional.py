"""Conditional requests: what a cache of validators holds and replays, answer by answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def replay(answers: DataFrame, *, max_body: int = 400_000, slice_hours: int = 24, missing_hours: int = 6) -> DataFrame:
    """The answers (url, at, seq, status, etag, body) with what the cache had before and what came of each.

    Adds sent_etag (the validator that goes with the request), outcome, used
    (the body that the reader gets), metered, version, stored_at and ask_again.
    A 200 with validator and body of at most ``max_body`` characters is
    ``stored`` and replaces what there was; any other 200 is ``fresh`` and
    leaves the cache alone. A 304 costs nothing and gives the stored body
    (``replayed``); without one it is ``empty``, which must not be read as no
    news. A 404 is ``missing``: not to be asked again for ``missing_hours``.
    Anything else is an ``error``. ``version`` counts how often the stored
    validator or body has changed, this answer included.

    Answers of a url are in the order of (at, seq), which must differ. Rows
    without url or time are left out. A url's answers are dealt into slices of
    ``slice_hours``; only the last record and the count of a slice go on to the
    next, so no task sees more of a busy url than a slice.
    """
    rows = answers.filter("url IS NOT NULL AND at IS NOT NULL").withColumn("slice", F.floor(F.unix_seconds(F.col("at").cast("timestamp")) / (slice_hours * 3600)))
    storable = (F.col("status") == 200) & (F.coalesce("etag", F.lit("")) != "") & (F.coalesce("body", F.lit("")) != "") & (F.length("body") <= max_body)
    rows = rows.withColumn("record", F.when(storable, F.struct("etag", "body", F.col("at").alias("stored_at"))))

    def latest(df: DataFrame, order: list[str], *by: str) -> Column:
        return F.last("record", ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))

    # The last record of each slice, and of all slices before it.
    order = F.struct("at", "seq")
    slices = rows.filter("record IS NOT NULL").groupBy("url", "slice").agg(F.max_by("record", order).alias("record"))
    every = rows.select("url", "slice").distinct().join(slices, ["url", "slice"], "left")
    carried = every.withColumn("carried", latest(every, ["slice"], "url")).drop("record")
    own = rows.withColumn("inside", latest(rows, ["at", "seq"], "url", "slice")).join(carried, ["url", "slice"])
    own = own.withColumn("before", F.coalesce("inside", "carried"))
    changed = F.col("record").isNotNull() & ~(F.col("record.etag").eqNullSafe(F.col("before.etag")) & F.col("record.body").eqNullSafe(F.col("before.body")))
    own = own.withColumn("changed", changed.cast("long"))
    counts = own.groupBy("url", "slice").agg(F.sum("changed").alias("n"))
    counts = counts.select("url", "slice", F.coalesce(F.sum("n").over(Window.partitionBy("url").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("versions"))
    own = own.join(counts, ["url", "slice"]).withColumn("version", F.col("versions") + F.sum("changed").over(Window.partitionBy("url", "slice").orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, 0)))
    has = F.col("before").isNotNull()
    outcome = (
        F.when(F.col("record").isNotNull(), "stored")
        .when(F.col("status") == 200, "fresh")
        .when((F.col("status") == 304) & has, "replayed")
        .when(F.col("status") == 304, "empty")
        .when(F.col("status") == 404, "missing")
        .otherwise("error")
    )
    return own.select(
        *answers.columns,
        F.col("before.etag").alias("sent_etag"),
        outcome.alias("outcome"),
        F.when(F.col("status") == 200, F.col("body")).when(F.col("status") == 304, F.col("before.body")).alias("used"),
        (F.coalesce("status", F.lit(0)) != 304).alias("metered"),
        "version",
        F.coalesce(F.col("record.stored_at"), F.col("before.stored_at")).alias("stored_at"),
        F.when(F.col("status") == 404, F.col("at") + F.expr(f"INTERVAL {missing_hours} HOURS")).alias("ask_again"),
    )


def cache_after(replayed: DataFrame) -> DataFrame:
    """(url, etag, body, version, stored_at, used_at): the cache after all answers; ``used_at`` is the last time that a record was stored or replayed."""
    order = F.struct("at", "seq")
    last = replayed.groupBy("url").agg(
        F.max_by(F.when(F.col("outcome") == "stored", F.col("etag")).otherwise(F.col("sent_etag")), order).alias("etag"),
        F.max_by("version", order).alias("version"),
        F.max_by("stored_at", order).alias("stored_at"),
        F.max(F.when(F.col("outcome").isin("stored", "replayed"), F.col("at"))).alias("used_at"),
    )
    bodies = replayed.filter("outcome = 'stored'").groupBy("url").agg(F.max_by("body", order).alias("body"))
    return last.filter("etag IS NOT NULL").join(bodies, "url").select("url", "etag", "body", "version", "stored_at", "used_at")
