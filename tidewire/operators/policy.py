"""Pacing of pushes: caps by local day, cooldowns, quiet hours, due briefings, streaks."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .feed import at


def local_day(ts: Column, zone: str) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts).cast("date")


def minute_of_day(ts: Column, zone: str) -> Column:
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)
    return F.hour(local) * 60 + F.minute(local)


def clock_minutes(text: Column) -> Column:
    """Minutes of an "HH:MM"; null for anything else."""
    h, m = F.regexp_extract(text, r"^\s*(\d{1,2}):(\d{2})\s*$", 1).try_cast("int"), F.regexp_extract(text, r"^\s*(\d{1,2}):(\d{2})\s*$", 2).try_cast("int")
    return F.when((h < 24) & (m < 60), h * 60 + m)


def in_quiet_hours(minute: Column, begin: Column, end: Column) -> Column:
    """The start belongs to the window, the end doesn't; it may pass midnight; equal or missing bounds mean none."""
    plain = (minute >= begin) & (minute < end)
    wrapped = (minute >= begin) | (minute < end)
    return F.coalesce(F.when(begin < end, plain).when(begin > end, wrapped).otherwise(F.lit(False)), F.lit(False))


def hours_until(minute: Column, end: Column) -> Column:
    gap = F.pmod(end - minute, F.lit(1440))
    return F.when(gap == 0, 1440).otherwise(gap) / 60.0


def paced(pushes: DataFrame, *, user: str = "user_id", ts: str = "ts", key: str = "event_id", cooldown_minutes: int = 60, per_day: int = 5, zone: str = "UTC") -> DataFrame:
    """The pushes that may go out: each at least a cooldown after the last that did, at most ``per_day`` on a local day.

    Every push is an attempt of its own, that nothing spares the cooldown; see
    ``pacing.paced_rounds``, whose slices of a day keep a busy reader from being
    one task. Keys are whole numbers and differ; times count in milliseconds.
    """
    from .pacing import paced_rounds

    attempts = pushes.select(F.col(user).alias("user_id"), F.col(ts).alias("round_at"), F.col(key).cast("bigint").alias("article_id"), F.lit(True).alias("reissue"), F.unix_micros(F.col(ts).cast("timestamp")).alias("place"))
    sent = paced_rounds(attempts, cooldown_minutes=cooldown_minutes, per_day=per_day, zone=zone).filter("verdict = 'sent'")
    return sent.select(F.col("user_id").alias(user), F.col("round_at").alias(ts), F.col("article_id").alias(key))


def streaks(outcomes: DataFrame, *, key: str = "user_id", ts: str = "ts", tie: str = "event_id", ok: Column) -> DataFrame:
    """Each outcome with the failures in a row up to it."""
    order = Window.partitionBy(key).orderBy(ts, tie)
    marked = outcomes.withColumn("ok", ok).withColumn("island", F.sum(F.col("ok").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    failed = F.sum((~F.col("ok")).cast("int")).over(Window.partitionBy(key, "island").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("streak", failed).drop("island")


def pushes_since(ledger: DataFrame, *, user_id: int | None, kind: str, since: datetime) -> DataFrame:
    """How many a reader had; no reader means none, never all."""
    own = F.lit(False) if user_id is None else F.col("user_id") == user_id
    return ledger.filter(own & (F.col("kind") == kind) & (F.col("created_at") >= at(since))).agg(F.count("*").alias("n"))


def last_push(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("user_id", "kind").agg(F.max_by("id", F.struct("created_at", "id")).alias("id"), F.max("created_at").alias("created_at"))


def digest_state(readers: DataFrame, ledger: DataFrame, *, now: datetime, kind: str, clock: str, grace: int = 45) -> DataFrame:
    """bad time, not yet, sent today, closed or due, asked in this order, by each reader's own clock and day."""
    moment = at(now)
    today = F.convert_timezone(F.lit("UTC"), F.col("zone"), moment).cast("date")
    local = F.convert_timezone(F.lit("UTC"), F.col("zone"), moment)
    timed = readers.withColumn("due", clock_minutes(F.col(clock))).withColumn("minute", F.hour(local) * 60 + F.minute(local)).withColumn("today", today)
    sent = ledger.filter(F.col("kind") == kind).select("user_id", "created_at")
    had = timed.join(sent, "user_id").filter(F.convert_timezone(F.lit("UTC"), F.col("zone"), F.col("created_at")).cast("date") == F.col("today")).select("user_id").distinct().withColumn("had", F.lit(True))
    state = (
        F.when(F.col("due").isNull(), "bad time")
        .when(F.col("minute") < F.col("due"), "not yet")
        .when(F.coalesce("had", F.lit(False)), "sent today")
        .when(F.col("minute") > F.col("due") + grace, "closed")
        .otherwise("due")
    )
    return timed.join(had, "user_id", "left").withColumn("state", state).drop("had", "due", "minute", "today")


def within_budget(queue: DataFrame, *, cost: str, order: list[Column], budget: int, key: str) -> DataFrame:
    """The head of each ordered queue whose running cost stays in the budget."""
    spent = F.sum(cost).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return queue.withColumn("spent", spent).filter(F.col("spent") <= budget)


def trend(samples: DataFrame, *, key: str, ts: str, value: str, hours: int = 24) -> DataFrame:
    """Change over the last hours before each key's newest sample; days left only if it falls over half a day or more."""
    last = samples.groupBy(key).agg(F.max(ts).alias("newest"))
    near = samples.join(last, key).filter(F.col(ts) >= F.col("newest") - F.expr(f"INTERVAL {hours} HOURS"))
    out = near.groupBy(key).agg(F.min(ts).alias("begin"), F.max(ts).alias("end"), F.min_by(value, ts).alias("first"), F.max_by(value, ts).alias("last"))
    span = F.timestamp_diff("SECOND", F.col("begin"), F.col("end")) / 3600.0
    out = out.withColumn("span_hours", span).withColumn("delta", F.when(span >= 1, F.col("last") - F.col("first")))
    left = F.when((F.col("delta") < 0) & (F.col("span_hours") >= 12), F.col("last") / (-F.col("delta") / (F.col("span_hours") / 24.0)))
    return out.withColumn("days_left", left)
