"""Small and large state tables: upserts, diffs, ledgers, caches. Parquet has no merge, so each returns the new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_new(stored: DataFrame, incoming: DataFrame, keys: tuple[str, ...] = ("url_hash", "hash"), order: str = "id") -> DataFrame:
    """The incoming rows that no stored row equals in any key, the first of those that equal each other.

    A null key equals nothing: such rows stay, apart from what their other keys say.
    """
    number = "row_of_key"
    while number in incoming.columns:
        number = "_" + number
    fresh = incoming
    for key in keys:
        fresh = fresh.join(stored.select(key).distinct(), key, "left_anti")
        # Rows without the key are spread by their order value, so that they are no group of their own.
        first = Window.partitionBy(key, F.when(F.col(key).isNull(), F.col(order))).orderBy(order)
        fresh = fresh.withColumn(number, F.row_number().over(first)).filter((F.col(number) == 1) | F.col(key).isNull()).drop(number)
    return fresh.select(incoming.columns)


def merge_sightings(stored: DataFrame, seen: DataFrame, key: str = "url_hash") -> DataFrame:
    """Seen again: empty content is filled, heat only rises, and ``touched`` tells which rows changed."""
    new = seen.groupBy(key).agg(F.max("heat").alias("n_heat"), F.max(F.nullif("content", F.lit(""))).alias("n_content"))
    both = stored.join(new, key, "left")
    content = F.coalesce(F.nullif("content", F.lit("")), F.col("n_content"), F.lit(""))
    heat = F.greatest(F.col("heat"), F.coalesce("n_heat", F.col("heat")))
    touched = ~content.eqNullSafe(F.coalesce("content", F.lit(""))) | ~heat.eqNullSafe(F.col("heat"))
    return both.withColumn("touched", touched).withColumn("content", content).withColumn("heat", heat).drop("n_heat", "n_content")


def sync_registry(stored: DataFrame, configured: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Full-outer upsert of a registry: ``changed`` counts fields that differ; rows that left the configuration are disabled."""
    old = stored.select(key, *[F.col(f).alias(f"o_{f}") for f in fields], F.col("enabled").alias("o_enabled"), F.lit(True).alias("was"))
    new = configured.select(key, *fields, "enabled", F.lit(True).alias("now"))
    both = old.join(new, key, "full_outer")
    diffs = sum((F.when(F.col("now") & F.col("was") & ~F.col(f).eqNullSafe(F.col(f"o_{f}")), 1).otherwise(0) for f in fields), F.lit(0))
    values = [F.when(F.col("now"), F.col(f)).otherwise(F.col(f"o_{f}")).alias(f) for f in fields]
    enabled = F.when(F.col("now"), F.col("enabled")).otherwise(F.lit(False)).alias("enabled")
    state = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("kept").alias("state")
    return both.select(key, *values, enabled, diffs.alias("changed"), state)


def snapshot_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    a, b = before.select(key).distinct(), after.select(key).distinct()
    ended = a.join(b, key, "left_anti").withColumn("change", F.lit("ended"))
    return ended.unionByName(b.join(a, key, "left_anti").withColumn("change", F.lit("new")))


def first_seen(history: DataFrame, key: str, ts: str) -> DataFrame:
    return history.groupBy(key).agg(F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"))


def evict(cache: DataFrame, *, at: str, size: str, most_rows: int, most_bytes: int) -> DataFrame:
    """The newest ``most_rows`` records while their sizes fit; what passes the sum goes with all that is colder."""
    newest = cache.orderBy(F.desc(at), F.desc("key")).limit(most_rows)
    spent = F.sum(size).over(Window.orderBy(F.desc(at), F.desc("key")).rowsBetween(Window.unboundedPreceding, 0))
    return newest.withColumn("_spent", spent).filter(F.col("_spent") <= most_bytes).drop("_spent")


def cooldown_seconds(retry_after: Column) -> Column:
    """From 30 seconds to 6 hours; half an hour where the host gave none."""
    return F.least(F.greatest(F.coalesce(retry_after, F.lit(1800)), F.lit(30)), F.lit(21600))


def set_interests(stored: DataFrame, items: DataFrame, *, replace: bool = False) -> DataFrame:
    """(user_id, type, value) without empty values, each once in any case, 120 characters at most."""
    clean = items.withColumn("value", F.substring(F.trim("value"), 1, 120)).filter("value <> ''").withColumn("folded", F.lower("value"))
    first = clean.groupBy("user_id", "type", "folded").agg(F.min("value").alias("value"))
    base = stored.withColumn("folded", F.lower("value"))
    if replace:
        base = base.join(clean.select("user_id").distinct(), "user_id", "left_anti")
    added = first.join(base.select("user_id", "type", "folded"), ["user_id", "type", "folded"], "left_anti")
    return base.select("user_id", "type", "value").unionByName(added.select("user_id", "type", "value"))


def cooldowns(asks: DataFrame, *, now: Column, least: int = 30, most: int = 21_600) -> DataFrame:
    """(host, until, seconds_left): the hosts that asked for quiet and still have it.

    ``asks`` has (url, at, seconds), what each refusal asked for; it is brought
    between ``least`` and ``most`` seconds. The last ask of a host counts, the
    longer of two at a time; hosts whose time is over are left out, as are
    addresses without a host.
    """
    from ..functions.urls import host

    wait = F.least(F.greatest(F.coalesce("seconds", F.lit(least)), F.lit(least)), F.lit(most)).cast("long")
    rows = asks.select(host(F.col("url")).alias("host"), "at", wait.alias("wait")).filter("host <> '' AND at IS NOT NULL")
    last = rows.groupBy("host").agg(F.max_by("wait", F.struct("at", "wait")).alias("wait"), F.max("at").alias("at"))
    until = F.timestamp_add("SECOND", F.col("wait").cast("int"), F.col("at"))
    left = F.timestamp_diff("SECOND", now, F.col("until"))
    return last.select("host", until.alias("until")).filter(F.col("until") > now).withColumn("seconds_left", left)


def may_ask(urls: DataFrame, parked: DataFrame) -> DataFrame:
    """The rows whose url's host isn't parked."""
    from ..functions.urls import host

    return urls.join(parked.select("host"), host(urls["url"]) == parked["host"], "left_anti")
