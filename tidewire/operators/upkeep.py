"""Repairs of single columns, readers and their audits, and the report on the whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import present
from ..functions.text import keyword_hits
from .vocabulary import contained


def event_trigger(articles: DataFrame, patterns: list[str], *, exclude: list[str] = (), blocked: list[str] = ()) -> DataFrame:
    """Adds trigger, what of the title tells of an event, and blocked_source.

    The leftmost match of any pattern counts, in any case; a title that an
    ``exclude`` pattern matches has none, nor has a null title. ``blocked`` are
    patterns of source names.
    """
    either = lambda ps: "(?i)(?:" + "|".join(f"(?:{p})" for p in ps) + ")"
    found = F.nullif(F.regexp_extract("title", either(patterns), 0), F.lit("")) if patterns else F.lit(None).cast("string")
    if exclude:
        found = F.when(~F.col("title").rlike(either(exclude)), found)
    block = F.coalesce(F.col("source_name").rlike(either(blocked)), F.lit(False)) if blocked else F.lit(False)
    return articles.withColumn("trigger", found).withColumn("blocked_source", block)


def recut_summaries(articles: DataFrame, *, as_of: Column, hours: int = 60, least: int = 100) -> DataFrame:
    """The recent articles whose summary was cut in a word, with the one that their content gives now; a translation of the old one goes.

    Of those that rules have processed: at least ``least`` characters, and not
    ending in an ellipsis unless a stray entity is left in it. Only a summary
    that isn't longer by more than a character takes its place.
    """
    recent = F.coalesce("is_processed", F.lit(False)) & (F.col("published_at") >= as_of - F.expr(f"INTERVAL {hours} HOURS"))
    old = F.trim("summary")
    cut = (F.length(old) >= least) & (~F.endswith(old, F.lit("…")) | F.contains(old, F.lit("&")))
    by_rule = (F.col("pipeline") == "rule") & (F.coalesce("content", F.lit("")) != "")
    rows = articles.filter(recent & cut & by_rule)
    # Exploded, so that the filter below doesn't cut the content into sentences again for each use.
    rows = rows.withColumn("rebuilt", F.explode(F.array(F.trim(present.fallback_summary(F.col("title"), F.col("content"))["summary"]))))
    rows = rows.filter((F.coalesce("rebuilt", F.lit("")) != "") & (F.col("rebuilt") != old) & (F.length("rebuilt") <= F.length(old) + 1))
    return rows.withColumns({"summary": F.col("rebuilt"), "summary_zh": F.lit(None).cast("string")}).drop("rebuilt")


def requeue_stubs(articles: DataFrame, *, as_of: Column, hours: int = 36, floor: int = 600, limit: int = 20) -> DataFrame:
    """The ids of short recent articles to be processed anew: of the three times ``limit`` best, the first that nobody tried to fetch yet."""
    short = F.coalesce("is_processed", F.lit(False)) & ~F.coalesce("is_archived", F.lit(False)) & (F.col("published_at") >= as_of - F.expr(f"INTERVAL {hours} HOURS")) & (F.length("content") < floor)
    best = [F.desc("final_score"), F.desc("id")]
    return articles.filter(short).orderBy(*best).limit(3 * limit).filter("enriched IS NULL").orderBy(*best).limit(limit).select("id")


def stale_translations(articles: DataFrame, *, floor: int = 600, limit: int = 200) -> DataFrame:
    """The ids of articles whose translation is of the text before its page was fetched, newest first."""
    stale = F.col("summary_zh").isNotNull() & (F.length("content") >= floor) & F.coalesce("enriched", F.lit(False)) & ~F.coalesce("translation_reset", F.lit(False))
    return articles.filter(stale).orderBy(F.desc("id")).limit(limit).select("id")


def enrich(articles: DataFrame, bodies: DataFrame, *, floor: int = 600, budget: int | None = None) -> DataFrame:
    """The articles with the text of their page (url, body) where they are stubs and it is longer.

    A stub has fewer than ``floor`` characters; of stubs the ``budget`` best by
    score, then id, are tried, all without a budget. What was tried is marked
    ``enriched``, true if it gained; a gain drops the translation of the old
    text. Without a page nothing is gained. Of several bodies of an address the longest counts.
    """
    page = bodies.groupBy("url").agg(F.max_by("body", F.struct(F.length("body"), "body")).alias("page"))
    stub = F.length(F.coalesce("content", F.lit(""))) < floor
    rows = articles.join(page, "url", "left").withColumn("tried", stub)
    if budget is not None:
        first = rows.filter("tried").orderBy(F.desc("final_score"), "id").limit(budget).select("id", F.lit(True).alias("chosen"))
        rows = rows.join(first, "id", "left").withColumn("tried", F.coalesce("chosen", F.lit(False))).drop("chosen")
    gained = F.col("tried") & F.coalesce(F.length("page") > F.length(F.coalesce("content", F.lit(""))), F.lit(False))
    rows = rows.withColumn("gained", gained)
    rows = rows.withColumns({"content": F.when(F.col("gained"), F.col("page")).otherwise(F.col("content")), "summary_zh": F.when(~F.col("gained"), F.col("summary_zh")), "enriched": F.when(F.col("tried"), F.col("gained")).otherwise(F.col("enriched"))})
    return rows.select(*articles.columns)


def allowed(rows: DataFrame, allowlist: DataFrame, *, key: str = "user_id") -> DataFrame:
    """The rows of those on the list; an empty list lets nobody in, and a null id is nobody."""
    return rows.join(allowlist.select(key).distinct(), key, "left_semi")


def warn_once(events: DataFrame, *, key: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """The first event of each key; rows that repeat it are told no more. A null key is a key."""
    return events.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("n = 1").drop("n")


def quota(readers: DataFrame, ledger: DataFrame, *, now: Column, kind: str, per_day: int) -> DataFrame:
    """(user_id, used, left): what each reader had on the present day of their own zone; nobody is left out."""
    local = lambda ts: F.convert_timezone(F.lit("UTC"), F.coalesce("zone", F.lit("UTC")), ts).cast("date")
    had = ledger.filter(F.col("kind") == kind).join(readers.select("user_id", "zone"), "user_id").filter(local(F.col("created_at")) == local(now))
    counts = had.groupBy("user_id").agg(F.count("*").alias("used"))
    return readers.select("user_id").join(counts, "user_id", "left").select("user_id", F.coalesce("used", F.lit(0)).alias("used")).withColumn("left", F.greatest(F.lit(0).cast("long"), per_day - F.col("used")))


def delivery_audit(readers: DataFrame, ledger: DataFrame, logs: DataFrame, *, now: Column, kinds: tuple[str, ...], hours: int = 48, tail: int = 6) -> DataFrame:
    """(user_id, kind, n, verdict, last_local, tail): for every reader and kind, whether it went out, and what the sender's log says.

    ``readers`` has user_id, zone, paused, and for each kind ``<kind>_on`` and
    ``<kind>_at`` ("HH:MM"); ``ledger`` (user_id, kind, created_at); ``logs``
    (user_id, at, line). ``n`` counts the last ``hours``. The first of these
    holds: paused, off, never, delivered today, overdue, pending; days and times
    are the reader's own. ``tail`` are the reader's last log lines, in order.
    """
    each = None
    for kind in kinds:
        own = readers.select("user_id", F.coalesce("zone", F.lit("UTC")).alias("zone"), "paused", F.lit(kind).alias("kind"), F.col(f"{kind}_on").alias("on"), F.col(f"{kind}_at").alias("due"))
        each = own if each is None else each.unionByName(own)
    sent = ledger.groupBy("user_id", "kind").agg(F.max("created_at").alias("last"), F.count_if(F.col("created_at") >= now - F.expr(f"INTERVAL {hours} HOURS")).alias("n"))
    rows = each.join(sent, ["user_id", "kind"], "left")
    local = lambda ts: F.convert_timezone(F.lit("UTC"), F.col("zone"), ts)
    verdict = (
        F.when(F.coalesce("paused", F.lit(False)), "paused")
        .when(~F.coalesce("on", F.lit(True)), "off")
        .when(F.col("last").isNull(), "never")
        .when(local(F.col("last")).cast("date") == local(now).cast("date"), "delivered today")
        .when(F.date_format(local(now), "HH:mm") >= F.coalesce("due", F.lit("")), "overdue")
        .otherwise("pending")
    )
    newest = Window.partitionBy("user_id").orderBy(F.desc("at"), F.desc("line"))
    tails = logs.withColumn("n", F.row_number().over(newest)).filter(F.col("n") <= tail)
    tails = tails.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda r: r["line"]).alias("tail"))
    rows = rows.withColumn("verdict", verdict).join(tails, "user_id", "left")
    return rows.select("user_id", "kind", F.coalesce("n", F.lit(0)).alias("n"), "verdict", F.date_format(local(F.col("last")), "MM-dd HH:mm:ss").alias("last_local"), F.coalesce("tail", F.array().cast("array<string>")).alias("tail"))


def upsert_readers(stored: DataFrame, changes: DataFrame, *, fields: tuple[str, ...]) -> DataFrame:
    """Readers by user_id: new ones are added, fields that a change gives replace the old, nulls change nothing; rows without an id are nobody's.

    Of several changes of a reader each field's last non-null value by ``at`` counts.
    """
    last = changes.filter("user_id IS NOT NULL").groupBy("user_id").agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col("at"))).alias(f"new_{f}") for f in fields])
    both = stored.join(last, "user_id", "full_outer")
    return both.select("user_id", *[F.coalesce(f"new_{f}", f).alias(f) for f in fields], *[c for c in stored.columns if c not in ("user_id", *fields)])


def reader_ids(allowlist: DataFrame, readers: DataFrame) -> DataFrame:
    """(user_id): those on the list in its order (place), then known readers by id, each once; readers who aren't on the list are left out unless it is empty."""
    listed = allowlist.groupBy("user_id").agg(F.min("place").alias("place"))
    some = listed.agg(F.count("*") > 0).scalar()
    known = readers.select("user_id").distinct().join(listed.select("user_id"), "user_id", "left_anti").filter(~some)
    return listed.unionByName(known.select("user_id", F.lit(None).cast(listed.schema["place"].dataType).alias("place"))).orderBy(F.col("place").asc_nulls_last(), "user_id").select("user_id")


def reader_views(readers: DataFrame, interests: DataFrame) -> DataFrame:
    """Readers as JSON with their interests by kind, each list sorted, without repeats in any case."""
    clean = interests.select("user_id", F.lower(F.trim("kind")).alias("kind"), F.lower(F.trim("value")).alias("value")).filter("value <> '' AND kind <> ''")
    lists = clean.groupBy("user_id", "kind").agg(F.array_sort(F.collect_set("value")).alias("values"))
    maps = lists.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("kind", "values"))).alias("interests"))
    own = F.coalesce("interests", F.array().cast("array<struct<kind:string,values:array<string>>>"))
    rows = readers.join(maps, "user_id", "left")
    doc = F.struct(*[F.col(c) for c in readers.columns], F.map_from_entries(own).alias("interests"))
    return rows.select("user_id", F.to_json(doc, {"ignoreNullFields": "false"}).alias("doc"))


def interest_payload(interests: DataFrame, *, limit: int = 50) -> DataFrame:
    """(kind, value, weight, readers): what all readers together wish for, in any case, most wanted first.

    A reader's weight for a value is the highest they gave; the payload's is the mean over those who named it.
    """
    own = interests.select("user_id", F.lower(F.trim("kind")).alias("kind"), F.lower(F.trim("value")).alias("value"), F.coalesce("weight", F.lit(1.0)).alias("weight")).filter("value <> ''")
    own = own.groupBy("user_id", "kind", "value").agg(F.max("weight").alias("weight"))
    total = own.groupBy("kind", "value").agg(F.round(F.avg("weight"), 6).alias("weight"), F.count("*").alias("readers"))
    return total.orderBy(F.desc("readers"), F.desc("weight"), "kind", "value").limit(limit)


def weights(named: DataFrame) -> DataFrame:
    """(name, weight): positive weights by lower-case name, the last row of a name by ``place``, brought to a sum of one."""
    last = named.groupBy(F.lower(F.trim("name")).alias("name")).agg(F.max_by("weight", "place").alias("weight")).filter("weight > 0")
    return last.withColumn("weight", F.col("weight") / F.sum("weight").over(Window.partitionBy()))


def wants_keyword(items: DataFrame, sources: DataFrame, keywords: list[str]) -> DataFrame:
    """The items (source_name, title, content): those of a firehose only with a keyword, of other or unknown sources all."""
    own = sources.select(F.col("name").alias("source_name"), F.col("firehose").alias("hose"))
    text = F.concat_ws(". ", F.coalesce("title", F.lit("")), F.substring(F.coalesce("content", F.lit("")), 1, 800))
    return items.join(own, "source_name", "left").filter(~F.coalesce("hose", F.lit(False)) | (F.size(keyword_hits(text, keywords)) > 0)).drop("hose")


def backoff(failures: Column, *, first: int = 30, most: int = 3600) -> Column:
    """Seconds to wait after so many failures in a row: twice as long each time, up to ``most``; none without a failure."""
    n = F.least(F.greatest(F.coalesce(failures, F.lit(0)), F.lit(0)), F.lit(30))
    return F.when(n > 0, F.least(F.lit(most).cast("long"), (F.pow(F.lit(2.0), n - 1) * first).cast("long"))).otherwise(F.lit(0).cast("long"))


def health(articles: DataFrame, sources: DataFrame, disks: DataFrame, hosts: DataFrame, *, now: Column, threshold: int = 5, slow_hours: float = 6, floor_mb: int = 1024) -> DataFrame:
    """(check, level, n, detail): one report of the whole, a row for each check and for each thing that is wrong.

    backlog (open articles; a warning if the oldest waits ``slow_hours``),
    failing and blip (sources at or under ``threshold`` failures in a row, with
    the last error), disk (newest sample; a warning at ``floor_mb`` or less, the
    loss a day of the last 24 hours), parked (hosts that asked for quiet, with
    the minutes left). Checks without a finding give a row with 0.
    """
    waits = F.timestamp_diff("SECOND", F.col("created_at"), now) / 3600.0
    open_ = ~F.coalesce("is_processed", F.lit(False)) & ~F.coalesce("is_archived", F.lit(False))
    backlog = articles.filter(open_).agg(F.count("*").alias("n"), F.round(F.coalesce(F.max(waits), F.lit(0.0)), 1).alias("oldest"))
    row = lambda check, level, n, detail: [F.lit(check).alias("check"), level.alias("level"), n.cast("long").alias("n"), detail.alias("detail")]
    parts = [backlog.select(*row("backlog", F.when(F.col("oldest") >= slow_hours, "warning").otherwise("info"), F.col("n"), F.format_string("oldest waits %.1f h", "oldest")))]
    bad = sources.filter(F.coalesce("enabled", F.lit(True)) & (F.coalesce("error_count", F.lit(0)) > 0)).withColumn("failing", F.col("error_count") >= threshold)
    parts.append(bad.select(F.when(F.col("failing"), "failing").otherwise("blip").alias("check"), F.when(F.col("failing"), "warning").otherwise("info").alias("level"), F.col("error_count").cast("long").alias("n"), F.concat_ws(": ", "name", F.substring("last_error", 1, 120)).alias("detail")))
    newest = disks.filter(F.col("at") <= now).agg(F.max_by("free_mb", "at").alias("free"), F.max("at").alias("at"))
    day = disks.filter((F.col("at") <= now) & (F.col("at") > now - F.expr("INTERVAL 24 HOURS"))).agg(F.min_by("free_mb", "at").alias("before"))
    both = newest.withColumn("before", day.scalar()).filter("free IS NOT NULL")
    parts.append(both.select(*row("disk", F.when(F.col("free") <= floor_mb, "warning").otherwise("info"), F.col("free"), F.concat(F.lit("MB free, "), (F.col("free") - F.coalesce("before", "free")).cast("string"), F.lit(" in a day")))))
    left = F.ceil(F.timestamp_diff("SECOND", now, F.col("until")) / 60.0)
    parts.append(hosts.filter(F.col("until") > now).select(*row("parked", F.lit("info"), F.greatest(F.lit(1).cast("long"), left), F.col("host"))))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    every = articles.sparkSession.createDataFrame([(c,) for c in ("backlog", "failing", "blip", "disk", "parked")], "check string")
    none = every.join(found.select("check").distinct(), "check", "left_anti").select("check", F.lit("info").alias("level"), F.lit(0).cast("long").alias("n"), F.lit("").alias("detail"))
    return found.unionByName(none)


def rule_interests(messages: DataFrame, vocabulary: DataFrame, *, refusals: str = r"不要|不想|别|排除|exclude|\bno |without", limit: int = 20) -> DataFrame:
    """(id, place, type, value): what messages (id, text) say they wish for or don't, by a vocabulary (word) of any size.

    A message is cut at commas, semicolons and line ends; a part with one of
    ``refusals`` excludes the words that it holds, others ask for them. Words
    count anywhere in a part, in any case, longer ones first; each once of a
    type, up to ``limit`` for a message.
    """
    parts = messages.select("id", F.posexplode(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[,，、;；\n]| 我 | 以及 ")).alias("n", "part"))
    parts = parts.withColumn("part_id", F.concat_ws("/", F.coalesce(F.col("id").cast("string"), F.lit("-")), "n"))
    hits = contained(parts, vocabulary, id_col="part_id", text_col="part", term_col="word").select(F.col("id").alias("part_id"), "term")
    own = parts.join(hits, "part_id").select("id", "n", F.when(F.col("part").rlike(refusals), "exclude").otherwise("topic").alias("type"), F.col("term").alias("value"))
    first = own.groupBy("id", "type", "value").agg(F.min("n").alias("n"))
    order = Window.partitionBy("id").orderBy("n", F.desc(F.length("value")), "value", "type")
    return first.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit).select("id", "place", "type", "value")
