"""Readers of feeds, listings, price lists and logs. Fetching is up to the caller; these parse what was fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    """RSS items as articles; items without link or title are left out, broken ones skipped."""
    raw = spark.read.format("xml").option("rowTag", "item").option("mode", "DROPMALFORMED").schema("title string, link string, guid string, pubDate string, author string, description string").load(path)
    return raw.select(F.trim("title").alias("title"), F.trim("link").alias("url"), F.trim("guid").alias("guid"), "author", F.coalesce("description", F.lit("")).alias("content"), parse_date(F.col("pubDate")).alias("published_at")).filter("title <> '' AND url <> ''")


def read_atom(spark: SparkSession, path: str) -> DataFrame:
    schema = "title string, id string, published string, updated string, summary string, content string, link array<struct<_href:string,_rel:string>>"
    raw = spark.read.format("xml").option("rowTag", "entry").option("mode", "DROPMALFORMED").schema(schema).load(path)
    link = F.coalesce(F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")[0]["_href"], F.get("link", F.lit(0))["_href"])
    return raw.select(F.trim("title").alias("title"), link.alias("url"), F.col("id").alias("guid"), F.coalesce("content", "summary", F.lit("")).alias("content"), parse_date(F.coalesce("published", "updated")).alias("published_at")).filter("title <> '' AND url <> ''")


def parse_date(text: Column) -> Column:
    """Epoch seconds, ISO or RFC 2822, as UTC without zone; null for anything else."""
    epoch = F.when(text.rlike(r"^\d{9,11}$"), F.timestamp_seconds(text.cast("long")))
    mail = F.regexp_replace(F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", ""), r"(GMT|UTC|Z)$", "+0000")
    iso = F.regexp_replace(F.trim(text), r"(\.\d+)?(Z|\+00:?00)$", "")
    out = F.coalesce(epoch, F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(iso, F.lit("yyyy-MM-dd'T'HH:mm:ss")), F.try_to_timestamp(F.trim(text), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")), F.try_to_timestamp(iso, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")))
    return F.to_timestamp_ntz(F.date_format(out, "yyyy-MM-dd HH:mm:ss"))


def clamp_future(ts: Column, as_of: Column, minutes: int = 30) -> Column:
    """A missing time or one beyond the allowance becomes now."""
    return F.when(ts.isNull() | (ts > as_of + F.expr(f"INTERVAL {minutes} MINUTES")), as_of).otherwise(ts)


def _best_of(rows: DataFrame, key: str, by: str) -> DataFrame:
    """Of rows that repeat a key the one with the most ``by``; of equal ones that of the greatest hash."""
    rest = [c for c in rows.columns if c != key]
    picked = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(F.col(by), F.xxhash64(*[F.col(c).cast("string") for c in rest]))).alias("best"))
    return picked.select(key, "best.*").select(*rows.columns)


def hacker_news(hits: DataFrame, *, as_of: Column, min_points: int = 20, hours: int = 48) -> DataFrame:
    """Search hits above a floor of points, each object once, with its most points; heat is the points."""
    created = F.timestamp_seconds("created_at_i")
    own = _best_of(hits.filter((F.col("points") >= min_points) & (created > as_of - F.expr(f"INTERVAL {hours} HOURS"))), "objectID", "points")
    url = F.coalesce(F.nullif("url", F.lit("")), F.concat(F.lit("https://news.ycombinator.com/item?id="), F.col("objectID")))
    return own.select("objectID", "title", url.alias("url"), F.col("points").cast("double").alias("heat"), F.col("num_comments").alias("comments"))


def reddit(posts: DataFrame, *, subreddit: str, min_ups: int = 20, min_comments: int = 5, ignored: tuple[str, ...] = ()) -> DataFrame:
    """Posts worth reading; a self post is known by its own page, any other by its target."""
    keep = ~F.coalesce("stickied", F.lit(False)) & (F.lower("subreddit") == subreddit.lower()) & (F.col("ups") >= min_ups) & (F.col("num_comments") >= min_comments)
    if ignored:
        keep &= ~F.coalesce("author", F.lit("")).isin(*ignored)
    page = F.concat(F.lit("https://www.reddit.com"), F.col("permalink"))
    return posts.filter(keep).select("id", "title", F.when(F.col("is_self"), page).otherwise(F.coalesce("url", page)).alias("url"), F.col("ups").cast("double").alias("heat"), F.col("num_comments").alias("comments"))


def repositories(found: DataFrame, *, min_stars: int = 10, limit: int = 30) -> DataFrame:
    """Search results of several queries: each repository once, with its most stars, the floor of stars checked again."""
    return _best_of(found.filter(F.col("stargazers_count") >= min_stars), "full_name", "stargazers_count").orderBy(F.desc("stargazers_count"), "full_name").limit(limit)


def releases(found: DataFrame, *, as_of: Column, fresh_hours: int = 72, limit: int = 30) -> DataFrame:
    """The latest release of each repository, if it is fresh, newest first."""
    ts = parse_date(F.col("published_at"))
    latest = found.withColumn("published", ts).groupBy("full_name").agg(F.max_by(F.struct("tag_name", "html_url", "body", "published"), F.struct("published", "tag_name")).alias("r"))
    own = latest.select("full_name", "r.*").filter(F.col("published") >= as_of - F.expr(f"INTERVAL {fresh_hours} HOURS"))
    title = F.concat("tag_name", F.lit(" released in "), "full_name")
    return own.orderBy(F.desc("published"), "full_name").limit(limit).select("full_name", title.alias("title"), F.col("html_url").alias("url"), F.coalesce("body", F.lit("")).alias("content"), F.col("published").alias("published_at"))


def organisation(repos: DataFrame, org: str, *, limit: int = 30) -> DataFrame:
    """An organisation's repositories, the last updated first."""
    own = repos.filter(F.lower("full_name").startswith(org.lower() + "/"))
    return own.orderBy(F.desc("updated_at"), "full_name").limit(limit).select("full_name", F.col("html_url").alias("url"), "updated_at")


def read_arxiv(spark: SparkSession, path: str, keywords: list[str]) -> DataFrame:
    """Papers of an Atom answer whose title or abstract holds a keyword; authors in one line of 250 characters at most."""
    from ..functions.text import keyword_hits, squeeze

    schema = "title string, id string, published string, summary string, author array<struct<name:string>>"
    raw = spark.read.format("xml").option("rowTag", "entry").option("mode", "DROPMALFORMED").schema(schema).load(path)
    flat = lambda c: squeeze(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    rows = raw.select(flat(F.col("title")).alias("title"), F.trim("id").alias("url"), flat(F.col("summary")).alias("content"), F.substring(F.array_join("author.name", ", "), 1, 250).alias("authors"), parse_date(F.col("published")).alias("published_at"))
    return rows.filter((F.size(keyword_hits(F.concat_ws(" ", "title", "content"), keywords)) > 0) & (F.col("title") != ""))


def read_videos(spark: SparkSession, path: str, keywords: list[str], *, per_channel: int = 10) -> DataFrame:
    """The newest entries of each channel's feed, ten at most, that hold a keyword; titles are marked. Broken feeds give none."""
    from ..functions.text import keyword_hits

    schema = "title string, published string, link struct<_href:string>, author struct<name:string>"
    raw = spark.read.format("xml").option("rowTag", "entry").option("mode", "DROPMALFORMED").schema(schema).load(path)
    rows = raw.select(F.trim("title").alias("title"), F.col("link._href").alias("url"), F.col("author.name").alias("channel"), parse_date(F.col("published")).alias("published_at")).filter("title <> '' AND url <> ''")
    newest = Window.partitionBy("channel").orderBy(F.desc("published_at"), "url")
    kept = rows.withColumn("at", F.row_number().over(newest)).filter((F.col("at") <= per_channel) & (F.size(keyword_hits(F.col("title"), keywords)) > 0)).drop("at")
    return kept.withColumn("title", F.concat(F.lit("[video] "), "title"))


def all_free(models: DataFrame, pricing: str) -> DataFrame:
    """Rows whose every price is zero, those without prices left out."""
    values = F.map_values(pricing)
    return models.filter((F.size(values) > 0) & F.forall(values, lambda v: v.try_cast("double") == 0))


HEADER = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}),\d{3} (\w+) +\[([^\]]+)\] ([^ ]+) - (.*)$"


def log_records(lines: DataFrame, *, file: str = "file", number: str = "line_no", line: str = "line") -> DataFrame:
    """A header begins a record, the lines after it belong to it; lines before the first header are dropped."""
    order = Window.partitionBy(file).orderBy(number).rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("head", F.col(line).rlike(HEADER)).withColumn("record", F.sum(F.col("head").cast("int")).over(order)).filter("record > 0")
    part = lambda i: F.max(F.when(F.col("head"), F.regexp_extract(line, HEADER, i)))
    last = F.max(F.when(F.col(line).rlike(r"^[A-Za-z_.]+(Error|Exception)\b"), F.struct(F.col(number), F.regexp_extract(line, r"^([A-Za-z_.]+(?:Error|Exception))", 1).alias("name"))))
    return marked.groupBy(file, "record").agg(F.to_timestamp_ntz(part(1), F.lit("yyyy-MM-dd HH:mm:ss")).alias("ts"), part(2).alias("level"), part(3).alias("logger"), part(5).alias("message"), last["name"].alias("error"))


def log_incidents(records: DataFrame, *, levels: tuple[str, ...] = ("WARNING", "ERROR", "CRITICAL")) -> DataFrame:
    """Records of the levels by signature: numbers and quoted parts of a message don't tell incidents apart."""
    shape = F.regexp_replace(F.regexp_replace("message", r"'[^']*'|\"[^\"]*\"", "'…'"), r"\d+", "#")
    key = F.concat_ws(" ", "level", "logger", shape, F.concat(F.lit("← "), F.col("error")))
    return records.filter(F.col("level").isin(*levels)).groupBy(key.alias("signature")).agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.slice(F.array_sort(F.collect_set("message")), 1, 3).alias("samples")).orderBy(F.desc("last"), "signature")
