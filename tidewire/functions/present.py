"""Column functions for what readers see: summaries, tags, labels, small parsers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .terms import fix_wrong_sense, resolve_entities
from .text import redact, shorten, squeeze


def demote_markdown(text: Column) -> Column:
    """Headings, links, emphasis and bullets become plain text."""
    out = F.regexp_replace(text, r"(?m)^#{1,6} +", "")
    out = F.regexp_replace(out, r"\[([^\]\[]*)\]\([^)]*\)", "$1")
    out = F.regexp_replace(out, r"\*\*([^*]+)\*\*", "$1")
    return F.regexp_replace(out, r"(?m)^[*+-] +", "")


def strip_boilerplate(text: Column) -> Column:
    """Lines that feeds add: topic links, post counts, submission notes."""
    out = F.regexp_replace(text, r"(?i)read full topic", "")
    out = F.regexp_replace(out, r"(?i)[0-9]+ posts? - [0-9]+ participants?", "")
    out = F.regexp_replace(out, r"(?i)submitted by +/?u/[A-Za-z0-9_-]+", "")
    return F.trim(F.regexp_replace(out, r"(?i)\[(link|comments)\]", ""))


def collapse_repeats(text: Column) -> Column:
    """A text that only repeats its beginning becomes that beginning."""
    return F.regexp_replace(text, r"^(.+?)( \1)+$", "$1")


def sentences(text: Column, least: int = 30) -> Column:
    return F.filter(F.transform(F.split(squeeze(text), r"(?<=[.!?。！？])\s+"), lambda s: F.trim(s)), lambda s: F.length(s) >= least)


def fallback_summary(title: Column, content: Column) -> Column:
    """struct<summary, points>: the first sentence that isn't the title, or the title; the next two are points."""
    own = F.filter(sentences(content), lambda s: F.substring(s, 1, 70) != F.substring(title, 1, 70))

    def summed(own: Column) -> Column:
        first = F.get(own, F.lit(0))
        return F.struct(F.when(first.isNull(), title).otherwise(shorten(first, 160)).alias("summary"), F.slice(own, 2, 2).alias("points"))

    return F.transform(F.array(own), summed)[0]


def merge_tags(*groups: Column, limit: int = 8) -> Column:
    """Tags in order, each once in any case."""
    empty = F.array().cast("array<string>")
    tags = F.filter(F.concat(*[F.coalesce(g, empty) for g in groups]), lambda t: F.trim(F.coalesce(t, F.lit(""))) != "")
    known = lambda acc, t: F.exists(acc, lambda x: F.lower(x) == F.lower(t))
    return F.slice(F.aggregate(tags, empty, lambda acc, t: F.when(known(acc, t), acc).otherwise(F.concat(acc, F.array(t)))), 1, limit)


def ordinal(text: Column) -> Column:
    """The whole number from 1 to 99 that a text says in digits or Chinese numerals; null for others."""
    digits = F.regexp_extract(text, r"([0-9]{1,2})", 1).try_cast("int")
    tens = F.regexp_extract(text, "([一二三四五六七八九]?)十([一二三四五六七八九]?)", 0)
    value = lambda c: F.instr(F.lit("一二三四五六七八九"), c)
    left, right = F.regexp_extract(text, "([一二三四五六七八九]?)十([一二三四五六七八九]?)", 1), F.regexp_extract(text, "([一二三四五六七八九]?)十([一二三四五六七八九]?)", 2)
    part = lambda c, none: F.when(c == "", none).otherwise(value(c))
    single = F.regexp_extract(text, "([一二三四五六七八九])", 1)
    spoken = F.when(tens != "", part(left, 1) * 10 + part(right, 0)).when(single != "", value(single))
    out = F.coalesce(digits, spoken)
    return F.when((out >= 1) & (out <= 99), out)


def clamp_score(value: Column) -> Column:
    """A score from 0 to 100."""
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(100.0))


def needs_translation(text: Column) -> Column:
    """More than eight Latin letters and hardly any Chinese."""
    n = F.length(text)
    cjk = n - F.length(F.regexp_replace(text, "[一-鿿]", ""))
    latin = n - F.length(F.regexp_replace(text, "[A-Za-z]", ""))
    return (latin > 8) & (cjk < F.greatest(F.lit(3.0), n * 0.1))


def localize_title(title: Column) -> Column:
    """Release notices and repository entries by template; other titles stay."""
    version = F.regexp_extract(title, r"^(v?[0-9][0-9.]*) released in ([^ ]+)$", 1)
    repo = F.regexp_extract(title, r"^(v?[0-9][0-9.]*) released in ([^ ]+)$", 2)
    stars = F.regexp_extract(title, r"^([^ ]+/[^ ]+) \(([0-9,]+) stars\)$", 2)
    name = F.regexp_extract(title, r"^([^ ]+/[^ ]+) \(([0-9,]+) stars\)$", 1)
    return F.when(version != "", F.concat(repo, F.lit(": "), version)).when(stars != "", F.concat(name, F.lit(" ★"), stars)).otherwise(title)


def why_it_matters(outlets: Column, heat: Column, first_hand: Column) -> Column:
    """Clauses on who else reports, how much it is discussed, and a first-hand event; empty without any."""
    others = F.when(F.size(outlets) > 0, F.concat(F.lit("also in "), F.array_join(F.slice(outlets, 1, 3), ", ")))
    hot = F.when(heat >= 125, F.concat(F.lit("discussed, heat "), heat.cast("int").cast("string")))
    own = F.when(first_hand, F.lit("first-hand"))
    return F.substring(F.concat_ws("; ", others, hot, own), 1, 280)


def next_slot(minute: Column, slots: list[int]) -> Column:
    """The first later slot of the day, cyclic."""
    later = F.filter(F.array(*map(F.lit, sorted(slots))), lambda s: s > minute)
    return F.coalesce(F.get(later, F.lit(0)), F.lit(min(slots)))


def clip_lines(text: Column, limit: int, mark: str = "…") -> Column:
    """At most ``limit`` characters, cut at the last line end that fits, with a mark."""
    head = F.substring(text, F.lit(1), F.lit(limit - len(mark)))
    whole = F.regexp_extract(head, r"(?s)^(.*)\n", 1)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.when(whole != "", whole).otherwise(head), F.lit(mark)))


def has_cjk(text: Column) -> Column:
    return F.coalesce(text.rlike("[一-鿿]"), F.lit(False))


def display(articles: DataFrame, *, senses: list[tuple[str, str, str]] = ()) -> DataFrame:
    """Adds display_title, display_summary, translated_summary, display_line, display_points, points_in_english and wants_translation.

    Needs title, title_zh, summary, summary_zh, content, points, points_zh. The
    translation comes first, its wrong senses put right by what the source has
    (``fix_wrong_sense``); secrets are masked, feed boilerplate and entities go.
    A translated summary takes the place of the title only if it holds Chinese
    characters. Points are the translated ones, else those that are Chinese,
    else all; they are in English if there are some and none is Chinese.
    """
    right = lambda source, translated: fix_wrong_sense(source, translated, list(senses)) if senses else translated
    none = F.array().cast("array<string>")
    filled = lambda a: F.filter(F.coalesce(a, none), lambda p: F.trim(F.coalesce(p, F.lit(""))) != "")
    title_zh, summary_zh = F.nullif("title_zh", F.lit("")), F.nullif("summary_zh", F.lit(""))
    source = F.concat_ws(" ", "title", "content")
    title = redact(F.when(title_zh.isNull(), F.col("title")).otherwise(right(F.col("title"), title_zh)))
    summary = F.when(summary_zh.isNull(), F.col("summary")).otherwise(right(source, summary_zh))
    summary = F.nullif(redact(resolve_entities(strip_boilerplate(F.coalesce(summary, F.lit(""))))), F.lit(""))
    out = articles.withColumns({"display_title": title, "display_summary": summary})
    out = out.withColumn("translated_summary", F.when(has_cjk(summary_zh), F.col("display_summary")))
    english = F.array_join(filled(F.col("points")), " ")
    stored = F.transform(filled(F.col("points_zh")), lambda p: right(english, p))
    chinese = F.filter(F.coalesce("points", none), has_cjk)
    points = F.when(F.size(filled(F.col("points_zh"))) > 0, stored).when(F.size(chinese) > 0, chinese).otherwise(filled(F.col("points")))
    some_zh = F.size(F.coalesce("points_zh", none)) > 0
    wants = lambda c: F.coalesce(needs_translation(c), F.lit(False))
    open_ = ~some_zh & F.exists(F.coalesce("points", none), lambda p: wants(p) & ~has_cjk(p))
    return out.withColumns(
        {
            "display_line": F.coalesce("translated_summary", "display_title"),
            "display_points": points,
            "points_in_english": (F.size(F.coalesce("points", none)) > 0) & ~some_zh & (F.size(chinese) == 0),
            "wants_translation": wants(F.col("title")) | wants(F.col("summary")) | open_,
        }
    )


def local_time(ts: Column, zone: str) -> Column:
    """Month, day and time by the clock of a zone; empty without a time."""
    return F.coalesce(F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), ts), "MM-dd HH:mm"), F.lit(""))


def as_json(articles: DataFrame, columns: list[str]) -> Column:
    """The columns of an article as one JSON object, nulls included; times to the minute."""
    kinds = dict(articles.dtypes)
    shown = [F.date_format(c, "yyyy-MM-dd'T'HH:mm").alias(c) if kinds[c].startswith("timestamp") else F.col(c) for c in columns]
    return F.to_json(F.struct(*shown), {"ignoreNullFields": "false"})
