"""Rules on articles: keyword gate, category, event gate, offers, intents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.present import ordinal
from ..functions.scoring import rounded
from ..functions.text import keyword_hits, plain_words, squeeze, whole_word_hits
from .search import query_terms

#: An own vocabulary in the shape of the configured one; callers pass theirs.
TAXONOMY: dict[str, list[str]] = {
    "Models": ["model", "weights", "benchmark", "reasoning", "tokens"],
    "Agents": ["agent", "workflow", "assistant", "tool use"],
    "Infrastructure": ["chip", "gpu", "datacenter", "inference", "cluster"],
    "Open Source": ["license", "licensed", "repository", "release", "fork"],
    "Research": ["paper", "study", "dataset", "theorem"],
}
#: Events that make a headline news, and headlines and sources that never do.
EVENT = r"(?i)\b(announc\w+|unveil\w+|introduc\w+|acquir\w+|merger|raises|raising|lawsuit|antitrust|outage|breach|hacked)\b|\bnow (available|live)\b"
NO_TITLE = r"(?i)^v?\d+\.\d+|^show hn|^hiring"
NO_SOURCE = r"(?i)reddit|arxiv|trending"


def keyword_gate(articles: DataFrame, keywords: list[str], *, least: int = 1) -> DataFrame:
    """Adds hits and keep; an offer passes without a keyword, and an empty vocabulary keeps all."""
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.substring(F.coalesce("content", F.lit("")), 1, 800))
    hits = keyword_hits(text, keywords)
    out = articles.withColumn("hits", hits)
    keep = F.lit(True) if not keywords else (F.size("hits") >= least) | F.coalesce("is_free_offer", F.lit(False))
    return out.withColumn("keep", keep)


#: Shapes of a lower-cased title, for callers that weigh them: billions of weights, but not of money; and what names a
#: repository, its stars or a release.
SIZE = r"(?<![\w$.])\d{1,4}(?:\.\d{1,2})?b\b"
REPOSITORY = r"^[\w.-]+/[\w.-]+(?:$|[\s:(])|\b[\d,]+ stars?\)|^v?\d[\w.]* is released in\b|^v?\d[\w.]* released in\b"


def categorize(
    articles: DataFrame,
    taxonomy: dict[str, list[str]] | None = None,
    hints: dict[str, tuple[str, float]] | None = None,
    *,
    shapes: dict[str, tuple[str, float]] | None = None,
    subcategories: dict[str, dict[str, list[str]]] | None = None,
) -> DataFrame:
    """Adds rule_category and confidence: title hits count double, long lists count less, sources lean.

    The best score wins, then the shorter name, then the first declared.
    ``shapes`` gives patterns of the title with the category and weight each
    adds, as {SIZE: ("Models", 0.6), REPOSITORY: ("Open Source", 1.0)}. With
    ``subcategories`` (category, then name, to words) rule_subcategory is added:
    the first name of most hits under the winner, if it has two or more.
    """
    taxonomy = TAXONOMY if taxonomy is None else taxonomy
    # Every run of spaces ends with one, so the first 1,200 characters of the squeezed text lie within the first part.
    begin = F.substring("content", 1, 20_000)
    short = F.substring(squeeze(begin), 1, 1200)
    start = F.when(F.length(short) < 1200, F.substring(squeeze(F.col("content")), 1, 1200)).otherwise(short)
    title_name, body_name = (n if n not in articles.columns else f"_{n}" for n in ("low_title", "low_body"))
    articles = articles.withColumn(title_name, F.lower(squeeze(F.col("title"))))
    articles = articles.withColumn(body_name, F.lower(F.concat_ws(" ", squeeze(F.col("title")), start)))
    title, body = F.col(title_name), F.col(body_name)
    # Words are found once for all keywords.
    word_names = [n if n not in articles.columns else f"_{n}" for n in ("title_words", "body_words")]
    articles = articles.withColumns(dict(zip(word_names, (plain_words(title), plain_words(body)))))
    of_title, of_body = map(F.col, word_names)
    scores = []
    for i, (name, words) in enumerate(taxonomy.items()):
        score = (2 * whole_word_hits(title, words, of_title) + whole_word_hits(body, words, of_body)) / F.sqrt(F.lit(float(len(words))))
        for pattern, (category, weight) in (hints or {}).items():
            if category == name:
                score = score + F.when(F.lower("source_name").contains(pattern), weight).otherwise(0.0)
        for pattern, (category, weight) in (shapes or {}).items():
            if category == name:
                score = score + F.when(title.rlike(pattern), weight).otherwise(0.0)
        scores.append(F.struct(score.alias("score"), F.lit(-len(name)).alias("short"), F.lit(-i).alias("first"), F.lit(name).alias("name")))
    all_ = F.array(*scores)
    out = articles.withColumn("_scores", all_).withColumn("_best", F.array_max("_scores"))
    total = F.aggregate("_scores", F.lit(0.0), lambda acc, s: acc + s["score"])
    some = F.col("_best.score") > 0
    if subcategories is not None:
        sub = F.lit(None).cast("string")
        for category, names in subcategories.items():
            hits = [F.struct((2 * whole_word_hits(title, words, of_title) + whole_word_hits(body, words, of_body)).alias("hits"), F.lit(-i).alias("first"), F.lit(name).alias("name")) for i, (name, words) in enumerate(names.items()) if words]
            if hits:
                best = F.array_max(F.array(*hits))
                sub = F.when(some & (F.col("_best.name") == category), F.when(best["hits"] >= 2, best["name"])).otherwise(sub)
        out = out.withColumn("rule_subcategory", sub)
    return out.withColumn("rule_category", F.when(some, F.col("_best.name"))).withColumn("confidence", F.when(some, rounded(F.least(F.col("_best.score") / total, F.lit(1.0)), 2)).otherwise(0.0)).drop("_scores", "_best", title_name, body_name, *word_names)


def breaking_gate(articles: DataFrame, *, as_of: Column, min_quality: float = 80, min_score: float = 45, heat_bar: float = 250, max_age_hours: float = 24) -> DataFrame:
    """Adds verdict and passes. Needs source_name, title, source_quality, final_score, heat, published_at.

    Heat excuses a weak source or score, not a blocked source, a headline
    without an event, or age; short of the bars but fresh, an article waits.
    """
    age = F.timestamp_diff("SECOND", F.col("published_at"), as_of) / 3600.0
    event = F.coalesce(F.col("title").rlike(EVENT) & ~F.col("title").rlike(NO_TITLE), F.lit(False))
    rescued = F.coalesce(F.col("heat"), F.lit(0.0)) >= heat_bar
    weak = (F.coalesce(F.col("source_quality"), F.lit(0.0)) < min_quality) & ~rescued
    low = (F.coalesce(F.col("final_score"), F.lit(0.0)) < min_score) & ~rescued
    fresh = age.isNotNull() & (age <= max_age_hours)
    verdict = (
        F.when(F.coalesce(F.col("source_name").rlike(NO_SOURCE), F.lit(False)), "blocked source")
        .when(~event, "no event")
        .when((weak | low) & fresh, "wait for heat")
        .when(weak, "weak source")
        .when(low, "low score")
        .when(age > max_age_hours, "too old")
        .otherwise("pass")
    )
    return articles.withColumn("verdict", verdict).withColumn("passes", F.col("verdict") == "pass")


#: Ordered intents with the words that mark them; the first that occurs decides.
INTENTS = {"settings": ("setting", "timezone", "mute", "interest", "notify"), "sources": ("source", "status"), "help": ("help", "what can you do")}
#: Days that a question is about, with the words that say so, in order.
SPANS = {1: ("today",), 2: ("yesterday",), 7: ("this week",), 3: ("latest", "recent")}
#: Words that ask for more of one item, and the marks of a question, which keep "follow" from being a setting.
DETAILS, ASKS, FOLLOW = ("summary", "in detail", "analysis"), ("?", "？", "what", "which", "how", "why", "today", "yesterday", "this week", "latest", "recent"), ("follow",)


def rule_intent(
    messages: DataFrame,
    text: str = "text",
    *,
    intents: dict[str, tuple[str, ...]] = INTENTS,
    spans: dict[int, tuple[str, ...]] = SPANS,
    details: tuple[str, ...] = DETAILS,
    asks: tuple[str, ...] = ASKS,
    follow: tuple[str, ...] = FOLLOW,
    otherwise: int = 14,
) -> DataFrame:
    """Adds intent, days, place and query: ordered rules on a message.

    A word for details with an ordinal wants that item summarized. Then the
    intents, in order; a word to follow something is a setting unless the
    message asks. What is left is a search for its terms over the days that it
    names, or the latest, if it has no terms. ``place`` is the item that an
    ordinal names, for a summary or a search.
    """
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    has = lambda words: F.greatest(F.lit(False), F.lit(False), *[F.contains(low, F.lit(w)) for w in words])
    numbered = F.concat(F.regexp_extract(F.col(text), r"第\s*([0-9一二三四五六七八九十]+)", 1), F.regexp_extract(low, r"\b(?:no\.?|number|item)\s*([0-9]{1,2})\b", 1))
    place = ordinal(F.nullif(numbered, F.lit("")))
    named = F.when(has(details) & place.isNotNull(), "summarize")
    for n, (name, words) in enumerate(intents.items()):
        named = named.when(has(words) | (has(follow) & ~has(asks)) if n == 0 else has(words), name)
    terms = query_terms(F.col(text))
    intent = named.when(F.size(terms) == 0, "latest").otherwise("search")
    out = messages.withColumn("intent", intent)
    asked = F.col("intent").isin("search", "latest")
    days = F.when(~asked, otherwise)
    for n, words in spans.items():
        days = days.when(has(words), n)
    joined = F.array_join(terms, " ")
    return out.withColumns({"days": days.otherwise(otherwise), "place": F.when(asked | (F.col("intent") == "summarize"), place), "query": F.when(asked, F.when(joined == "", F.trim(F.coalesce(F.col(text), F.lit("")))).otherwise(joined)).otherwise("")})


def tags(articles: DataFrame, terms: list[str], *, limit: int = 6) -> DataFrame:
    """Adds tags: the first ``limit`` different terms in text order; without any, the source."""
    import re

    alternatives = "|".join(re.escape(t) for t in sorted(terms, key=len, reverse=True))
    found = F.slice(F.array_distinct(F.regexp_extract_all(F.concat_ws(". ", "title", "content"), F.lit(rf"(?<![A-Za-z0-9_])({alternatives})(?![A-Za-z0-9_])"), F.lit(1))), 1, limit)
    return articles.withColumn("_t", found).withColumn("tags", F.when(F.size("_t") > 0, F.col("_t")).otherwise(F.array("source_name"))).drop("_t")


#: Tools and phrases of offers; callers pass theirs.
OFFER_TOOLS = ["hosting", "editor", "database", "search"]
OFFER_STRONG = ["free tier", "free credits", "no charge"]
OFFER_WEAK = ["free", "trial", "discount"]
FALSE_FRIENDS = ["free-form", "free software", "sugar free"]


def detect_offer(articles: DataFrame, *, tools: list[str] = OFFER_TOOLS, strong: list[str] = OFFER_STRONG, weak: list[str] = OFFER_WEAK, friends: list[str] = FALSE_FRIENDS, body_limit: int = 2500, gap: int = 140) -> DataFrame:
    """Adds offer: struct<tool, signals, in_title, confidence>, null where there is none.

    False friends are blanked first. Weak signals count in the title only. The
    tool nearest to a signal is the subject, one in the title before any other;
    outside the title it must stand within ``gap`` characters of a signal.
    """
    import re

    alternatives = lambda words: "|".join(rf"(?<![a-z0-9]){re.escape(w)}(?![a-z0-9])" for w in sorted(words, key=len, reverse=True))
    blank = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), alternatives(friends), " ")
    title, body = blank(F.col("title")), blank(F.substring(F.coalesce("content", F.lit("")), 1, body_limit))
    in_title = F.regexp_extract_all(title, F.lit(f"({alternatives(strong + weak)})"), F.lit(1))
    in_body = F.regexp_extract_all(body, F.lit(f"({alternatives(strong)})"), F.lit(1))
    signals = F.slice(F.array_distinct(F.concat(in_title, in_body)), 1, 4)
    title_tool = F.regexp_extract(title, f"({alternatives(tools)})", 1)
    body_tool = F.regexp_extract(body, rf"(?s)(?:{alternatives(strong)}).{{0,{gap}}}?({alternatives(tools)})", 1)
    tool = F.when(title_tool != "", title_tool).otherwise(body_tool)
    confidence = F.least(F.lit(1.0), 0.45 + 0.12 * F.size(signals) + F.when(F.size(in_title) > 0, 0.1).otherwise(0.0))
    found = F.struct(tool.alias("tool"), signals.alias("signals"), (title_tool != "").alias("in_title"), rounded(confidence, 2).alias("confidence"))
    return articles.withColumn("offer", F.when((F.size(signals) > 0) & (tool != ""), found))
