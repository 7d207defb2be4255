"""Title similarity, its join with a time band, and grouping in order of arrival."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..sources.shared import drop_written, written
from ..functions.text import coverage, jaccard, title_key, title_tokens, versions_conflict

# Words that don't tell one story from another.
STOP_TERMS = (
    "a an the and or but if while with without for from to in on at by as of is are was "
    "were be been being this that these those it its their his her your our they them he she we you one two three "
    "more most much very just now says said say saying into onto about over under after before also too than "
    "then so such no not nor all any each other same what how why when where who whose vs via per"
).split()
GENERIC_TERMS = (
    "ai art app apps api code data dev engine open source model models llm news app "
    "released release releases launch launches update updates version tool tools company companies work working"
).split()


def content_terms(tokens: Column) -> Column:
    drop = F.array(*[F.lit(w) for w in dict.fromkeys(STOP_TERMS + GENERIC_TERMS)])
    return F.filter(tokens, lambda t: (F.length(t) >= 3) & ~F.array_contains(drop, t))


@F.pandas_udf(DoubleType())
def sequence_score(a: pd.Series, b: pd.Series, floor: pd.Series) -> pd.Series:
    """The better of the matched shares of words and of characters of two keys, or ``floor`` where neither gets above it."""

    def score(x: str, y: str, best: float) -> float:
        for one, other in ((x.split(), y.split()), (x, y)):
            matcher = SequenceMatcher(None, one, other)
            # Two quick bounds from above come before the match itself.
            if matcher.real_quick_ratio() > best and matcher.quick_ratio() > best:
                best = max(best, matcher.ratio())
        return best

    return pd.Series([score(x, y, f) for x, y, f in zip(a, b, floor)])


def score_pairs(pairs: DataFrame, *, best_of: str | None = None) -> DataFrame:
    """Adds score and same to pairs with title_a and title_b; the keys and tokens are worked out natively.

    The share of common words, which is cheap, comes first; the matching of
    sequences is asked only whether it gets above that. With ``best_of`` pairs
    that can't have the highest score for that column are left out before it.
    """
    out = pairs.withColumns({"key_a": title_key(F.col("title_a")), "key_b": title_key(F.col("title_b")), "tok_a": title_tokens(F.col("title_a")), "tok_b": title_tokens(F.col("title_b"))})
    cheap = 0.6 * coverage(F.col("tok_a"), F.col("tok_b")) + 0.4 * jaccard(F.col("tok_a"), F.col("tok_b"))
    out = out.withColumns({"cheap": cheap, "share": F.when(versions_conflict(F.col("title_a"), F.col("title_b")), 0.5).otherwise(1.0), "equal": F.col("key_a") == F.col("key_b")})
    if best_of:
        # A ratio of sequences is at most that of the lengths alone.
        ratio = lambda m, n: 2.0 * F.least(m, n) / (m + n)
        words = lambda k: F.size(F.split(k, " "))
        most = F.greatest(F.col("cheap"), ratio(F.length("key_a"), F.length("key_b")), ratio(words("key_a"), words("key_b"))) * F.col("share")
        sure = F.max(F.when(F.col("equal"), 1.0).otherwise(F.col("cheap") * F.col("share"))).over(Window.partitionBy(best_of))
        out = out.withColumns({"most": F.when(F.col("equal"), 1.0).otherwise(most), "sure": sure}).filter("most >= sure - 0.001").drop("most", "sure")
    unequal = F.when(F.col("equal"), F.lit(None)).otherwise(F.col("key_a"))
    best = sequence_score(F.coalesce(unequal, F.lit("")), F.when(F.col("equal"), "").otherwise(F.col("key_b")), "cheap") * F.col("share")
    score = F.when((F.col("key_a") == "") | (F.col("key_b") == ""), 0.0).when(F.col("equal"), 1.0).otherwise(F.floor(best * 10000 + 0.5) / 10000.0)
    out = out.withColumn("score", score)
    shared = F.size(F.array_intersect("tok_a", "tok_b"))
    terms = F.size(F.array_intersect(content_terms(F.col("tok_a")), content_terms(F.col("tok_b"))))
    same = ((F.col("score") >= 0.79) & ((shared >= 3) | (F.col("score") >= 0.95))) | (F.col("score").between(0.60, 0.78999999) & (terms >= 3))
    return out.withColumn("same", same).drop("key_a", "key_b", "tok_a", "tok_b", "cheap", "share", "equal")


def title_candidates(new: DataFrame, index: DataFrame, *, hours: int = 72, least: float = 0.5, arrived: str | None = None, earlier: bool = False) -> DataFrame:
    """(id_a, id_b, shared): pairs whose titles share ``least`` of the words of the shorter, b at most ``hours`` older than a.

    With ``arrived``, a column of both tables, b may be newer than a by any
    span, as long as it was published before a arrived: an old article that
    comes late meets all that is there. Without it b is at most ``hours`` newer.
    With ``earlier`` only lower ids count as b.

    With a coverage of half, ceil(|t| / 2) words of the shorter title are
    shared, so one of its |t| - ceil(|t| / 2) + 1 rarest is among them. Only
    those of the shorter title go into the join, with all words of the longer,
    so common words hardly ever meet. Times are dealt into slots of ``hours``.
    The words of each table are worked out once, and written; those of a table
    that is matched with itself serve both sides.
    """
    seconds = hours * 3600
    slot = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / seconds)
    band = F.expr(f"INTERVAL {hours} HOURS")

    def tokens(df: DataFrame) -> DataFrame:
        last = F.greatest("published_at", arrived) if arrived else F.col("published_at") + band
        return written(df.select("id", F.col("published_at").alias("ts"), last.alias("last"), title_tokens(F.col("title")).alias("tok"))).filter(F.size("tok") > 0)

    a = tokens(new)
    b = a if index is new else tokens(index)
    both = a.select(F.explode("tok").alias("w")).unionAll(b.select(F.explode("tok").alias("w"))).groupBy("w").agg(F.count("*").alias("df"))

    def ranked(df: DataFrame) -> DataFrame:
        """A row for each word, at its place from the rarest on."""
        each = df.select("id", "ts", "last", F.size("tok").alias("n"), F.explode("tok").alias("w")).join(both, "w")
        return written(each.withColumn("at", F.row_number().over(Window.partitionBy("id").orderBy("df", "w"))).drop("df"))

    def dealt(df: DataFrame, x: str) -> DataFrame:
        slots = F.explode(F.sequence(slot("ts") - 1, slot("last"))) if x == "a" else slot("ts")
        return df.withColumn("slot", slots).select("w", "slot", *[F.col(c).alias(f"{c}_{x}") for c in ("id", "ts", "last", "n", "at")])

    def head(df: DataFrame, x: str) -> DataFrame:
        return df.filter(F.col(f"at_{x}") <= F.col(f"n_{x}") - F.ceil(F.col(f"n_{x}") * least) + 1)

    words_a = ranked(a)
    ra, rb = dealt(words_a, "a"), dealt(words_a if b is a else ranked(b), "b")
    other = F.col("id_b") < F.col("id_a") if earlier else F.col("id_a") != F.col("id_b")
    near = (F.col("ts_b") >= F.col("ts_a") - band) & (F.col("ts_b") <= F.col("last_a")) & other
    need = F.ceil(F.least("n_a", "n_b") * least)
    in_prefix = (F.col("at_a") <= F.col("n_a") - need + 1) & (F.col("at_b") <= F.col("n_b") - need + 1)
    one = head(ra, "a").join(rb, ["w", "slot"]).filter(near & in_prefix & (F.col("n_a") <= F.col("n_b")))
    two = ra.join(head(rb, "b"), ["w", "slot"]).filter(near & in_prefix & (F.col("n_b") < F.col("n_a")))
    met = one.select("id_a", "id_b").unionAll(two.select("id_a", "id_b")).distinct()
    words = lambda df, x: df.select(F.col("id").alias(f"id_{x}"), F.col("tok").alias(f"tok_{x}"))
    full = met.join(words(a, "a"), "id_a").join(words(b, "b"), "id_b")
    return full.withColumn("shared", F.size(F.array_intersect("tok_a", "tok_b"))).filter(coverage(F.col("tok_a"), F.col("tok_b")) >= least).select("id_a", "id_b", "shared")


def distinct_titles(articles: DataFrame, *, hours: int = 72) -> DataFrame:
    """(id, title, published_at, lead): each article with the first of its title, by id, in its slot of ``hours``.

    Titles count as equal if their keys are, whatever the order of their words.
    ``lead`` may be older or newer than the article, by less than a slot, and is
    the article itself where there is none. The articles that lead stand for the
    rest in a search, so that copies don't multiply: a group of n copies is n
    rows here, and one or a few in the search.
    """
    keyed = articles.select("id", "title", "published_at", title_key(F.col("title")).alias("key"))
    # Titles without words equal nothing. A slot's first stands for the slot, so that no window is longer than one.
    slot = F.floor(F.unix_seconds(F.col("published_at").cast("timestamp")) / (hours * 3600))
    keyed = keyed.withColumn("slot", slot)
    first = keyed.filter("key <> ''").groupBy("key", "slot").agg(F.min("id").alias("lead"))
    return keyed.join(first, ["key", "slot"], "left").select("id", "title", "published_at", F.coalesce("lead", "id").alias("lead"))


def title_links(articles: DataFrame, *, linked: DataFrame, hours: int = 72) -> DataFrame:
    """(id, matched_id, score): each article's earlier ones, at most ``hours`` older, that tell the same story by their titles.

    Ids must be in the order of ``published_at``; ``linked`` has the ids that
    are linked by something else. Copies of a title wait for its first in their
    slot. Where that surely leads, as nothing earlier is like it, they follow it
    or something better: they need that link alone, and no link to them would
    ever count. Where it may follow another, one of the copies may lead once the
    other is too old, so these are searched with and searched for as all others.
    """
    named = written(distinct_titles(articles, hours=hours))
    leads, copies = named.filter("id = lead"), named.filter("id <> lead")
    first = written(leads.join(copies.select(F.col("lead").alias("id")).distinct(), "id", "left_semi"))
    # What a copy is like is like its first, and less than a slot away from it.
    like = title_candidates(first, leads, hours=2 * hours, earlier=True).select(F.col("id_a").alias("lead"))
    unsure = written(like.unionByName(linked.select(F.col("id").alias("lead"))).distinct())
    rows = written(leads.unionByName(copies.join(unsure, "lead", "left_semi").select(leads.columns)))
    pairs = title_candidates(rows, rows, hours=hours, earlier=True)
    both = pairs.join(rows.select(F.col("id").alias("id_a"), F.col("title").alias("title_a")), "id_a").join(rows.select(F.col("id").alias("id_b"), F.col("title").alias("title_b")), "id_b")
    near = score_pairs(both).filter("same").select(F.col("id_a").alias("id"), F.col("id_b").alias("matched_id"), "score")
    return near.unionByName(copies.join(unsure, "lead", "left_anti").select("id", F.col("lead").alias("matched_id"), F.lit(1.0).alias("score")))


def best_title_match(new: DataFrame, index: DataFrame, *, hours: int = 72, earlier: bool = False, arrived: str | None = None) -> DataFrame:
    """For each new article the most similar title of the index, the earliest id on a tie, and whether it is the same story.

    With ``earlier`` only lower ids count, for a table that is matched with itself.
    """
    pairs = title_candidates(new, index, hours=hours, arrived=arrived, earlier=earlier)
    named = pairs.join(new.select(F.col("id").alias("id_a"), F.col("title").alias("title_a")), "id_a").join(index.select(F.col("id").alias("id_b"), F.col("title").alias("title_b")), "id_b")
    scored = score_pairs(named, best_of="id_a").filter("score > 0")
    order = Window.partitionBy("id_a").orderBy(F.desc("score"), "id_b")
    return scored.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").select(F.col("id_a").alias("id"), F.col("id_b").alias("matched_id"), "score", "same")


def lead_by_arrival(links: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, leader): in order of id an article joins the leader it links to best, or leads itself.

    ``links`` has (id, matched_id, score) to earlier articles only. A link to a
    follower doesn't count, as followers aren't in the index. An article is
    decided once the best of its links that still count leads to a leader, or
    none is left; each round decides all of those. A round writes what it
    decided and the links that are still open, with what is known of their ends;
    it reads nothing of the rounds before.
    """
    links = written(links.select("id", "matched_id", "score"))
    open_ = links.select("id").distinct()
    decided = written(ids.select("id").join(open_, "id", "left_anti").withColumn("leader", F.col("id")))
    parts = [decided]
    # A row without a link stands for each open article, so that one whose links have all gone is still there; it is the least.
    none = open_.select("id", F.lit(None).cast(links.schema["matched_id"].dataType).alias("matched_id"), F.lit(None).cast(links.schema["score"].dataType).alias("score"))
    left = links.unionByName(none).withColumn("leads", F.lit(False))

    def told(left: DataFrame, new: DataFrame) -> DataFrame:
        """The links without those to articles that now follow; those to articles that now lead are marked."""
        ends = new.select(F.col("id").alias("matched_id"), (F.col("id") == F.col("leader")).alias("lead"))
        return written(left.join(ends, "matched_id", "left").filter("lead IS NOT false").select("id", "matched_id", "score", (F.col("leads") | F.col("lead").isNotNull()).alias("leads")))

    left = told(left, decided)
    drop_written(links)
    while not left.isEmpty():
        best = left.groupBy("id").agg(F.max_by(F.struct("matched_id", "leads"), F.struct("score", (-F.col("matched_id")).alias("first"))).alias("top"))
        new = written(best.filter("top.matched_id IS NULL OR top.leads").select("id", F.coalesce("top.matched_id", "id").alias("leader")))
        parts.append(new)
        before, left = left, told(left.join(new.select("id"), "id", "left_anti"), new)
        drop_written(before)
    drop_written(left)
    return reduce(DataFrame.unionByName, parts)


#: Blocks with such words are notes to visitors, not text of the article; callers may pass theirs.
JUNK = r"newsletter|subscribe|sign(ing)? (up|in)\b|log(ging)? in\b|\bcookies?\b|rights reserved|privacy policy|terms of (use|service)|share (this|on)\b|(read|see) also|related (posts|articles)"


def strip_pages(pages: DataFrame, *, least: int = 60, notes: str = JUNK) -> DataFrame:
    """Adds ``body``: all paragraphs, items and headings of the article, main part or page, of ``least`` characters or more and without a match of ``notes``."""
    import re
    from html import unescape
    from html.parser import HTMLParser

    junk = re.compile(notes, re.IGNORECASE)

    class Blocks(HTMLParser):
        drop = {"script", "style", "noscript", "svg", "form", "iframe", "nav", "header", "footer", "aside", "button"}
        take = {"p", "li", "h2", "h3"}
        roots = ("article", "main", "body")

        def __init__(self):
            super().__init__()
            self.skip, self.open, self.inside, self.found = 0, [], [], {r: [] for r in self.roots}

        def handle_starttag(self, tag, attrs):
            self.skip += tag in self.drop
            if tag in self.roots:
                self.inside.append(tag)
            if tag in self.take:
                self.close()
                self.open = [""]

        def handle_endtag(self, tag):
            if tag in self.drop:
                self.skip = max(0, self.skip - 1)
            if tag in self.take or tag in self.roots:
                self.close()
            if tag in self.roots and tag in self.inside:
                self.inside.remove(tag)

        def handle_data(self, data):
            if self.open and not self.skip:
                self.open.append(data)

        def close(self):
            text = " ".join("".join(self.open).split())
            if len(text) >= least and not junk.search(text):
                for root in {*self.inside, "body"}:
                    self.found[root].append(text)
            self.open = []

    def body(html: str | None) -> str:
        parser = Blocks()
        parser.feed(html or "")
        # The parser keeps text back that ends near an ampersand, as more might come.
        if "<" not in parser.rawdata:
            parser.handle_data(unescape(parser.rawdata))
        parser.close()
        blocks = next((parser.found[r] for r in parser.roots if parser.found[r]), [])
        return "\n".join(blocks)

    # Row by row, so that a worker holds a hundred pages at most, not a batch of ten thousand and its text twice over.
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.udf(body, "string", useArrow=False)(F.col("html").cast("string")).alias("body"))
