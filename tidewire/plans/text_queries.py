"""Scalar functions, scores, rules, similarity and search over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring, text, urls
from ..operators import classify, search, similar
from ..sources.shared import written
from .articles import ARTICLES, articles, clock, table
from .registry import query

W = "WITH " + ARTICLES
STOPS = "['" + "','".join(text.STOPWORDS) + "']"
#: SQL of squeeze() for the title column.
SQ = "trim(regexp_replace(replace(replace(title, chr(8203), ''), chr(160), ' '), '[ \\t\\r\\f\\v]+', ' ', 'g'))"
WORDS = f"list_filter(regexp_extract_all(lower({SQ}), '[a-z0-9]+(?:\\.[0-9]+)*'), lambda x: NOT list_contains({STOPS}, x) AND (length(x) > 1 OR regexp_matches(x, '[0-9]')))"
KEY = f"array_to_string(list_sort({WORDS}), ' ')"


@query(W + f"SELECT id, {KEY} AS title_key, CAST(len(list_distinct({WORDS})) AS INTEGER) AS tokens FROM art")
def str08_title_keys(spark, sf_dir):
    return articles(spark, sf_dir).select("id", text.title_key(F.col("title")).alias("title_key"), F.size(text.title_tokens(F.col("title"))).alias("tokens"))


@query(W + f"SELECT id, {SQ} AS title FROM art")
def str01_clean_title(spark, sf_dir):
    return articles(spark, sf_dir).select("id", text.squeeze(F.col("title")).alias("title"))


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\\b[0-9]+(?:\\.[0-9]+)*\\b'))), ' ') AS versions FROM documents")
def str09_versions(spark, sf_dir):
    # Letters beside a digit end a number only if they are ASCII words, in both engines.
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(text.versions(F.col("text"))), " ").alias("versions"))


@query("WITH c AS (SELECT doc_id, length(t) AS n, length(t) - length(regexp_replace(t, '[一-鿿]', '', 'g')) AS zh, length(t) - length(regexp_replace(t, '[぀-ヿ]', '', 'g')) AS ja, length(t) - length(regexp_replace(t, '[가-힯]', '', 'g')) AS ko FROM (SELECT doc_id, text AS t FROM documents)) SELECT doc_id, CASE WHEN zh >= greatest(3, n * 0.05) THEN 'zh' WHEN ja > n * 0.05 THEN 'ja' WHEN ko > n * 0.05 THEN 'ko' ELSE 'en' END AS language FROM c")
def str10_detect_language(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.detect_language(F.col("text")).alias("language"))


KEYWORDS = ["the", "and", "haus", "token", "licens-"]
_PAD = f"(' ' || lower({SQ}) || ' ')"


@query(W + f", h AS (SELECT id, is_free_offer, list_concat(list_filter(['the','and','haus','token'], lambda k: contains({_PAD.replace('title', 'tx')}, ' ' || k) OR contains({_PAD.replace('title', 'tx')}, k || ' ')), list_filter(['licens'], lambda k: contains({_PAD.replace('title', 'tx')}, k))) AS hits FROM (SELECT id, is_free_offer, coalesce(title, '') || '. ' || substr(coalesce(content, ''), 1, 800) AS tx FROM art)) SELECT id, array_to_string(hits, ',') AS hits, len(hits) >= 1 OR is_free_offer AS keep FROM h")
def flt07_str11_keyword_gate(spark, sf_dir):
    return classify.keyword_gate(articles(spark, sf_dir), KEYWORDS).select("id", F.array_join("hits", ",").alias("hits"), "keep")


@query("SELECT doc_id, " + " + ".join(f"CASE WHEN regexp_matches(lower(text), '(^|[^a-z0-9]){w}([^a-z0-9]|$)') THEN 1 ELSE 0 END" for w in ("the", "token", "der", "license")) + " AS hits FROM documents")
def str12_whole_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.whole_word_hits(F.lower("text"), ["the", "token", "der", "license"]).alias("hits"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)', '***@\1', 'g'), '\b(sk|ghp|xoxb)[-_][A-Za-z0-9_-]{8,}', '\1-***', 'g') AS text FROM documents")
def fmt01_redact(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.redact(F.col("text")).alias("text"))


@query("SELECT doc_id, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS text FROM documents")
def fmt01_escape(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.escape_html(F.col("text")).alias("text"))


@query("SELECT doc_id, CAST(length(text) + length(regexp_replace(text, '[^\U00010000-\U0010ffff]', '', 'g')) AS INTEGER) AS units FROM documents")
def fmt02_utf16_length(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.utf16_length(F.col("text")).alias("units"))


@query(
    "WITH f AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'), ' ') AS flat FROM documents), h AS (SELECT *, substr(flat, 1, 159) AS head, regexp_extract(substr(flat, 1, 159), '^(.*[.!?;,。！？；，])', 1) AS clause FROM f) "
    "SELECT doc_id, CASE WHEN length(flat) <= 160 THEN flat WHEN length(clause) >= 96 THEN rtrim(regexp_replace(clause, '[.!?;,。！？；，]$', '')) || '…' ELSE rtrim(head) || '…' END AS summary FROM h"
)
def str06_shorten(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.shorten(F.col("text"), 160).alias("summary"))


_T = "', '".join(t for t in urls.TRACKING if t == t.lower())
_HOST = r"regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)), '^www\.', '')"
_PATH = r"regexp_replace(regexp_replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/{2,}', '/', 'g'), '/+$', '')"
_QUERY = rf"array_to_string(list_sort(list_transform(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT list_contains(['{_T}'], lower(regexp_extract(p, '^([^=]*)', 1))) AND NOT starts_with(lower(p), 'utm_')), lambda p: regexp_replace(p, '=$', ''))), '&')"
NORMAL = f"'https://' || {_HOST} || CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END || CASE WHEN {_QUERY} = '' THEN '' ELSE '?' || {_QUERY} END"


@query(f"SELECT page_id, {NORMAL} AS url FROM pages")
def url01_normalize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.normalize_url(F.col("url")).alias("url"))


@query(f"SELECT page_id, sha1({NORMAL}) AS url_hash FROM pages")
def hsh01_url_hash(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.url_hash(F.col("url")).alias("url_hash"))


@query(W + f"SELECT id, sha1(substr(CASE WHEN {KEY} = '' THEN lower(title) ELSE {KEY} END, 1, 180)) AS event_key FROM art")
def hsh01_event_key(spark, sf_dir):
    return articles(spark, sf_dir).select("id", urls.event_key(F.col("title")).alias("event_key"))


@query(f"SELECT page_id, {_HOST} = 'example.org' OR ends_with({_HOST}, '.example.org') AS blocked FROM pages")
def flt08_blocked_domain(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.on_domain(F.col("url"), ["example.org"]).alias("blocked"))


@query("SELECT page_id, CASE WHEN regexp_matches(url, '^https?://') THEN url ELSE 'https://go.example.net/r?x=1&url=' || url_encode(url) END AS url FROM pages")
def url02_unwrap(spark, sf_dir):
    wrapped = F.concat(F.lit("https://go.example.net/r?x=1&url="), F.url_encode("url"))
    return table(spark, sf_dir, "pages").select("page_id", urls.unwrap_redirect(wrapped, ["go.example.net"]).alias("url"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\\b.*?</script>', ' ', 'g'), '(?is)<style\\b.*?</style>', ' ', 'g'), '(?is)<noscript\\b.*?</noscript>', ' ', 'g'), '(?is)<svg\\b.*?</svg>', ' ', 'g'), '(?is)<form\\b.*?</form>', ' ', 'g'), '(?is)<iframe\\b.*?</iframe>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?i)</(p|div|li|h[1-6]|tr)>|<br\\s*/?>', chr(10), 'g'), '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \\t\\r\\f]+', ' ', 'g'), ' ?\\n\\s*', chr(10), 'g'), ' ') AS text FROM pages")
def str03_strip_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.strip_markup(F.col("html")).alias("text"))


@query()
def htm01_extract(spark, sf_dir):
    return similar.strip_pages(table(spark, sf_dir, "pages")).select("page_id", F.length("body").alias("body_chars"), "body")


HEAT = "CASE WHEN l_quantity >= 50 THEN least(CAST(100 AS DOUBLE), h + 8) ELSE h END"


@query("WITH h AS (SELECT l_orderkey, l_linenumber, l_quantity, greatest(least(CAST(100 AS DOUBLE), log10(CAST(1 AS DOUBLE) + l_extendedprice) / log10(CAST(2001 AS DOUBLE)) * 100), least(CAST(100 AS DOUBLE), log10(CAST(1 AS DOUBLE) + l_quantity * CAST(0.3 AS DOUBLE)) / log10(CAST(2001 AS DOUBLE)) * 100)) AS h FROM lineitem) SELECT l_orderkey, l_linenumber, floor((" + HEAT + ") * CAST(10 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(10 AS DOUBLE) AS heat FROM h")
def scr01_community_heat(spark, sf_dir):
    heat = scoring.community_heat({"points": F.col("l_extendedprice"), "comments": F.col("l_quantity")})
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", heat.alias("heat"))


AGE = "(date_sub('second', published_at, as_of) / CAST(3600 AS DOUBLE))"
NOV = f"CASE WHEN {AGE} <= 0 THEN 100.0 WHEN {AGE} <= 6 THEN 95.0 WHEN {AGE} <= 24 THEN 85.0 WHEN {AGE} <= 48 THEN 65.0 WHEN {AGE} <= 96 THEN 45.0 ELSE greatest(CAST(10 AS DOUBLE), CAST(100 AS DOUBLE) - {AGE} / CAST(6 AS DOUBLE)) END"


@query(W + f"SELECT id, CAST({NOV} AS DOUBLE) AS novelty FROM art, clock")
def scr02_novelty(spark, sf_dir):
    from ..operators.feed import at

    age = F.timestamp_diff("SECOND", F.col("published_at"), at(clock(spark, sf_dir))) / 3600.0
    return articles(spark, sf_dir).select("id", scoring.novelty(age).alias("novelty"))


@query(W + "SELECT id, CAST(CASE tier WHEN 'A' THEN 95 WHEN 'B' THEN 80 WHEN 'C' THEN 65 ELSE 45 END AS DOUBLE) AS source_quality, CAST(CASE tier WHEN 'A' THEN 100 WHEN 'B' THEN 100 WHEN 'C' THEN 78 ELSE 68 END AS DOUBLE) AS cap FROM art")
def scr03_scr05_tiers(spark, sf_dir):
    return articles(spark, sf_dir).select("id", scoring.source_quality(F.col("tier")).alias("source_quality"), scoring.tier_cap(F.col("tier")).alias("cap"))


_D = lambda x: f"CAST({x} AS DOUBLE)"


@query(W + f""", s AS (SELECT id, tier, CAST({NOV} AS DOUBLE) AS nov, n_chars % 8 AS hits, least(heat, 100) AS heat,
  CAST(CASE tier WHEN 'A' THEN 95 WHEN 'B' THEN 80 WHEN 'C' THEN 65 ELSE 45 END AS DOUBLE) AS src, CAST(CASE tier WHEN 'A' THEN 100 WHEN 'B' THEN 100 WHEN 'C' THEN 78 ELSE 68 END AS DOUBLE) AS cap FROM art, clock),
p AS (SELECT *, least({_D(85)}, {_D(28)} + {_D(4.5)} * hits + CASE WHEN tier = 'A' THEN 12 ELSE 0 END) AS imp, least({_D(88)}, {_D(32)} + {_D(4.5)} * hits) AS rel FROM s),
b AS (SELECT *, imp * {_D(0.35)} + rel * {_D(0.30)} + nov * {_D(0.15)} + src * {_D(0.10)} AS base FROM p)
SELECT id, floor(greatest({_D(0)}, least(cap, CASE WHEN heat > 0 THEN base + heat * {_D(0.10)} ELSE base / {_D(0.9)} END)) * {_D(10)} + {_D(0.5)}) / {_D(10)} AS score FROM b""")
def scr06_scr07_final_score(spark, sf_dir):
    from ..operators.feed import at

    age = F.timestamp_diff("SECOND", F.col("published_at"), at(clock(spark, sf_dir))) / 3600.0
    hits = F.col("n_chars") % 8
    heat = F.least(F.col("heat"), F.lit(100.0))
    score = scoring.final_score(scoring.rule_importance(hits, F.col("tier")), scoring.rule_relevance(hits), scoring.novelty(age), scoring.source_quality(F.col("tier")), heat, F.col("tier"))
    return articles(spark, sf_dir).select("id", score.alias("score"))


@query(W + "SELECT id, floor(greatest(CAST(-30 AS DOUBLE), least(CAST(15 AS DOUBLE), CASE WHEN contains(lower(title), 'the') THEN CAST(7.5 AS DOUBLE) ELSE 0 END + CASE WHEN contains(lower(title), 'der') THEN CAST(-24 AS DOUBLE) ELSE 0 END + CASE WHEN lower(category) = 'agents' OR contains(lower(title), 'agents') THEN CAST(15 AS DOUBLE) ELSE 0 END)) * 10 + CAST(0.5 AS DOUBLE)) / CAST(10 AS DOUBLE) AS bonus FROM art")
def scr04_interest_bonus(spark, sf_dir):
    likes = [("topic", "the", 1.0), ("exclude", "der", 1.0), ("topic", "Agents", 2.0)]
    art = articles(spark, sf_dir)
    bonus = scoring.interest_bonus(F.lower("title"), F.array().cast("array<string>"), F.col("category"), likes)
    return art.select("id", bonus.alias("bonus"))


@query(W + ", canon AS (SELECT event_id, arg_max(id, (final_score, published_at, id)) AS cid, max(final_score) AS s FROM art WHERE event_id IS NOT NULL GROUP BY 1) SELECT a.id, coalesce(c.s, a.final_score) AS final_score FROM art a LEFT JOIN canon c ON a.event_id = c.event_id")
def scr09_sibling_scores(spark, sf_dir):
    art = articles(spark, sf_dir)
    best = art.filter("event_id IS NOT NULL").groupBy("event_id").agg(F.max("final_score").alias("s"))
    return art.join(best, "event_id", "left").select("id", F.coalesce("s", "final_score").alias("final_score"))


def _category_sql() -> str:
    import math

    hit = lambda col, w: f"CASE WHEN regexp_matches({col}, '(^|[^a-z0-9]){w}([^a-z0-9]|$)') THEN 1 ELSE 0 END"
    rows = []
    for i, (name, words) in enumerate(_TAXONOMY.items()):
        t = " + ".join(hit("t", w) for w in words)
        b = " + ".join(hit("b", w) for w in words)
        rows.append(f"{{'score': (2 * ({t}) + ({b})) / CAST({math.sqrt(len(words))!r} AS DOUBLE), 'short': {-len(name)}, 'first': {-i}, 'name': '{name}'}}")
    body = f"lower(concat_ws(' ', {SQ}, substr({SQ.replace('title', 'content')}, 1, 1200)))"
    return (
        W + f", x AS (SELECT id, lower({SQ}) AS t, {body} AS b FROM art), s AS (SELECT id, [{', '.join(rows)}] AS s FROM x), "
        "m AS (SELECT id, list_max(s) AS m, list_sum(list_transform(s, lambda x: x.score)) AS total FROM s) "
        "SELECT id, CASE WHEN m.score > 0 THEN m.name END AS rule_category, CASE WHEN m.score > 0 THEN floor(least(m.score / total, CAST(1 AS DOUBLE)) * 100 + CAST(0.5 AS DOUBLE)) / CAST(100 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS confidence FROM m"
    )


_TAXONOMY = {"Models": ["the", "of", "to"], "Agents": ["der", "die", "und"], "Research": ["de", "la", "les", "que"], "Open Source": ["license", "licensed", "version"]}


@query(_category_sql())
def cls01_rule_classify(spark, sf_dir):
    return classify.categorize(articles(spark, sf_dir), _TAXONOMY).select("id", "rule_category", "confidence")


@query(
    W + f""", g AS (SELECT id, {AGE} AS age, regexp_matches(source_name, '{classify.NO_SOURCE}') AS crowd, regexp_matches(title, '{classify.EVENT}') AND NOT regexp_matches(title, '{classify.NO_TITLE}') AS event,
  tier IN ('C', 'D') AND heat < 250 AS weak, final_score < 45 AND heat < 250 AS low FROM art, clock),
v AS (SELECT id, CASE WHEN crowd THEN 'blocked source' WHEN NOT event THEN 'no event' WHEN (weak OR low) AND age <= 24 THEN 'wait for heat' WHEN weak THEN 'weak source' WHEN low THEN 'low score' WHEN age > 24 THEN 'too old' ELSE 'pass' END AS verdict FROM g)
SELECT id, verdict, verdict = 'pass' AS passes FROM v"""
)
def gte01_breaking_gate(spark, sf_dir):
    from ..operators.feed import at

    art = articles(spark, sf_dir).withColumn("source_quality", scoring.source_quality(F.col("tier")))
    return classify.breaking_gate(art, as_of=at(clock(spark, sf_dir))).select("id", "verdict", "passes")


TERMS = ["Licensed", "Version", "The", "Der", "Les", "And", "token"]


@query(W + r", t AS (SELECT id, source_name, list_filter(regexp_extract_all(concat_ws('. ', title, content), '\b(Licensed|Version|token|The|Der|Les|And)\b', 1), lambda x: true) AS l FROM art), u AS (SELECT id, source_name, list_transform(list_sort(list_distinct(list_transform(l, lambda x: {'p': list_position(l, x), 'w': x}))), lambda x: x.w)[1:6] AS l FROM t) SELECT id, CASE WHEN len(l) > 0 THEN array_to_string(l, ',') ELSE source_name END AS tags FROM u")
def tag01_rule_tags(spark, sf_dir):
    return classify.tags(articles(spark, sf_dir), TERMS).select("id", F.array_join("tags", ",").alias("tags"))


@query()
def off01_detect_offer(spark, sf_dir):
    found = classify.detect_offer(articles(spark, sf_dir), tools=["the", "version", "der"], strong=["licensed under", "token"], weak=["of"])
    return found.select("id", "offer.tool", F.array_join("offer.signals", ",").alias("signals"), "offer.in_title", "offer.confidence")


@query()
def jn07_title_matches(spark, sf_dir):
    """The best match of every title among the leading titles at most 72 hours older, and whether it is the same story; a test has a loop."""
    art = written(similar.distinct_titles(articles(spark, sf_dir)))
    leads = art.filter("id = lead")
    near = similar.best_title_match(leads, leads, earlier=True)
    copies = art.filter("id <> lead").select("id", F.col("lead").alias("matched_id"), F.lit(1.0).alias("score"), F.lit(True).alias("same"))
    return copies.unionByName(near)


@query(W + "SELECT x.id, min(y.id) AS first_id FROM art x JOIN art y ON sha1(x.content) = sha1(y.content) GROUP BY x.id")
def jn08_content_identity(spark, sf_dir):
    art = articles(spark, sf_dir).withColumn("h", F.sha1("content"))
    return art.join(art.groupBy("h").agg(F.min("id").alias("first_id")), "h").select("id", "first_id")


SEARCH = "the and token"


@query(W + ", h AS (SELECT *, lower(concat_ws(chr(10), title, content, title_zh, summary_zh)) AS hay FROM art), w AS (SELECT id, CASE WHEN contains(hay, 'the and token') THEN 3 ELSE 0 END + CASE WHEN contains(hay, 'the') THEN 2 ELSE 0 END + CASE WHEN contains(hay, 'and') THEN 2 ELSE 0 END + CASE WHEN contains(hay, 'token') THEN 2 ELSE 0 END + CASE WHEN contains(hay, 'the and') THEN 1 ELSE 0 END + CASE WHEN contains(hay, 'and token') THEN 1 ELSE 0 END AS weight FROM h) SELECT id, weight FROM w WHERE weight >= 2")
def sch01_search(spark, sf_dir):
    return search.search(articles(spark, sf_dir), SEARCH).select("id", "weight")
