"""Registered queries: vocabularies as tables, offers by spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates
from ..operators import offers, search, vocabulary
from .articles import ARTICLES, articles, table
from .registry import query

W = "WITH " + ARTICLES

#: Where each term stands alone in x, by the pieces that it parts the text into.
_PLACES = """
pieces AS (SELECT *, string_split(x, term) AS p FROM met),
parts AS (SELECT * EXCLUDE (p), unnest(range(1, len(p))) AS k, p FROM pieces),
spans AS (SELECT * EXCLUDE (p, k), CAST(list_sum([length(q) FOR q IN p[1:k]]) + (k - 1) * length(term) AS INTEGER) AS b FROM parts
          WHERE NOT regexp_matches(CASE WHEN k > 1 THEN term ELSE '' END || p[k], '[a-z0-9]$')
            AND (NOT regexp_matches(p[k + 1] || CASE WHEN k + 1 < len(p) THEN term ELSE '' END, '^[a-z0-9]') OR regexp_matches(p[k + 1] || CASE WHEN k + 1 < len(p) THEN term ELSE '' END, '^v[0-9]')))
"""


@query(
    "WITH w AS (SELECT regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark), t AS (SELECT DISTINCT unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w)) IF w[i] <> w[i + 1]]) AS term FROM w), "
    "met AS (SELECT doc_id AS id, lower(text) AS x, term FROM documents, t WHERE contains(lower(text), term)), " + _PLACES + "SELECT id, term, CAST(count(*) AS INTEGER) AS n, min(b) AS first FROM spans GROUP BY id, term"
)
def jn09_vocabulary_join(spark, sf_dir):
    """All pairs of different neighbouring words of the benchmark as a vocabulary, and where they stand in the documents."""
    words = table(spark, sf_dir, "benchmark").select(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("w")).filter(F.size("w") > 1)
    pairs = F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.concat_ws(" ", F.get("w", i), F.get("w", i + 1)))
    terms = words.select(F.explode(pairs).alias("term")).filter("split_part(term, ' ', 1) <> split_part(term, ' ', 2)")
    hits = vocabulary.term_hits(table(spark, sf_dir, "documents"), terms, id_col="doc_id")
    return hits.select("id", "term", F.size("starts").alias("n"), F.array_min("starts").alias("first"))


#: Words of the invented prose in the roles of an offer: (role, term, name, rank, kind, strong).
_OFFERS = [
    ("signal", "licensed under", None, None, None, True),
    ("signal", "token", None, None, None, True),
    ("signal", "of", None, None, None, False),
    ("signal", "with", None, None, None, False),
    ("tool", "version", "Version", 0, "agent", None),
    ("tool", "license", "License", 1, "platform", None),
    ("tool", "the license", "License", 1, "platform", None),
    ("tool", "the", "The", 2, "vendor", None),
    ("tool", "and", "And", 2, "vendor", None),
    ("model", "then", None, None, None, None),
    ("model", "here", None, None, None, None),
    ("model", "thin", None, None, None, None),
]


def _value(v: object) -> str:
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)


_ROWS = ", ".join(f"({', '.join(map(_value, row))}, {place})" for place, row in enumerate(_OFFERS))


@query(
    W + f", v(role, term, name, rank, kind, strong, place) AS (VALUES {_ROWS}), "
    "txt AS (SELECT id, length(coalesce(title, '')) AS n, replace(lower(coalesce(title, '')), 'with the', ' ') AS head, replace(lower(coalesce(content, '')), 'with the', ' ') AS body FROM art), "
    "met AS (SELECT id, length(head) AS n, head || ' ' || chr(10) || ' ' || substr(body, 1, 2500) AS x, v.* FROM txt, v WHERE contains(head || ' ' || chr(10) || ' ' || substr(body, 1, 2500), term)), "
    + _PLACES
    + """,
sp AS (SELECT * EXCLUDE (x), b + length(term) AS f, b + length(term) <= n AS inside FROM spans),
sig AS (SELECT * FROM sp WHERE role = 'signal' AND (inside OR strong)),
ids AS (SELECT id, bool_or(inside) AS in_title, bool_and(b > n) AS body_only, count(DISTINCT term) AS n_signals, string_agg(DISTINCT lpad(CAST(place AS VARCHAR), 3, '0') || term, ',' ORDER BY lpad(CAST(place AS VARCHAR), 3, '0') || term) AS listed FROM sig GROUP BY id),
near AS (SELECT t.id, t.name, t.kind, t.rank, t.b, t.f, t.term, t.inside, min(CASE WHEN s.b <= t.f AND t.b <= s.f THEN 0 ELSE least(abs(t.b - s.f), abs(s.b - t.f)) END) AS gap FROM sp t JOIN sig s ON s.id = t.id WHERE t.role = 'tool' GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY NOT inside, rank, gap, b, -length(term), name) AS rn FROM near) WHERE rn = 1),
own AS (SELECT b.id, min(x.gap) AS gap, bool_or(x.inside) AS shown FROM top b JOIN near x ON x.id = b.id AND x.name = b.name GROUP BY b.id),
m AS (SELECT id, arg_min(term, (-length(term), b)) AS term FROM sp WHERE role = 'model' AND inside AND length(term) >= 4 GROUP BY id),
known AS (SELECT id, count(DISTINCT term) AS n FROM sp WHERE role = 'model' GROUP BY id)
SELECT i.id, coalesce(b.name, CASE WHEN i.in_title THEN m.term END) AS tool, CASE WHEN b.name IS NULL THEN 'model' ELSE b.kind END AS kind, i.n_signals,
       round(least(1.0, 0.45 + 0.12 * i.n_signals + CASE WHEN coalesce(k.n, 0) > 0 THEN 0.2 ELSE 0 END + CASE WHEN i.in_title THEN 0.1 ELSE 0 END - CASE WHEN b.name IS NULL THEN 0.1 ELSE 0 END)::DOUBLE, 2) AS confidence,
       b.name IS NULL OR o.shown AS subject_in_title, CAST(o.gap AS INTEGER) AS gap
FROM ids i LEFT JOIN top b ON b.id = i.id LEFT JOIN own o ON o.id = i.id LEFT JOIN m ON m.id = i.id LEFT JOIN known k ON k.id = i.id
WHERE coalesce(b.name, CASE WHEN i.in_title THEN m.term END) IS NOT NULL AND (NOT i.body_only OR coalesce(o.gap, 141) <= 140)
"""
)
def off02_offer_spans(spark, sf_dir):
    """Offers by spans over the articles: all signals and subjects with their places, ranked by title, rank, gap and place."""
    words = spark.createDataFrame([(term, role, name, rank, kind, strong, place) for place, (role, term, name, rank, kind, strong) in enumerate(_OFFERS)], offers.ROLES)
    found = offers.detect_offers(articles(spark, sf_dir), words, friends=["with the"], body_limit=2500)  # as its SQL has it
    return found.select("id", "tool", "kind", F.size("signals").cast("long").alias("n_signals"), "confidence", "subject_in_title", "gap")


@query(
    "WITH o AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, CAST(o_orderkey % 300 AS INTEGER) AS n, o_orderkey % 7 AS k FROM orders) "
    "SELECT id, CASE WHEN k IN (0, 1, 2, 4) THEN strftime(day + n, '%Y-%m-%d') WHEN k = 3 THEN strftime(day + CAST((isodow(day + n) - isodow(day) + 7) % 7 AS INTEGER), '%Y-%m-%d') WHEN k = 5 THEN strftime(last_day(day + n), '%Y-%m-%d') END AS ends FROM o"
)
def off01_offer_expiry(spark, sf_dir):
    """Orders as offers that say in six ways when they end; the SQL knows the day and reads no text."""
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "o_orderdate AS day", "o_orderkey % 7 AS k", "date_add(CAST(o_orderdate AS DATE), CAST(o_orderkey % 300 AS INT)) AS ends", "CAST(o_orderkey % 300 AS INT) AS n")
    said = orders.selectExpr(
        "id",
        "day",
        "CASE k WHEN 0 THEN concat('Free until ', day(ends), date_format(ends, ' MMMM'), ' for all') WHEN 1 THEN concat('through ', date_format(ends, 'MMM'), ' ', day(ends), ', ', year(ends)) "
        "WHEN 2 THEN concat('no charge for ', n, ' days') WHEN 3 THEN concat('open till ', date_format(ends, 'EEEE')) WHEN 4 THEN concat('截至 ', month(ends), '月', day(ends), '日') "
        "WHEN 5 THEN concat('free by ', date_format(ends, 'MMMM')) ELSE 'free for good' END AS said",
    )
    found = dates.expiry(F.col("said"), F.col("day"))
    return said.select("id", F.date_format(found["ends"], "yyyy-MM-dd").alias("ends"))


@query(
    "WITH RECURSIVE " + ARTICLES + """,
wd AS (SELECT item_id AS q, regexp_extract_all(text, '[A-Za-z]+') AS w FROM benchmark),
said AS (SELECT q, array_to_string(w[1:3], ' ') AS raw, [x FOR x IN w[1:3] IF length(x) >= 2] AS t FROM wd),
qs AS (SELECT q, raw, [t[i] FOR i IN range(1, len(t) + 1) IF list_position([lower(x) FOR x IN t], lower(t[i])) = i] AS t FROM said),
al AS (SELECT q AS g, lower(unnest([w[2], w[5]])) AS word FROM wd),
edge AS (SELECT DISTINCT a.g, b.g AS h FROM al a JOIN al b ON a.word = b.word),
reach AS (SELECT g, g AS h FROM al UNION SELECT r.g, e.h FROM reach r JOIN edge e ON r.h = e.g),
lab AS (SELECT g, min(h) AS component FROM reach GROUP BY g),
known AS (SELECT word, min(component) AS component FROM al JOIN lab ON al.g = lab.g GROUP BY word),
hay AS (SELECT q, raw, t, lower(raw || ' ' || array_to_string(t, ' ')) AS hay FROM qs),
touched AS (SELECT DISTINCT q, component FROM hay JOIN known ON length(word) >= 2 AND contains(hay, word)),
members AS (SELECT q, component, word FROM touched JOIN known USING (component)),
others AS (SELECT q, word, row_number() OVER (PARTITION BY q ORDER BY component, word) AS n FROM members JOIN hay USING (q) WHERE NOT contains(hay, word)),
pool AS (SELECT q, lower(p) AS p, max(w) AS w FROM (SELECT q, raw AS p, 3 AS w FROM qs UNION ALL SELECT q, unnest(t), 2 FROM qs UNION ALL SELECT q, array_to_string(t[1:3], ''), 2 FROM qs
          UNION ALL SELECT q, word, 2 FROM others WHERE n <= 6) WHERE length(p) >= 2 GROUP BY q, lower(p)),
cov AS (SELECT DISTINCT pool.q, p, component FROM pool JOIN members USING (q) WHERE contains(p, word) OR contains(word, p)),
hit AS (SELECT pool.q, p, w, art.id FROM pool JOIN art ON contains(lower(concat_ws(chr(10), title, content, title_zh, summary_zh)), p)),
good AS (SELECT q, id, sum(w) AS weight FROM hit GROUP BY q, id),
met AS (SELECT hit.q, id, count(DISTINCT component) AS n FROM hit JOIN cov ON cov.q = hit.q AND cov.p = hit.p GROUP BY hit.q, id),
asked AS (SELECT q, count(DISTINCT component) AS n FROM cov GROUP BY q),
kept AS (SELECT good.q, good.id, weight, coalesce(met.n, 0) AS touched, row_number() OVER (PARTITION BY good.q ORDER BY weight DESC, final_score DESC, published_at DESC, good.id DESC) AS rank
         FROM good LEFT JOIN met ON met.q = good.q AND met.id = good.id LEFT JOIN asked ON asked.q = good.q JOIN art ON art.id = good.id
         WHERE weight >= 2 AND (coalesce(asked.n, 0) < 2 OR coalesce(met.n, 0) >= 2))
SELECT q AS query_id, CAST(rank AS INTEGER) AS rank, id, CAST(weight AS BIGINT) AS weight, CAST(touched AS INTEGER) AS touched FROM kept WHERE rank <= 20
"""
)
def sch03_many_queries(spark, sf_dir):
    """The first three words of every benchmark item as a query, with alias groups from its words, over all articles."""
    words = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)).alias("w"))
    queries = words.select("query_id", F.array_join(F.slice("w", 1, 3), " ").alias("query"))
    aliases = words.select(F.col("query_id").alias("group_id"), F.explode(F.array(F.get("w", F.lit(1)), F.get("w", F.lit(4)))).alias("word"))
    return search.search_many(articles(spark, sf_dir), queries, aliases)


@query(
    "WITH RECURSIVE p AS (SELECT p_partkey AS g, lower(unnest(string_split(p_name, ' '))) AS word FROM part), n AS (SELECT p_partkey % 97 AS g, word || '-' || (g % 7) AS word FROM p JOIN part ON p_partkey = g), "
    "d AS (SELECT DISTINCT g, word FROM n), e AS (SELECT DISTINCT a.g, b.g AS h FROM d a JOIN d b ON a.word = b.word), r AS (SELECT g, g AS h FROM d UNION SELECT r.g, e.h FROM r JOIN e ON r.h = e.g), "
    "l AS (SELECT g, min(h) AS component FROM r GROUP BY g) SELECT word, min(component) AS component FROM d JOIN l ON d.g = l.g GROUP BY word"
)
def set06_alias_components(spark, sf_dir):
    """Names of parts as alias groups; groups that share a word, over any number of others, are one component."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.explode(F.split(F.lower("p_name"), " ")).alias("w"))
    return search.alias_components(part.select((F.col("k") % 97).alias("group_id"), F.concat("w", F.lit("-"), (F.col("k") % 7).cast("string")).alias("word")))
