"""Terms of a table found in texts, and offers from what stands near what, against loops."""

import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewire.operators import offers, search, vocabulary


def places(text, term, whole_words=True):
    """Every place where the term stands, by hand."""
    low, out = (text or "").lower(), []
    for i in range(len(low)):
        if low.startswith(term, i):
            rest = low[i + len(term) :]
            alone = not (i and low[i - 1] in "abcdefghijklmnopqrstuvwxyz0123456789") and (not rest[:1].isascii() or not rest[:1].isalnum() or re.match(r"v\d", rest))
            if not whole_words or not term.isascii() or alone:
                out.append(i)
    return out


def hits_of(spark, texts, terms, whole_words=True):
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    words = spark.createDataFrame([(t,) for t in terms], "term string")
    return {(r.id, r.term): r.starts for r in vocabulary.term_hits(rows, words, whole_words=whole_words).collect()}


def by_hand(texts, terms, whole_words=True):
    clean = {t.strip().lower() for t in terms if t and len(t.strip()) >= 2}
    return {(i, t): p for i, x in enumerate(texts) for t in clean if (p := places(x, t, whole_words))}


TEXTS = ["NAMEv2 is out, name-3 too; namely not", "限免100刀DeepSeekv4.1Flash 免费", "a c++ and $0 and $$ deal", "free free tier free", None, "", "av1v2 av1 a.v1", "x\\Ey \\Q regex .* (a", "ending in name", "name", "naïve 免费免费"]
TERMS = ["name", "deepseek", "免费", "限免", "c++", "$0", "$$", "free", "free tier", "av1", "\\e", ".*", "(a", "x", " Tier ", None, "免费免", "av", "100刀", "naïve"]


@pytest.mark.parametrize("whole_words", [True, False])
def test_terms_stand_where_a_scan_finds_them(spark, whole_words):
    assert hits_of(spark, TEXTS, TERMS, whole_words) == by_hand(TEXTS, TERMS, whole_words)
    rnd = random.Random(2)
    chars = ["a", "b", "v", "1", "2", " ", "-", ".", "免", "费", "é", "$"]
    texts = ["".join(rnd.choices(chars, k=rnd.randrange(25))) for _ in range(150)]
    terms = ["".join(rnd.choices(chars, k=rnd.randrange(1, 5))) for _ in range(150)]
    assert hits_of(spark, texts, terms, whole_words) == by_hand(texts, terms, whole_words)
    assert not hits_of(spark, [], terms, whole_words) and not hits_of(spark, texts, [], whole_words)


@pytest.mark.parametrize("whole_words", [True, False])
def test_small_vocabularies_are_carried_and_large_ones_inverted_alike(spark, whole_words, monkeypatch):
    rnd = random.Random(5)
    chars = ["a", "b", "v", "1", " ", "-", "免", "é", "$"]
    texts = TEXTS + ["".join(rnd.choices(chars, k=rnd.randrange(25))) for _ in range(100)]
    terms = TERMS + ["".join(rnd.choices(chars, k=rnd.randrange(1, 5))) for _ in range(100)]
    rows, words = spark.createDataFrame(list(enumerate(texts)), "id long, text string"), spark.createDataFrame([(t,) for t in terms], "term string")
    carried = vocabulary.term_hits(rows, words, whole_words=whole_words)
    assert "Join" not in carried._jdf.queryExecution().toString()  # noqa: SLF001 - texts stay where they are
    monkeypatch.setattr(vocabulary, "_FEW", 0)
    assert hits_of(spark, texts, terms, whole_words) == by_hand(texts, terms, whole_words) == {(r.id, r.term): r.starts for r in carried.collect()}
    assert {tuple(r) for r in vocabulary.contained(rows, words).collect()} == set(by_hand(texts, terms, False))


def test_texts_are_listed_for_the_rarest_keys_alone(spark, monkeypatch):
    """A term of common words and one rare one: no text but that with the rare word is looked at."""
    rows = spark.createDataFrame([(i, "of the open and the open tier" if i else "of the open and the open zebra") for i in range(50)], "id long, text string")
    known = spark.createDataFrame([("the open zebra",), ("open zebra",), ("open and",)], "term string")
    posted, keyed = [], vocabulary._keyed  # noqa: SLF001
    monkeypatch.setattr(vocabulary, "_keyed", lambda *a, **kw: posted.append(out := keyed(*a, **kw)) or out)
    _, maybe = vocabulary._candidates(rows, known.filter("term <> 'open and'"), "id", "text", "term", True)  # noqa: SLF001
    assert {r.id: sorted(r.terms) for r in maybe.collect()} == {0: ["open zebra", "the open zebra"]}
    assert {r.key for r in posted[-1].collect()} == {"open zebra"}


def test_a_vocabulary_of_a_hundred_thousand_terms(spark):
    """Terms of one to three words; the plan holds none of them, and texts have known ones."""
    rnd = random.Random(4)
    words = ["".join(rnd.choices("bcdfglmnprst", k=2)) + rnd.choice("aeiou") + "".join(rnd.choices("bcdfgnrst", k=2)) for _ in range(30000)]
    terms = list({" ".join(rnd.choices(words, k=rnd.choice([1, 2, 2, 3]))) for _ in range(110_000)})[:100_000]
    texts = [" ".join(rnd.choices(words, k=60) + rnd.sample(terms, 2)) for _ in range(200)]
    index = {}
    for t in terms:
        index.setdefault(t.split()[0], []).append(t)
    want = {(i, t): p for i, x in enumerate(texts) for w in set(x.split()) for t in index.get(w, []) if (p := places(x, t))}
    assert hits_of(spark, texts, terms) == want and len(want) >= 400


VOCABULARY = (
    [("tool", alias, name, rank, kind, None) for name, rank, kind, aliases in (("Forge", 0, "agent", ["forge", "forge cli"]), ("Gateway", 1, "platform", ["gateway"]), ("Lark", 2, "vendor", ["lark", "云雀"])) for alias in aliases]
    + [("signal", s, None, None, None, s in ("free tier", "is free", "免费")) for s in ("free", "is free", "free tier", "no cost", "免费")]
    + [("model", m, None, None, None, None) for m in ("lark-7b", "stilt-mini", "pip")]
)

#: Titles with body, whether they are an offer, and of what.
CASES = [
    ("Forge is free this week", "", "Forge"),
    ("Lark released, Forge CLI with free tier", "", "Forge"),
    ("Gateway: Lark-7B is free", "", "Gateway"),
    ("Lark is free on all plans", "", "Lark"),
    ("云雀限时免费开放", "", "Lark"),
    ("free stilt-mini for all", "", "stilt-mini"),
    ("free pip for all", "", None),
    ("stilt-mini came out", "now with a free tier of its own", None),
    ("Lark day", "x " * 40 + "the Forge has a free tier now", "Lark"),
    ("A day in spring", "the Forge has a free tier now", "Forge"),
    ("A day in spring", "Forge " + "x " * 90 + "has a free tier now", None),
    ("A day in spring", "Forge has no cost here", None),
    ("Camera-free Forge glasses", "", None),
    ("Feel free to try Forge", "", None),
    ("Forge 2.0 ships", "faster builds", None),
    ("Freedom for Forge users", "", None),
    ("Forgev2 is free", "", "Forge"),
    ("Forged papers, free entry", "", None),
    ("本次咕咕站免费", "", "咕咕站"),
    (None, None, None),
]
FRIENDS = ["camera-free", "feel free"]


def vocabulary_of(spark):
    rows = [(term, role, name, rank, kind, strong, place) for place, (role, term, name, rank, kind, strong) in enumerate(VOCABULARY)]
    return spark.createDataFrame(rows, offers.ROLES)


def loop_offer(title, body):
    """The rules one after another on lists of spans."""
    clean = lambda t: re.sub("|".join(map(re.escape, FRIENDS)), " ", (t or "").lower())
    head = clean(title)
    text = f"{head} \n {clean(body)[:2500]}"
    spans = [(i, i + len(t), role, t, name, rank, kind, strong) for role, t, name, rank, kind, strong in VOCABULARY for i in places(text, t)]
    signals = [s for s in spans if s[2] == "signal" and (s[1] <= len(head) or s[7])]
    if not signals:
        return None
    gap = lambda s: min(0 if t[0] <= s[1] and s[0] <= t[1] else min(abs(s[0] - t[1]), abs(t[0] - s[1])) for t in signals)
    tools = sorted((s[1] > len(head), s[5], gap(s), s[0], -len(s[3]), s[4], s[6]) for s in spans if s[2] == "tool")
    in_title = any(s[1] <= len(head) for s in signals)
    models = sorted((-len(s[3]), s[0], s[3]) for s in spans if s[2] == "model" and s[1] <= len(head) and len(s[3]) >= 4)
    model = models[0][2] if models and in_title and not tools else None
    site = re.search("(?:本次)?([一-鿿]{2,6}站)", head) if in_title and not tools and not model else None
    tool = tools[0][5] if tools else model or (site and site[1])
    if not tool:
        return None
    near = [gap(s) for s in spans if s[2] == "tool" and s[4] == tool]
    if all(s[0] > len(head) for s in signals) and min(near, default=999) > 140:
        return None
    order = [t for _, t, *_ in VOCABULARY]
    found = [t for t in dict.fromkeys(order) if t in {s[3] for s in signals}]
    known = [t for t in dict.fromkeys(order) if t in {s[3] for s in spans if s[2] == "model"}][:3]
    score = min(1.0, 0.45 + 0.12 * len(found) + 0.2 * bool(known) + 0.1 * in_title - 0.1 * bool(model))
    shown = any(s[1] <= len(head) for s in spans if s[2] == "tool" and s[4] == tool) or not tools
    return tool, "model" if model else tools[0][6] if tools else "other", found, known, round(score + 1e-9, 2), shown


def test_offers(spark):
    rows = [(i, t, b) for i, (t, b, _) in enumerate(CASES)]
    rows += [(100 + 20 * i + j, f"{(a or '')} {(c or '')}", f"{(d or '')} {(b or '')}") for i, (a, b, _) in enumerate(CASES) for j, (c, d, _) in enumerate(CASES)]
    frame = spark.createDataFrame(rows, "id long, title string, content string")
    found = offers.detect_offers(frame, vocabulary_of(spark), friends=FRIENDS, named_site="(?:本次)?([一-鿿]{2,6}站)")
    got = {r.id: (r.tool, r.kind, r.signals, r.models, r.confidence, r.subject_in_title) for r in found.collect()}
    for i, (title, body, tool) in enumerate(CASES):
        assert (got[i][0] if i in got else None) == tool, title
    want = {i: o for i, t, b in rows if (o := loop_offer(t, b))}
    assert {i: o for i, o in got.items()} == want


def test_offers_of_nothing(spark):
    frame = spark.createDataFrame([], "id long, title string, content string")
    assert offers.detect_offers(frame, vocabulary_of(spark)).count() == 0
    some = spark.createDataFrame([(1, "Forge is free", "")], "id long, title string, content string")
    assert offers.detect_offers(some, vocabulary_of(spark).limit(0)).count() == 0
    assert offers.detect_offers(some, vocabulary_of(spark).filter(F.col("role") == "signal")).count() == 0


def test_what_queries_for_offers_name(spark):
    said = ["", None, "forge", "Forge CLI 7", "lark 14d models", "90", "cheap gpu", "what of forge", "400d", "forgery"]
    asked = spark.createDataFrame(list(enumerate(said)), "query_id long, query string")
    got = {r.query_id: (r.days, r.tool, r.keyword) for r in offers.tool_named(asked, vocabulary_of(spark)).collect()}
    assert got == {0: (30, None, None), 1: (30, None, None), 2: (30, "Forge", None), 3: (7, "Forge", None), 4: (14, "Lark", "lark models"), 5: (90, None, None), 6: (30, None, "cheap gpu"), 7: (30, "Forge", "what of forge"), 8: (365, None, None), 9: (30, None, "forgery")}


def test_offers_for_queries(spark):
    from datetime import datetime, timedelta

    from tidewire.operators.feed import at

    now = datetime(2024, 5, 1)
    rows = [(1, "Forge is free", "", True, "Forge", 1), (2, "Forge has a free tier", "", True, "Forge", 20), (3, "Gateway is free", "", True, "Gateway", 2), (4, "Lark is free on all plans", "", False, None, 3), (5, "Lark came out", "", False, None, 4), (6, "rain in spring", "", False, None, 1), (7, "spring rain again", "", False, None, 5)]
    art = spark.createDataFrame([(i, t, c, o, f, now - timedelta(days=d), 50.0) for i, t, c, o, f, d in rows], "id long, title string, content string, is_free_offer boolean, free_tool string, published_at timestamp_ntz, final_score double")
    asked = spark.createDataFrame(list(enumerate(["forge", "forge 7", "", "lark", "rain", "3d", "zzzz qqqq"])), "query_id long, query string")
    aliases = spark.createDataFrame([], "group_id long, word string")
    got = {}
    for r in offers.offers_for(asked, art, vocabulary_of(spark), aliases, as_of=at(now), columns=("title", "content")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.basis))
    assert got == {0: [(1, "listed"), (2, "listed")], 1: [(1, "listed")], 2: [(1, "listed"), (3, "listed"), (2, "listed")], 3: [(4, "detected")], 4: [(6, "unverified"), (7, "unverified")], 5: [(1, "listed"), (3, "listed")]}


def test_pairs_of_words_find_only_texts_that_have_them_side_by_side(spark):
    texts = ["alpha beta", "alpha x beta", "beta alpha", "alpha\nbetav2 and", "Alpha-beta", "alphav1 beta"]
    rows, words = spark.createDataFrame(list(enumerate(texts)), "id long, text string"), spark.createDataFrame([("alpha beta",)], "term string")
    _, maybe = vocabulary._candidates(rows, words, "id", "text", "term", True)
    assert {r.id for r in maybe.collect()} == {0, 3, 4}
    terms = ["alpha beta", "beta alpha", "alpha-beta", "x beta", "\t\n", "beta\nalpha"]
    assert hits_of(spark, [*texts, "a \t\n b"], terms) == by_hand([*texts, "a \t\n b"], [t for t in terms if t.strip()]) | {(6, "\t\n"): [2]}


def test_offers_in_long_texts(spark):
    """Distances by order of place: thousands of tools and signals in a text are not compared with each other."""
    import time

    frame = spark.createDataFrame([(1, "A day in spring", "forge x is free y " * 8000), (2, "A day in spring", "is free" + " x" * 50 + " forge and lark" * 8000)], "id long, title string, content string")
    began = time.monotonic()
    got = {r.id: (r.tool, r.gap, r.signals) for r in offers.detect_offers(frame, vocabulary_of(spark), body_limit=10**6).collect()}
    assert time.monotonic() - began < 60
    assert got == {1: ("Forge", 3, ["is free"]), 2: ("Forge", 101, ["is free"])}


def test_a_search_for_offers_is_done_once(spark, tmp_path, monkeypatch):
    """Queries of one text are one search, and what it found isn't searched for again when the answers are read."""
    made = [(i, f"Lark {i}", "the lark has a free tier", None, None, False, None, float(i), datetime(2024, 1, 1)) for i in range(6)]
    spark.createDataFrame(made, "id long, title string, content string, title_zh string, summary_zh string, is_free_offer boolean, free_tool string, final_score double, published_at timestamp_ntz").write.parquet(f"{tmp_path}/articles")
    words = spark.createDataFrame([(term, role, name, rank, kind, strong, i) for i, (role, term, name, rank, kind, strong) in enumerate(VOCABULARY)], offers.ROLES)
    queries = spark.createDataFrame([(q, "lark" if q < 40 else None if q == 40 else "tier") for q in range(42)], "query_id long, query string")
    aliases = spark.createDataFrame([], "group_id long, word string")
    asked, pools = [], search.pools
    monkeypatch.setattr(search, "pools", lambda q, a: asked.append(q.count()) or pools(q, a))
    got = offers.offers_for(queries, spark.read.parquet(f"{tmp_path}/articles"), words, aliases, as_of=F.lit(datetime(2024, 1, 2)), limit=2)
    assert asked == [2]
    assert not [f for f in got.inputFiles() if f"{tmp_path}/articles" in f]
    want = {(q, rank, id_, "detected") for q in range(42) if q != 40 for rank, id_ in ((1, 5), (2, 4))}
    assert {(r.query_id, r.rank, r.id, r.basis) for r in got.collect()} == want


def test_offers_at_the_end_of_long_texts(spark):
    """Bodies are read to their end, unless the caller limits them."""
    frame = spark.createDataFrame([(1, "A day in spring", "x " * 5000 + "the Forge has a free tier")], "id long, title string, content string")
    assert [(r.tool, r.signals) for r in offers.detect_offers(frame, vocabulary_of(spark)).collect()] == [("Forge", ["free tier"])]
    assert offers.detect_offers(frame, vocabulary_of(spark), body_limit=2500).count() == 0
