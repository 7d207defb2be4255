"""Rounds, terms, readers and the search of equal titles on small fixtures, against loops."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidewire.functions import terms, text
from tidewire.operators import classify, rounds, search, similar
from tidewire.plans import catalog
from tidewire.sources import readers, state

T0 = datetime(2024, 1, 1)


def test_null_keys_equal_nothing(spark):
    rows = spark.createDataFrame([(1, None, "x"), (2, None, "y"), (3, None, None), (4, None, None), (5, "a", "x"), (6, "a", None)], "id long, url_hash string, hash string")
    once = state.insert_new(rows.limit(0), rows)
    assert sorted(r.id for r in once.collect()) == [1, 2, 3, 4]
    assert sorted(r.id for r in state.insert_new(once, rows).collect()) == [3, 4]


def test_equal_titles_have_one_lead(spark):
    rows = [(i, "Same title here" if i % 2 else f"Title number {i} apart", T0 + timedelta(hours=i)) for i in range(300)] + [(900, "", T0), (901, "", T0)]
    df = spark.createDataFrame(rows, "id long, title string, published_at timestamp_ntz")
    got = {r.id: r.lead for r in similar.distinct_titles(df, hours=72).collect()}
    epoch = int((T0 - datetime(1970, 1, 1)).total_seconds())
    slot = lambda i: (epoch + 3600 * i) // (72 * 3600)
    want = {i: min(j for j in range(300) if j % 2 and slot(j) == slot(i)) if i % 2 else i for i in range(300)} | {900: 900, 901: 901}
    assert got == want
    leads = df.join(spark.createDataFrame(list(got.items()), "id long, lead long").filter("id = lead"), "id", "left_semi")
    assert similar.title_candidates(leads, leads).filter("id_a > 299 OR id_b > 299").count() == 0


def all_pairs(art):
    """(id_a, id_b) by hand: b came before a and is at most 72 hours older, and they share half of the shorter's words."""
    rows = art.select("id", "published_at", text.title_tokens(F.col("title")).alias("tok")).collect()
    sets = [(r.id, r.published_at, set(r.tok)) for r in rows if r.tok]
    return {(i, j) for i, t, x in sets for j, u, y in sets if j != i and t - timedelta(hours=72) <= u <= t + timedelta(hours=72) and 2 * len(x & y) >= min(len(x), len(y))}


def test_title_candidates_are_all_pairs(spark, tiny):
    """The join finds every pair of a table that a comparison of all with all finds."""
    from tidewire.plans.articles import articles

    art = articles(spark, tiny).select("id", "title", "published_at")
    assert {(r.id_a, r.id_b) for r in similar.title_candidates(art, art).collect()} == all_pairs(art)
    rows = [(1, "alpha beta gamma", T0, T0), (2, "beta gamma delta", T0 + timedelta(days=9), T0 + timedelta(days=9)), (3, "gamma beta", T0, T0 + timedelta(days=10)), (4, "beta gamma", T0 - timedelta(days=4), T0 - timedelta(days=4))]
    late = spark.createDataFrame(rows, "id long, title string, published_at timestamp_ntz, created_at timestamp_ntz")
    found = {(r.id_a, r.id_b) for r in similar.title_candidates(late, late, arrived="created_at").collect()}
    assert found == {(1, 3), (3, 1), (3, 2)}  # the third came late, and meets what was published after it


def test_title_matches_equal_a_loop(spark, tiny):
    """Each lead's best earlier title within 72 hours, by the full score of all pairs."""
    from tidewire.plans.articles import articles

    art = similar.distinct_titles(articles(spark, tiny)).filter("id = lead").select("id", "title", "published_at")
    near = spark.createDataFrame([p for p in all_pairs(art) if p[1] < p[0]], "id_a long, id_b long")
    pairs = near.join(art.selectExpr("id AS id_a", "title AS title_a"), "id_a").join(art.selectExpr("id AS id_b", "title AS title_b"), "id_b")
    best = {}
    for r in similar.score_pairs(pairs).filter("score > 0").collect():
        best[r.id_a] = max(best.get(r.id_a, (-1, 0, False)), (r.score, -r.id_b, r.same))
    leads = {x.id for x in art.select("id").collect()}
    got = {r.id: (r.score, -r.matched_id, r.same) for r in catalog.queries()["jn07_title_matches"](spark, tiny).collect() if r.id in leads}
    assert got == best and got


def test_duplicates_resolve_as_in_a_loop(spark, tiny):
    from tidewire.plans.articles import articles

    art = articles(spark, tiny).select("id", "title", "content", "published_at")
    leads = {r.id: r.lead for r in similar.distinct_titles(art).collect()}
    named = art.filter(F.col("id").isin([i for i, j in leads.items() if i == j])).select("id", "title", "published_at")
    pairs = spark.createDataFrame([p for p in all_pairs(named) if p[1] < p[0]], "id_a long, id_b long")
    both = pairs.join(named.selectExpr("id AS id_a", "title AS title_a"), "id_a").join(named.selectExpr("id AS id_b", "title AS title_b"), "id_b")
    links = {}
    for r in similar.score_pairs(both).filter("same").collect():
        links.setdefault(r.id_a, []).append((r.score, -r.id_b))
    first = {}
    leader = {}
    for r in art.orderBy("id").collect():
        own = list(links.get(r.id, []))
        if r.content in first:
            own.append((2.0, -first[r.content]))
        if leads[r.id] != r.id:
            own.append((1.0, -leads[r.id]))
        first.setdefault(r.content, r.id)
        best = max((x for x in own if leader[-x[1]] == -x[1]), default=None)
        leader[r.id] = -best[1] if best else r.id
    got = {r.id: r.leader for r in catalog.queries()["stm01_stm02_resolve_duplicates"](spark, tiny).collect()}
    assert got == leader and any(i != j for i, j in leader.items())


def test_titles_are_worked_out_once(spark):
    """A title's words serve both sides of a table that is matched with itself, and every step of the search."""
    from datetime import datetime, timedelta

    seen = spark.sparkContext.accumulator(0)

    def read(parts):
        for part in parts:
            seen.add(len(part))
            yield part.assign(title=[f"alpha beta gamma {i // 2} delta{i // 2}" for i in part["id"]])

    rows = spark.createDataFrame([(i, datetime(2024, 1, 1) + timedelta(hours=i)) for i in range(60)], "id long, published_at timestamp_ntz")
    art = rows.select("id", "published_at").mapInPandas(read, "id long, published_at timestamp_ntz, title string")
    pairs = {(r.id_a, r.id_b) for r in similar.title_candidates(art, art, earlier=True).collect()}
    assert seen.value == 60
    assert pairs == {(a, b) for a, b in all_pairs(art) if b < a} and len(pairs) >= 30


def test_rounds_of_arrival_read_only_what_is_open(spark, tmp_path, monkeypatch):
    """A chain of 9 among 500: the many that are decided at once aren't read again by the rounds."""
    spark.range(500).write.parquet(f"{tmp_path}/ids")
    links = spark.createDataFrame([(i, i - 1, 0.9) for i in range(1, 10)] + [(3, 0, 0.8), (20, 19, 0.7)], "id long, matched_id long, score double")
    steps, write = [], similar.written
    monkeypatch.setattr(similar, "written", lambda df: steps.append((set(df.inputFiles()), out := write(df))) or out)
    got = {r.id: r.leader for r in similar.lead_by_arrival(links, spark.read.parquet(f"{tmp_path}/ids")).collect()}
    # 1 follows 0, so that 2's link counts no more and 2 leads; 3 links to 2 best, 4 leads, and so on.
    want = {i: i for i in range(500)} | {i: i - 1 for i in range(1, 10, 2)} | {20: 19}
    assert got == want
    decided = set(steps[1][1].inputFiles())
    assert len(steps) > 8 and sum(bool(files & decided) for files, _ in steps) == 1


def test_terms_come_back(spark):
    words = ["GPU", "Open Source", "open", "LLM"]
    rows = [("The GPU LLM and Open Source code, open to all.",), ("nothing",), (None,), (" ".join(["GPU x"] * 40),)]
    df = spark.createDataFrame(rows, "t string").withColumn("p", terms.protect_terms(F.col("t"), words))
    got = df.select("t", "p.text", "p.kept", terms.restore_terms(F.col("p.text"), F.col("p.kept")).alias("back"), terms.kept_intact(F.lit("① only"), F.col("p.kept")).alias("ok")).collect()
    assert got[0].text == "The ① and ② code, ③ to all." and got[0].kept == ["GPU LLM", "Open Source", "open"] and not got[0].ok
    assert [r.back for r in got] == [r.t or "" for r in got] and len(got[3].kept) == 35 and got[1].ok


def test_senses_entities_and_json(spark):
    df = spark.createDataFrame([("an agent of Acme", "der Makler von Spitze"), ("a broker", "der Makler")], "s string, t string")
    fixed = terms.restore_proper_nouns(F.col("s"), terms.fix_wrong_sense(F.col("s"), F.col("t"), [(r"\bagent\b", "Makler", "Agent")]), {"Spitze": "Acme"})
    assert [r[0] for r in df.select(fixed).collect()] == ["der Agent von Acme", "der Makler"]
    texts = spark.createDataFrame([("a &amp;amp; b &lt;i&gt; &#8217",), ("plain",), (None,), ("cut &am",)], "t string")
    assert [r[0] for r in texts.select(terms.resolve_entities(F.col("t"))).collect()] == ["a & b <i> ’", "plain", None, "cut "]
    odd = spark.createDataFrame([("ﬁne Ａ",), ("ok",), (None,)], "t string")
    assert [r[0] for r in odd.select(terms.compatible(F.col("t"))).collect()] == ["fine A", "ok", None]
    talk = spark.createDataFrame([('x {bad} ```json\n{"a": {"b": "}"}}\n``` {"c": 1}',), ("[1, 2] none {",), (None,)], "t string")
    assert [r[0] for r in talk.select(terms.first_json_object(F.col("t"))).collect()] == ['{"a": {"b": "}"}}', None, None]


def test_entities_are_those_of_the_standard_library(spark):
    import html
    import random
    import re

    rnd = random.Random(3)
    names = sorted(html.entities.html5)
    some = [f"&{n}" for n in rnd.sample(names, 150)] + ["&#65", "&#x41;", "&#128;", "&#8217", "&#0;", "&#x110000;", "&#xD800;", "&#13;", "&#1;", "&notit;", "&ampx", "&bogus;", "&", "&;", "&#", "&#x;", "&Gt;", "&#xFDD0;", "&#129;"]
    texts = some + ["".join(rnd.choices([*some, " ", "x", ";", "&amp;", "&amp;lt;", "é"], k=6)) for _ in range(150)] + ["", None]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(1).orderBy("i").select(terms.resolve_entities(F.col("t"))).collect()]
    want = [t if t is None or "&" not in t else re.sub(r"&#?[A-Za-z0-9]{0,8}\Z", "", html.unescape(html.unescape(t))) for t in texts]
    assert got == want


def test_json_objects_are_those_of_a_decoder(spark):
    import json
    import random

    def find(t):
        at = t.find("{")
        while at >= 0:
            try:
                found, end = json.JSONDecoder().raw_decode(t, at)
                return t[at:end]
            except ValueError:
                at = t.find("{", at + 1)
        return None

    rnd = random.Random(4)
    parts = ["{", "}", '{"a": 1}', '{"b": {"c": "}"}}', '"', "talk ", "```json\n", '{"d": [1, {"e": "\\\\\\"{"}]}', "{not}", "[1]", '{"f": "x\\ny"}', "\n"]
    texts = ["".join(rnd.choices(parts, k=rnd.randrange(7))) for _ in range(300)]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(terms.first_json_object(F.col("t"))).collect()]
    assert got == [find(t) for t in texts] and sum(g is not None for g in got) > 100


def test_search_pools_and_alias_groups():
    assert search.clean_query("Please tell me about GPU, gpu and AI!") == ["about", "GPU", "and", "AI"]
    assert search.pattern_pool(["open", "model"], {"open": ["free"]}) == {"open model": 3, "open": 2, "model": 2, "free": 2}
    pool = search.pattern_pool(["人工智能"])
    assert pool == {"人工智能": 3, "人工": 1, "工智": 1, "智能": 1}
    assert search.merge_groups([["AI", "ml"], ["GPU"], ["ML", "deep"], ["chip", "gpu"]]) == [["AI", "ml", "deep"], ["GPU", "chip"]]
    assert search.pattern_pool([]) == {} and search.clean_query("?") == []


def test_subcategories_and_shapes(spark):
    df = spark.createDataFrame([(1, "Model weights for reasoning", "model weights"), (2, "me/tool 3b", "")], "id long, title string, content string")
    out = classify.categorize(df, shapes={classify.REPOSITORY: ("Open Source", 1.0)}, subcategories={"Models": {"Weights": ["weights"], "Logic": ["reasoning"]}})
    assert [(r.rule_category, r.rule_subcategory) for r in out.orderBy("id").collect()] == [("Models", "Weights"), ("Open Source", None)]
    assert set(out.columns) == {*df.columns, "rule_category", "confidence", "rule_subcategory"}


def test_papers_and_videos(spark, tmp_path):
    papers = tmp_path / "papers.xml"
    papers.write_text(
        "<feed><entry><id>http://p/1</id><title>A large\n  model</title><summary>On model weights.</summary><author><name>Ann</name></author><author><name>Bob</name></author><published>2024-01-02T03:04:05Z</published></entry>"
        "<entry><id>http://p/2</id><title>Birds</title><summary>Of the north.</summary><author><name>Cid</name></author><published>2024-01-02T03:04:05Z</published></entry></feed>"
    )
    got = readers.read_arxiv(spark, str(papers), ["model"]).collect()
    assert [(r.title, r.url, r.authors, str(r.published_at)) for r in got] == [("A large model", "http://p/1", "Ann, Bob", "2024-01-02 03:04:05")]
    videos = tmp_path / "videos.xml"
    entry = '<entry><title>model talk {0}</title><link rel="alternate" href="http://v/{0}"/><author><name>Chan</name></author><published>2024-01-{0:02d}T00:00:00Z</published></entry>'
    videos.write_text("<feed>" + "".join(entry.format(k) for k in range(1, 15)) + '<entry><title>cats</title><link href="http://v/c"/><author><name>Other</name></author><published>2024-01-01T00:00:00Z</published></entry></feed>')
    got = readers.read_videos(spark, str(videos), ["model"]).collect()
    assert sorted(r.url for r in got) == sorted(f"http://v/{k}" for k in range(5, 15)) and all(r.title.startswith("[video] model talk") for r in got)


def test_stories_take_their_siblings(spark):
    art = spark.createDataFrame([(1, "a", None, 50.0, 90.0), (2, "b", None, 70.0, 20.0), (3, "a", 9, 10.0, 50.0), (4, "c", None, 5.0, 5.0)], "id long, source_name string, event_id long, final_score double, novelty double")
    art = art.withColumn("published_at", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    leaders = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3)], "id long, leader long")
    rows, stories = rounds.link_stories(art, leaders)
    assert {(r.id, r.event_id, r.sibling, r.final_score, r.novelty) for r in rows.collect()} == {(1, 1, False, 50.0, 90.0), (2, 1, True, 70.0, 0.0), (3, 9, False, 10.0, 50.0), (4, 9, True, 10.0, 0.0)}
    assert {(r.event_id, r.article_count, r.source_count, r.best_id) for r in stories.collect()} == {(1, 2, 2, 2), (9, 2, 2, 3)}


def test_copies_of_followers_lose_no_link(spark):
    """A title's first in its slot may follow another: its copies follow that too while it is near, and then lead for those that come after."""
    import random

    made = {10: "Harbor bridge reopens after long repair in Lisbon", 130: "Harbor bridge reopened after long repair in Lisbon, officials say"}
    made |= {h: "Harbor bridge reopens after a long repair near Lisbon today" for h in (60, 70, 90, 100)}
    rnd = random.Random(3)
    parts = (["solar array", "rail tunnel", "coral reef"], ["opens early in", "delayed again in", "opened early near"], ["Osaka", "Quito"])
    made |= {300 + 4 * i: " ".join(map(rnd.choice, parts)) + rnd.choice(["", " today", " today, officials say"]) for i in range(150)}
    rows = [(h, t, T0 + timedelta(hours=h)) for h, t in made.items()]
    art = spark.createDataFrame(rows, "id long, title string, published_at timestamp_ntz")
    linked = spark.createDataFrame([(h, h - 40, 2.0) for h in (700, 740)], "id long, matched_id long, score double")
    pairs = spark.createDataFrame([p for p in all_pairs(art) if p[1] < p[0]], "id_a long, id_b long")
    both = pairs.join(art.selectExpr("id AS id_a", "title AS title_a"), "id_a").join(art.selectExpr("id AS id_b", "title AS title_b"), "id_b")
    links = {}
    for a, b, s in [(r.id_a, r.id_b, r.score) for r in similar.score_pairs(both).filter("same").collect()] + [tuple(r) for r in linked.collect()]:
        links.setdefault(a, []).append((s, -b))
    want = {}
    for i in sorted(made):
        best = max((x for x in links.get(i, []) if want[-x[1]] == -x[1]), default=(0, -i))
        want[i] = -best[1]
    found = similar.title_links(art, linked=linked)
    got = {r.id: r.leader for r in similar.lead_by_arrival(linked.unionByName(found), art).collect()}
    assert got == want
    assert {h: want[h] for h in (10, 60, 70, 90, 100, 130)} == {10: 10, 60: 10, 70: 10, 90: 90, 100: 90, 130: 90}


def test_copies_of_a_sure_leader_are_not_compared(spark):
    """Forty copies of a title that nothing earlier is like: a link each, not one for each two of them."""
    rows = [(i, "Harbor bridge reopens after long repair" if i else "Wheat harvest delayed by rain", T0 + timedelta(hours=i)) for i in range(41)]
    art = spark.createDataFrame(rows, "id long, title string, published_at timestamp_ntz")
    found = similar.title_links(art, linked=spark.createDataFrame([], "id long"))
    assert {tuple(r) for r in found.collect()} == {(i, 1, 1.0) for i in range(2, 41)} and found.count() == 39


def test_stories_of_documents_equal_a_loop_over_all(spark, tiny):
    """The grouping of the query, with every article compared with all before it, copies too."""
    from tidewire.plans.articles import articles

    art = articles(spark, tiny).select("id", "title", "content", "published_at")
    pairs = spark.createDataFrame([p for p in all_pairs(art) if p[1] < p[0]], "id_a long, id_b long")
    both = pairs.join(art.selectExpr("id AS id_a", "title AS title_a"), "id_a").join(art.selectExpr("id AS id_b", "title AS title_b"), "id_b")
    links, first, want = {}, {}, {}
    for r in similar.score_pairs(both).filter("same").collect():
        links.setdefault(r.id_a, []).append((r.score, -r.id_b))
    for r in art.orderBy("id").collect():
        own = links.get(r.id, []) + ([(2.0, -first[r.content])] if r.content in first else [])
        first.setdefault(r.content, r.id)
        want[r.id] = -max((x for x in own if want[-x[1]] == -x[1]), default=(0, -r.id))[1]
    assert {r.id: r.leader for r in catalog.queries()["stm01_stm02_resolve_duplicates"](spark, tiny).collect()} == want
