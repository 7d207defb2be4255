"""Operators on small hand-made tables, where SQL says too little."""

import random
from datetime import datetime, timedelta
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tidewire.functions import text, urls
from tidewire.operators import classify, feed, policy, search, similar
from tidewire.sources import readers, state

T0 = datetime(2024, 1, 1)


def art(spark, rows):
    base = dict(source_name="s", event_id=None, published_at=T0, final_score=50.0, is_archived=False, filtered_out=False, is_processed=True, is_sent=None, category=None)
    names = ["id", *base]
    kinds = "id long, source_name string, event_id long, published_at timestamp_ntz, final_score double, is_archived boolean, filtered_out boolean, is_processed boolean, is_sent boolean, category string"
    return spark.createDataFrame([tuple((base | r)[n] for n in names) for r in rows], kinds)


@pytest.mark.parametrize(
    "raw, want",
    [
        ("HTTP://WWW.Example.com//a//b/?utm_source=x&b=2&a=1#top", "https://example.com/a/b?a=1&b=2"),
        ("example.com", "https://example.com/"),
        ("//example.com/x/", "https://example.com/x"),
        ("https://example.com:8080/?ref=1", "https://example.com:8080/"),
        ("https://example.com/?flag=", "https://example.com/?flag"),
        (None, ""),
    ],
)
def test_normalize_url(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "u string").select(urls.normalize_url(F.col("u"))).first()[0] == want


def test_unknown_flags_do_not_hide(spark):
    a = art(spark, [dict(id=1), dict(id=2, is_sent=True), dict(id=3, is_archived=True), dict(id=4, published_at=T0 + timedelta(hours=1))])
    got = feed.eligible(a, since=T0, until=T0, skip_sent=True)
    assert [r.id for r in got.collect()] == [1]


def test_pages_partition_the_stories(spark):
    a = art(spark, [dict(id=i, event_id=i // 2 if i % 3 else None, final_score=float(i % 7)) for i in range(40)])
    best = feed.best_of_story(feed.eligible(a))
    n = feed.count_stories(a).first()[0]
    seen = [r.id for k in range(0, n, 6) for r in feed.page(best, limit=6, offset=k).collect()]
    assert len(seen) == len(set(seen)) == n == best.count()


def test_briefing_equals_a_loop(spark):
    rnd = random.Random(7)
    for _ in range(3):
        items = [dict(id=i, source_name=f"s{rnd.choice('aaabc')}", final_score=float(rnd.randint(0, 20))) for i in range(30)]
        order = sorted(items, key=lambda r: (-r["final_score"], r["id"]))
        taken, left, used = [], {}, {}
        for r in order:
            s = r["source_name"]
            if used.get(s, 0) < 2:
                used[s] = used.get(s, 0) + 1
                taken.append(r["id"])
            else:
                left.setdefault(s, []).append(r["id"])
        while any(left.values()):
            for s in left:
                if left[s]:
                    taken.append(left[s].pop(0))
        for top in (5, 12, 30):
            got = [r.id for r in feed.briefing(art(spark, items), top=top, per_source=2).collect()]
            assert sorted(got) == sorted(taken[:top])


def test_paced_equals_a_loop(spark):
    rnd = random.Random(3)
    rows = [(u, i, T0 + timedelta(minutes=rnd.randint(0, 6000))) for i, u in enumerate([1, 2] * 60)]
    want = set()
    for u in (1, 2):
        last = day = None
        used = 0
        for _, i, ts in sorted((r for r in rows if r[0] == u), key=lambda r: (r[2], r[1])):
            now = used if day == ts.date() else 0
            if (last is None or ts - last >= timedelta(minutes=90)) and now < 3:
                want.add((u, i))
                last, day, used = ts, ts.date(), now + 1
    df = spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp_ntz")
    got = {(r.user_id, r.event_id) for r in policy.paced(df, cooldown_minutes=90, per_day=3).collect()}
    assert got == want


@pytest.mark.parametrize("minute, quiet", [(1379, False), (1380, True), (0, True), (419, True), (420, False)])
def test_quiet_hours_pass_midnight(spark, minute, quiet):
    c = policy.in_quiet_hours(F.lit(minute), policy.clock_minutes(F.lit("23:00")), policy.clock_minutes(F.lit("07:00")))
    off = policy.in_quiet_hours(F.lit(minute), policy.clock_minutes(F.lit("9")), policy.clock_minutes(F.lit("07:00")))
    assert tuple(spark.range(1).select(c, off).first()) == (quiet, False)


TITLES = [
    "Acme unveils Falcon 3 chip for servers", "Acme unveils the Falcon 3 chip for servers", "Acme unveils Falcon 4 chip for servers",
    "Court blocks merger of two banks", "Merger of banks blocked by court ruling today", "Storm closes northern airports", "", "A", None,
]


def test_title_candidates_lose_no_pair(spark):
    df = spark.createDataFrame([(i, t, T0 + timedelta(hours=i)) for i, t in enumerate(TITLES)], "id long, title string, published_at timestamp_ntz")
    toks = {r.id: set(r.t) for r in df.select("id", text.title_tokens(F.col("title")).alias("t")).collect()}
    want = {(a, b) for a in toks for b in toks if a != b and b >= a - 72 and toks[a] and toks[b] and len(toks[a] & toks[b]) / min(len(toks[a]), len(toks[b])) >= 0.5}
    got = {(r.id_a, r.id_b) for r in similar.title_candidates(df, df).collect()}
    assert got == want


def test_similar_titles(spark):
    pairs = [(TITLES[0], TITLES[1]), (TITLES[0], TITLES[2]), (TITLES[3], TITLES[5]), ("", TITLES[0])]
    got = [(r.score, r.same) for r in similar.score_pairs(spark.createDataFrame(pairs, "title_a string, title_b string")).collect()]
    assert got[0] == (1.0, True)
    assert got[1][0] <= 0.5 and not got[1][1]
    assert not got[2][1] and got[3] == (0.0, False)
    a, b = "falcon acme", "falcon acme chip"
    assert SequenceMatcher(None, a, b).ratio() > 0


def test_leaders_in_order_of_arrival(spark):
    ids = spark.range(6)
    links = spark.createDataFrame([(1, 0, 0.9), (2, 1, 0.95), (3, 2, 0.9), (3, 0, 0.8), (5, 4, 0.9)], "id long, matched_id long, score double")
    got = {r.id: r.leader for r in similar.lead_by_arrival(links, ids).collect()}
    # 1 follows 0, so 2 finds no leader in 1 and leads; 3 prefers 2.
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4}


def test_upsert_is_idempotent(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "x"), (4, "c", "z")], "id long, url_hash string, hash string")
    once = state.insert_new(rows.limit(0), rows)
    assert sorted(r.id for r in once.collect()) == [1, 4]
    assert state.insert_new(once, rows).count() == 0


def test_merge_fills_and_raises(spark):
    old = spark.createDataFrame([("a", "", 5.0), ("b", "t", 9.0), ("c", "t", 1.0)], "url_hash string, content string, heat double")
    new = spark.createDataFrame([("a", "n", 1.0), ("b", "u", 3.0)], "url_hash string, content string, heat double")
    got = {r.url_hash: (r.content, r.heat, r.touched) for r in state.merge_sightings(old, new).collect()}
    assert got == {"a": ("n", 5.0, True), "b": ("t", 9.0, False), "c": ("t", 1.0, False)}


def test_gate_order(spark):
    rows = [(1, "reddit x", "Acme announces chip", 95.0, 90.0, 0.0, 1), (2, "wire", "Quiet day", 95.0, 90.0, 0.0, 1), (3, "wire", "Acme announces chip", 45.0, 90.0, 0.0, 1), (4, "wire", "Acme announces chip", 45.0, 90.0, 0.0, 40), (5, "wire", "Acme announces chip", 45.0, 10.0, 300.0, 1), (6, "wire", "Acme announces chip", 95.0, 90.0, 0.0, 40)]
    df = spark.createDataFrame([(*r[:6], T0 - timedelta(hours=r[6])) for r in rows], "id long, source_name string, title string, source_quality double, final_score double, heat double, published_at timestamp_ntz")
    got = [r.verdict for r in classify.breaking_gate(df, as_of=feed.at(T0)).orderBy("id").collect()]
    assert got == ["blocked source", "no event", "wait for heat", "weak source", "pass", "too old"]


def test_offers(spark):
    rows = [("Hosting now has a free tier", ""), ("Sugar free editor", ""), ("News", "The database team gives free credits for the database"), ("Free trial of nothing", "")]
    got = [r.offer for r in classify.detect_offer(spark.createDataFrame(rows, "title string, content string")).collect()]
    assert got[0].tool == "hosting" and got[0].in_title and got[1] is None and got[2].tool == "database" and got[3] is None


def test_search_needs_two_concepts(spark):
    df = spark.createDataFrame([(1, "Acme chip"), (2, "Acme agent chip"), (3, "nothing")], "id long, title string")
    found = search.search(df, "Acme chip agent", columns=("title",), concepts=[["acme"], ["agent"]])
    assert [r.id for r in found.orderBy("id").collect()] == [2]
    assert search.search(df, "?", columns=("title",)).count() == 0


def test_readers(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<rss><channel><item><title> A </title><link>https://x.org/1</link><pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate></item><item><title>No link</title></item></channel></rss>")
    got = readers.read_rss(spark, str(tmp_path / "a.xml")).collect()
    assert [(r.title, r.url, r.published_at) for r in got] == [("A", "https://x.org/1", datetime(2024, 1, 2, 3, 4, 5))]
    dates = spark.createDataFrame([("1704164645",), ("2024-01-02T03:04:05Z",), ("2024-01-02",), ("soon",)], "d string").select(readers.parse_date(F.col("d")).alias("d")).collect()
    assert [r.d for r in dates] == [datetime(2024, 1, 2, 3, 4, 5), datetime(2024, 1, 2, 3, 4, 5), datetime(2024, 1, 2), None]


def test_log_incidents(spark):
    lines = ["stray", "2024-01-01 10:00:00,000 ERROR [net] a.py:1 - host 'x' failed 3 times", "Traceback", "ValueError: no", "2024-01-01 11:00:00,000 ERROR [net] a.py:1 - host 'y' failed 4 times", "ValueError: no", "2024-01-01 12:00:00,000 INFO [net] a.py:1 - fine"]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line_no long, line string")
    got = readers.log_incidents(readers.log_records(df)).collect()
    assert len(got) == 1 and got[0].n == 2 and got[0].last == datetime(2024, 1, 1, 11)


def test_streamed_ingest_adds_nothing_twice(spark, tmp_path):
    from tidewire.streaming.ingest import event_stream, ingest

    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "b", "y")], "id long, url_hash string, hash string")
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    rows.coalesce(1).write.parquet(src)  # files of one moment have no order
    for _ in range(2):
        ingest(event_stream(spark, src), out).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 3]


def test_title_shapes_and_subcategories_count(spark):
    rows = [(1, "acme/thing does it", "x"), (2, "Zeta 8B and 0.5B", "x"), (3, "A $1.5B deal", "x"), (4, "gpu chip", "chip"), (5, None, None), (6, "v1.2 released in May", "x"), (7, "Z (1,200 stars)", "x")]
    df = spark.createDataFrame([(*r, "s") for r in rows], "id int, title string, content string, source_name string")
    words = {"Models": ["weights"], "Open Source": ["fork"], "Infrastructure": ["gpu"]}
    shapes = {classify.SIZE: ("Models", 0.6), classify.REPOSITORY: ("Open Source", 1.0)}
    out = classify.categorize(df, words, shapes=shapes, subcategories={"Infrastructure": {"Nets": ["cable"], "Chips": ["chip"]}}).collect()
    assert {r.id: r.rule_category for r in out} == {1: "Open Source", 2: "Models", 3: None, 4: "Infrastructure", 5: None, 6: "Open Source", 7: "Open Source"}
    assert {r.id: r.rule_subcategory for r in out if r.rule_subcategory} == {4: "Chips"}


def test_pages_lose_junk_blocks(spark):
    text, junk = "plain words of the article " * 4, "We use COOKIES to make this page better for all of its many readers"
    df = spark.createDataFrame([(1, "u", f"<article><p>{text}</p><p>{junk}</p><li>{text} Sign up now</li></article>")], "page_id long, url string, html string")
    assert similar.strip_pages(df).first().body == text.strip()
