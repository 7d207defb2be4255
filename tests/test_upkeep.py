"""Repairs of columns, readers and their audits, and the health report, on fixtures."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewire.operators import upkeep
from tidewire.operators.feed import at

T0 = datetime(2024, 6, 1, 12)


def ids(df):
    return [r[0] for r in df.collect()]


def test_event_trigger(spark):
    rows = [(1, "Firm Announces a thing", "Daily"), (2, "v1.2 announces", "Daily"), (3, "nothing", "r/stuff on Reddit"), (4, None, None), (5, "now LIVE: it announces", "x")]
    got = upkeep.event_trigger(spark.createDataFrame(rows, "id long, title string, source_name string"), [r"announc\w+", r"now (?:live|open)"], exclude=[r"^v?\d"], blocked=["reddit"])
    assert {r.id: (r.trigger, r.blocked_source) for r in got.collect()} == {1: ("Announces", False), 2: (None, False), 3: (None, True), 4: (None, False), 5: ("now LIVE", False)}
    assert upkeep.event_trigger(spark.createDataFrame(rows, "id long, title string, source_name string"), []).filter("trigger IS NOT NULL").count() == 0


def test_summaries_are_cut_anew(spark):
    first = "The first sentence of this text is long enough to be cut by a limit of a hundred and sixty characters, which it passes by some words at its very end, as was meant."
    columns = "id long, title string, content string, summary string, summary_zh string, pipeline string, is_processed boolean, published_at timestamp_ntz"
    row = lambda i, summary, **o: (i, "Title", o.get("content", first + " And a second one follows it."), summary, "中文", o.get("pipeline", "rule"), o.get("done", True), T0 - timedelta(hours=o.get("hours", 2)))
    rows = [row(1, first[:160]), row(2, first[:120] + "…"), row(3, first[:60]), row(4, first[:160], pipeline="ai"), row(5, first[:160], hours=90), row(6, first[:160], done=False), row(7, first[:160], content=""), row(8, first[:158] + " &…")]
    got = {r.id: (r.summary, r.summary_zh) for r in upkeep.recut_summaries(spark.createDataFrame(rows, columns), as_of=at(T0)).collect()}
    assert set(got) == {1, 8} and all(s.endswith("…") and "&" not in s and zh is None for s, zh in got.values())


def test_stubs_and_pages(spark):
    columns = "id long, url string, content string, summary_zh string, enriched boolean, translation_reset boolean, final_score double, is_processed boolean, is_archived boolean, published_at timestamp_ntz"
    rows = [(i, f"u{i}", "x" * n, "zh", tried, None, float(i), True, False, T0 - timedelta(hours=i)) for i, n, tried in ((1, 10, None), (2, 700, None), (3, 10, False), (4, 10, None), (5, 10, True), (6, 10, None), (50, 10, None))]
    art = spark.createDataFrame(rows, columns)
    assert ids(upkeep.requeue_stubs(art, as_of=at(T0), limit=2)) == [6, 4]
    assert ids(upkeep.requeue_stubs(art, as_of=at(T0), limit=1)) == [6]
    bodies = spark.createDataFrame([("u1", "y" * 900), ("u1", "z" * 30), ("u2", "y" * 900), ("u4", "short"), ("u9", "y" * 99)], "url string, body string")
    after = {r.id: (len(r.content), r.summary_zh, r.enriched) for r in upkeep.enrich(art, bodies).collect()}
    assert after == {1: (900, None, True), 2: (700, "zh", None), 3: (10, "zh", False), 4: (10, "zh", False), 5: (10, "zh", False), 6: (10, "zh", False), 50: (10, "zh", False)}
    few = {r.id: r.enriched for r in upkeep.enrich(art, bodies, budget=2).collect()}
    assert few == {1: None, 2: None, 3: False, 4: None, 5: True, 6: False, 50: False}
    later = spark.createDataFrame([(1, "u", "x" * 700, "zh", True, None, 1.0, True, False, T0), (2, "u", "x" * 700, "zh", True, True, 1.0, True, False, T0), (3, "u", "x" * 700, None, True, None, 1.0, True, False, T0), (4, "u", "x", "zh", True, None, 1.0, True, False, T0), (5, "u", "x" * 700, "zh", False, None, 1.0, True, False, T0), (6, "u", "x" * 800, "zh", True, False, 1.0, True, False, T0)], columns)
    assert ids(upkeep.stale_translations(later)) == [6, 1]


def test_lists_and_quotas(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (1, "d")], "user_id long, what string")
    some = spark.createDataFrame([(1, 2), (1, 5), (7, 1)], "user_id long, place int")
    assert sorted(r.what for r in upkeep.allowed(rows, some).collect()) == ["a", "d"] and upkeep.allowed(rows, some.limit(0)).count() == 0
    assert ids(upkeep.reader_ids(some, rows.filter("user_id IS NOT NULL"))) == [7, 1]
    assert ids(upkeep.reader_ids(some.limit(0), rows.filter("user_id IS NOT NULL"))) == [1, 2]
    once = upkeep.warn_once(spark.createDataFrame([("k", 2), ("k", 1), (None, 3), (None, 4)], "key string, at int"), key=("key",), order=("at",))
    assert sorted(map(tuple, once.collect()), key=repr) == [("k", 1), (None, 3)]
    readers = spark.createDataFrame([(1, "Asia/Tokyo"), (2, None), (3, "UTC")], "user_id long, zone string")
    book = spark.createDataFrame([(1, "b", T0 - timedelta(hours=20)), (1, "b", T0 - timedelta(hours=22)), (2, "b", T0 - timedelta(hours=11)), (2, "x", T0), (3, "b", T0 - timedelta(hours=13))], "user_id long, kind string, created_at timestamp_ntz")
    assert {r.user_id: (r.used, r.left) for r in upkeep.quota(readers, book, now=at(T0), kind="b", per_day=1).collect()} == {1: (1, 0), 2: (1, 0), 3: (0, 1)}


def test_delivery_audit(spark):
    cols = "user_id long, zone string, paused boolean, morning_on boolean, morning_at string"
    readers = spark.createDataFrame([(1, "UTC", True, True, "08:00"), (2, "UTC", False, False, "08:00"), (3, None, None, None, "08:00"), (4, "Asia/Tokyo", False, True, "08:00"), (5, "UTC", False, True, "08:00"), (6, "UTC", False, True, "18:00")], cols)
    book = spark.createDataFrame([(4, "morning", datetime(2024, 5, 31, 16)), (5, "morning", datetime(2024, 5, 31, 8)), (5, "morning", datetime(2024, 5, 29, 8)), (6, "morning", datetime(2024, 5, 31, 18)), (6, "evening", T0)], "user_id long, kind string, created_at timestamp_ntz")
    logs = spark.createDataFrame([(5, T0 - timedelta(minutes=k), f"line {k}") for k in range(9)], "user_id long, at timestamp_ntz, line string")
    got = {r.user_id: r for r in upkeep.delivery_audit(readers, book, logs, now=at(T0), kinds=("morning",), tail=3).collect()}
    assert {i: r.verdict for i, r in got.items()} == {1: "paused", 2: "off", 3: "never", 4: "delivered today", 5: "overdue", 6: "pending"}
    assert got[4].last_local == "06-01 01:00:00" and got[5].n == 1 and got[5].tail == ["line 2", "line 1", "line 0"] and got[6].tail == []


def test_readers_and_interests(spark):
    stored = spark.createDataFrame([(1, "Ann", "UTC", 7), (2, "Bob", None, 8)], "user_id long, name string, zone string, other int")
    changes = spark.createDataFrame([(1, None, "Asia/Tokyo", 1), (1, "Anna", None, 2), (1, None, "UTC", 0), (3, "Cleo", None, 1), (None, "x", "y", 1)], "user_id long, name string, zone string, at int")
    got = sorted(map(tuple, upkeep.upsert_readers(stored, changes, fields=("name", "zone")).collect()))
    assert got == [(1, "Anna", "Asia/Tokyo", 7), (2, "Bob", None, 8), (3, "Cleo", None, None)]
    wishes = spark.createDataFrame([(1, "Topic", " GPU ", 1.0), (1, "topic", "gpu", 3.0), (1, "tool", "Lark", None), (2, "topic", "gpu", 1.0), (2, "topic", "", 1.0)], "user_id long, kind string, value string, weight double")
    docs = {r.user_id: json.loads(r.doc) for r in upkeep.reader_views(stored, wishes).collect()}
    assert docs == {1: {"user_id": 1, "name": "Ann", "zone": "UTC", "other": 7, "interests": {"tool": ["lark"], "topic": ["gpu"]}}, 2: {"user_id": 2, "name": "Bob", "zone": None, "other": 8, "interests": {"topic": ["gpu"]}}}
    assert list(map(tuple, upkeep.interest_payload(wishes).collect())) == [("topic", "gpu", 2.0, 2), ("tool", "lark", 1.0, 1)]
    named = spark.createDataFrame([(" Heat", 1.0, 0), ("heat", 3.0, 1), ("novelty", 1.0, 2), ("none", 0.0, 3)], "name string, weight double, place int")
    assert {r.name: r.weight for r in upkeep.weights(named).collect()} == {"heat": 0.75, "novelty": 0.25}


def test_firehoses_and_backoff(spark):
    items = spark.createDataFrame([("hose", "a model here", None), ("hose", "rain", "no"), ("calm", "rain", None), (None, "rain", None), ("new", None, None)], "source_name string, title string, content string")
    sources = spark.createDataFrame([("hose", True), ("calm", False)], "name string, firehose boolean")
    assert upkeep.wants_keyword(items, sources, ["model"]).count() == 4
    waits = spark.createDataFrame([(n,) for n in (None, 0, 1, 2, 5, 8, 400)], "n int").select(upkeep.backoff(F.col("n")))
    assert ids(waits) == [0, 0, 30, 60, 480, 3600, 3600]


@pytest.mark.parametrize("something", [True, False])
def test_health(spark, something):
    art = spark.createDataFrame([(1, False, False, T0 - timedelta(hours=7)), (2, False, True, T0 - timedelta(hours=90)), (3, True, False, T0), (4, None, None, T0 - timedelta(minutes=6))], "id long, is_processed boolean, is_archived boolean, created_at timestamp_ntz")
    src = spark.createDataFrame([("a", True, 5, "HTTP 500"), ("b", True, 2, None), ("c", False, 9, "off"), ("d", None, 0, None)], "name string, enabled boolean, error_count int, last_error string")
    disks = spark.createDataFrame([(T0 - timedelta(hours=30), 9000), (T0 - timedelta(hours=20), 4000), (T0 - timedelta(hours=1), 900), (T0 + timedelta(hours=1), 1)], "at timestamp_ntz, free_mb int")
    hosts = spark.createDataFrame([("slow.example", T0 + timedelta(seconds=90)), ("past.example", T0)], "host string, until timestamp_ntz")
    if not something:
        art, src, disks, hosts = (d.limit(0) for d in (art, src, disks, hosts))
    got = sorted(map(tuple, upkeep.health(art, src, disks, hosts, now=at(T0)).collect()))
    if something:
        assert got == [("backlog", "warning", 2, "oldest waits 7.0 h"), ("blip", "info", 2, "b"), ("disk", "warning", 900, "MB free, -3100 in a day"), ("failing", "warning", 5, "a: HTTP 500"), ("parked", "info", 2, "slow.example")]
    else:
        assert [(c, level, n) for c, level, n, _ in got] == [(c, "info", 0) for c in ("backlog", "blip", "disk", "failing", "parked")]


def test_interests_of_messages(spark):
    said = [(1, "I like GPU and gpu chips, no rust; rust"), (2, "不要 芯片，模型"), (3, None), (None, "chips")]
    words = spark.createDataFrame([("gpu",), ("chip",), ("GPU chips",), ("rust",), ("芯片",), ("模型",)], "word string")
    got = {}
    for r in upkeep.rule_interests(spark.createDataFrame(said, "id long, text string"), words).orderBy("id", "place").collect():
        got.setdefault(r.id, []).append((r.type, r.value))
    assert got == {1: [("topic", "gpu chips"), ("topic", "chip"), ("topic", "gpu"), ("exclude", "rust"), ("topic", "rust")], 2: [("exclude", "芯片"), ("topic", "模型")], None: [("topic", "chip")]}


def test_hosts_that_asked_for_quiet(spark):
    from tidewire.sources import readers, state

    asks = [("https://a.example/1", T0 - timedelta(hours=1), 7200), ("https://A.example/2", T0 - timedelta(hours=2), 90000), ("https://b.example", T0 - timedelta(seconds=20), 1), ("https://c.example", T0 - timedelta(hours=7), 90000), ("nothing", T0, 900), ("https://d.example", T0, None)]
    parked = state.cooldowns(spark.createDataFrame(asks, "url string, at timestamp_ntz, seconds int"), now=at(T0))
    assert {r.host: r.seconds_left for r in parked.collect()} == {"a.example": 3600, "b.example": 10, "d.example": 30}
    urls = spark.createDataFrame([("https://a.example/x",), ("https://c.example/y",)], "url string")
    assert ids(state.may_ask(urls, parked)) == ["https://c.example/y"]
    found = spark.createDataFrame([("o/a", 50, "x"), ("o/a", 70, "y"), ("o/b", 5, "z")], "full_name string, stargazers_count int, html_url string")
    assert list(map(tuple, readers.repositories(found).collect())) == [("o/a", 70, "y")]


def test_atom_feeds(spark, tmp_path):
    from tidewire.sources import readers

    (tmp_path / "feed.xml").write_text("<feed><entry><title>A</title><link href='https://x.example/1'/><updated>2024-01-02T03:04:05Z</updated><summary>s &amp; t</summary></entry><entry><title>B</title><link href='https://x.example/2'/><updated>2024-01-03T00:00:00Z</updated></entry></feed>")
    got = sorted((r.title, r.url) for r in readers.read_atom(spark, str(tmp_path / "feed.xml")).collect())
    assert got == [("A", "https://x.example/1"), ("B", "https://x.example/2")]


def test_entities_of_a_text_are_resolved_once_each(spark):
    """A text of entities alone: the work follows their number, not its square."""
    import time

    from tidewire.functions import terms

    rows = spark.range(4).select(F.repeat(F.lit("a &amp;lt; b&nosuch; &#38;amp; "), 3000).alias("t"))
    began = time.monotonic()
    got = rows.select(terms.resolve_entities(F.col("t")).alias("t")).collect()
    assert time.monotonic() - began < 60
    assert {r.t for r in got} == {"a < b&nosuch; & " * 3000}


def test_recut_summaries_cut_each_content_once(spark):
    """The rebuilt summary is used four times, but the content is cut into sentences in one place of the plan."""
    rows = spark.createDataFrame([(1, "t", "One sentence that is long enough to stand. " * 5, "x" * 120)], "id long, title string, content string, summary string")
    rows = rows.selectExpr("*", "true AS is_processed", "timestamp_ntz'2024-01-01' AS published_at", "'rule' AS pipeline", "'z' AS summary_zh")
    found = upkeep.recut_summaries(rows, as_of=F.expr("timestamp_ntz'2024-01-02'"))
    assert [r.summary for r in found.collect()] == ["One sentence that is long enough to stand."]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("(?<=[.!?") == 1
