"""What readers see of an article, and what their messages want."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from tidewire.functions import present
from tidewire.operators import classify


def test_display(spark):
    columns = "id long, title string, title_zh string, summary string, summary_zh string, content string, points array<string>, points_zh array<string>"
    long = "an English sentence of some length"
    rows = [
        (1, "Mail me@x.example now", None, "Read Full Topic said &amp;amp; done", None, "", [long], None),
        (2, "An agent of note", "一位 Makler 来了", long, "中文的摘要", "", [long, "中文要点"], []),
        (3, "Plain title of words", "", None, "https://example.org/x", "", None, ["中文一", " ", "Makler"]),
        (4, "短标题", "短标题", "短", "短", "", [], None),
    ]
    shown = present.display(spark.createDataFrame(rows, columns), senses=[(r"\bagent\b", "Makler", "Agent")])
    got = {r.id: r for r in shown.collect()}
    assert got[1].display_title == "Mail ***@x.example now" and got[1].display_summary == "said & done" and got[1].display_line == got[1].display_title
    assert got[2].display_title == "一位 Agent 来了" and got[2].display_line == "中文的摘要" and got[2].display_points == ["中文要点"]
    assert got[3].translated_summary is None and got[3].display_line == "Plain title of words" and got[3].display_points == ["中文一", "Makler"]
    assert {i: r.points_in_english for i, r in got.items()} == {1: True, 2: False, 3: False, 4: False}
    assert {i: r.wants_translation for i, r in got.items()} == {1: True, 2: True, 3: True, 4: False} and got[4].display_points == []
    one = spark.createDataFrame([(1, None, datetime(2024, 5, 1, 23, 30))], "id long, title string, at timestamp_ntz")
    r = one.select(present.as_json(one, ["id", "title", "at"]).alias("doc"), present.local_time(F.col("at"), "Asia/Tokyo").alias("t"), present.local_time(F.lit(None).cast("timestamp_ntz"), "UTC").alias("none")).first()
    assert json.loads(r.doc) == {"id": 1, "title": None, "at": "2024-05-01T23:30"} and (r.t, r.none) == ("05-02 08:30", "")


def test_intents(spark):
    said = {
        "summary of no. 3 please": ("summarize", 14, 3, ""),
        "第二十一条 in detail": ("summarize", 14, 21, ""),
        "mute me": ("settings", 14, None, ""),
        "I follow chips": ("settings", 14, None, ""),
        "what chips should I follow today": ("search", 1, None, "what chips should follow today"),
        "source list": ("sources", 14, None, ""),
        "help": ("help", 14, None, ""),
        "chips this week": ("search", 7, None, "chips this week"),
        "recent chips": ("search", 3, None, "recent chips"),
        "?": ("latest", 14, None, "?"),
        "": ("latest", 14, None, ""),
        None: ("latest", 14, None, ""),
        "chips since 1999": ("search", 14, None, "chips since 1999"),
    }
    rows = spark.createDataFrame(list(enumerate(said)), "i int, text string")
    got = {r.text: (r.intent, r.days, r.place, r.query) for r in classify.rule_intent(rows).collect()}
    assert got == said
