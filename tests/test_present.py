"""What readers see, on small texts."""

import pytest
from pyspark.sql import functions as F

from tidewire.functions import present, text


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column).first()[0]


@pytest.mark.parametrize("said, want", [("第3条", 3), ("第三条", 3), ("二十一", 21), ("十", 10), ("十二", 12), ("九十", 90), ("第 42 个", 42), ("none", None), ("0", None)])
def test_ordinals(spark, said, want):
    assert one(spark, present.ordinal(F.col("t")), t=said) == want


def test_repeats_and_boilerplate(spark):
    assert one(spark, present.collapse_repeats(F.col("t")), t="a b a b a b") == "a b"
    assert one(spark, present.strip_boilerplate(F.col("t")), t="News. Read full topic 3 posts - 2 participants [link]") == "News."
    assert one(spark, present.demote_markdown(F.col("t")), t="# Head\n- **bold** [x](http://y)") == "Head\nbold x"


def test_titles_by_template(spark):
    assert one(spark, present.localize_title(F.col("t")), t="v1.2 released in a/b") == "a/b: v1.2"
    assert one(spark, present.localize_title(F.col("t")), t="a/b (1,200 stars)") == "a/b ★1,200"
    assert one(spark, present.localize_title(F.col("t")), t="Plain") == "Plain"


def test_summary_skips_the_title(spark):
    body = "The title of the story comes first here. The second sentence is long enough to keep. Short one. A third sentence that is also long enough."
    got = one(spark, present.fallback_summary(F.col("a"), F.col("b")), a="The title of the story comes first here.", b=body)
    assert got.summary == "The second sentence is long enough to keep."
    assert got.points == ["A third sentence that is also long enough."]
    assert one(spark, present.fallback_summary(F.col("a"), F.col("b")), a="Only a title", b="Tiny.").summary == "Only a title"


def test_tags_merge_in_order(spark):
    got = one(spark, present.merge_tags(F.array(F.lit("A"), F.lit("b")), F.array(F.lit("B"), F.lit(" "), F.lit("c")), limit=3))
    assert got == ["A", "b", "c"]


def test_shorten_and_clip(spark):
    assert one(spark, text.shorten(F.col("t"), 20), t="short  text") == "short text"
    cut = one(spark, text.shorten(F.col("t"), 20), t="One clause is here, then it goes on and on")
    assert len(cut) <= 20 and cut.endswith("…")
    assert one(spark, present.clip_lines(F.col("t"), 8), t="abc\ndefgh\nxyz") == "abc…"


@pytest.mark.parametrize("minute, slot", [(0, 480), (480, 720), (1300, 480)])
def test_next_slot(spark, minute, slot):
    assert one(spark, present.next_slot(F.col("m"), [720, 480]), m=minute) == slot


def test_languages(spark):
    for t, want in (("一二三四五", "zh"), ("かなかなか", "ja"), ("안녕하세요", "ko"), ("plain words", "en"), ("", "en")):
        assert one(spark, text.detect_language(F.col("t")), t=t) == want
