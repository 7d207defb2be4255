"""A whole round of processing: what becomes of each article, and rounds that break off."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewire.operators import process
from tidewire.operators.feed import at

T0 = datetime(2024, 5, 1, 12)
COLUMNS = "id long, title string, content string, source_name string, tier string, heat double, published_at timestamp_ntz, event_id long"
def rules():
    return {"as_of": at(T0), "keywords": ["model", "chip"], "taxonomy": {"Models": ["model", "models"], "Hardware": ["chip", "wafer"]}, "terms": ["Lark", "Forge"], "interests": [("topic", "lark", 1.0)]}


def art(i, title, content="", tier="A", heat=0.0, hours=1, event=None, source="Daily"):
    return (i, title, content, source, tier, heat, T0 - timedelta(hours=hours) if hours is not None else None, event)


ROWS = [
    art(1, "Lark announces a new model", "It is larger than all the others before it. The second sentence follows it right here. And a third one comes after that one too."),
    art(2, "Weather for the week", "sun and rain"),
    art(3, None, "the model of something"),
    art(4, "Model without a time", hours=None),
    art(5, "new model announces a Lark", "a chip", tier="C"),
    art(6, "Chip outage at a wafer plant", "chip", tier="D", heat=10.0, hours=3),
    art(7, "Chip outage at a wafer plant", "chip", tier="D", heat=900.0, hours=3, event=70),
    art(8, "An old model is introduced", "", hours=300),
    art(9, "Forge is free for every model", ""),
    art(10, "—", "model chip"),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, COLUMNS)


def vocabulary(spark):
    from tidewire.operators import offers

    return spark.createDataFrame([("forge", "tool", "Forge", 0, "agent", None, 0), ("is free", "signal", None, None, None, True, 1)], offers.ROLES)


def test_every_article_has_an_outcome(spark):
    out = process.process(frame(spark).withColumn("attempts", F.when(F.col("id") == 4, 2)), vocabulary=vocabulary(spark), **rules())
    got = {r.id: r for r in out.collect()}
    assert {i: r.outcome for i, r in got.items()} == {1: "breaking", 2: "filtered", 3: "retry", 4: "abandoned", 5: "watch", 6: "watch", 7: "breaking", 8: "processed", 9: "processed", 10: "processed"}
    assert {i: r.attempts for i, r in got.items()} == {1: 1, 2: 0, 3: 1, 4: 3, 5: 1, 6: 1, 7: 1, 8: 1, 9: 1, 10: 1}
    assert got[1].category == "Models" and got[6].category == "Hardware" and got[2].category == "Other" and got[2].final_score == 0.0 and got[2].error == "no keyword"
    assert got[9].offer_tool == "Forge" and "Forge" in got[9].tags and got[1].offer_tool is None and got[1].tags == ["Lark"]
    assert got[1].summary.startswith("It is larger") and got[1].points == ["The second sentence follows it right here.", "And a third one comes after that one too."]
    # Titles of the same words are one story; one that is known goes on.
    assert got[1].story == got[5].story == 1 and got[6].story == got[7].story == 70 and got[10].story == 10
    assert got[8].novelty < got[1].novelty == 95.0 and got[5].final_score < got[1].final_score


def test_rounds_break_off_and_go_on(spark, tmp_path):
    def state(target):
        return {r.id: tuple(r) for r in process.current(spark, target, 9).collect()}

    smooth, broken = f"file://{tmp_path}/smooth", f"file://{tmp_path}/broken"
    more = ROWS + [art(11, "A Lark announces new model", "later"), art(12, "Chip prices", "chip")]
    mended = [art(3, "Model found its title") if r[0] == 3 else r for r in more]
    for target in (smooth, broken):
        process.run_round(frame(spark), target, 0, **rules())
        if target == broken:
            # A job that dies while it writes, and the same round again, twice.
            boom = F.when(F.col("id") == 12, F.raise_error(F.lit("lost"))).otherwise(F.lit(False))
            with pytest.raises(Exception, match="lost"):
                process.run_round(frame(spark, more), target, 1, broken=boom, **rules())
            assert not process.exists(spark, f"{target}/round=00000001/_SUCCESS")
            process.run_round(frame(spark, more), target, 1, **rules())
        process.run_round(frame(spark, more), target, 1, **rules())
        process.run_round(frame(spark, mended), target, 2, **rules())
    got = state(smooth)
    assert got == state(broken)
    last = {i: r[1:3] for i, r in got.items()}
    assert last[3] == ("breaking", 3) or last[3] == ("processed", 3)
    assert last[4] == ("abandoned", 3) and last[1] == ("breaking", 1) and last[2] == ("filtered", 0)
    rows = {r.id: r for r in process.current(spark, smooth, 9).collect()}
    assert rows[11].story == 1 and rows[11].number == 1 and rows[1].number == 0
    assert process.run_round(frame(spark, mended), smooth, 3, **rules()).count() == 0


def test_a_round_of_nothing(spark, tmp_path):
    assert process.run_round(frame(spark, []), f"file://{tmp_path}/none", 0, **rules()).count() == 0
