"""Repairs that change rows once."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidewire.operators import reconcile
from tidewire.operators.feed import at

T0 = datetime(2024, 6, 1)


def row(i, title="Plain title", **other):
    base = {"id": i, "title": title, "content": "", "source_name": "Daily", "stars": None, "event_id": None, "filtered_out": False, "is_processed": True, "is_archived": False, "is_sent": True}
    base |= {"published_at": T0 - timedelta(hours=2), "created_at": T0 - timedelta(hours=1), "processed_at": T0, "attempts": 1, "why_it_matters": None, "source_quality": 95.0, "final_score": 60.0, "heat": 0.0, "breaking_reason": None, "deferred": None, "lost_reason": None}
    return tuple((base | other).values())


ROWS = [
    row(1, "A chip story", filtered_out=True, attempts=3),
    row(2, "A chip story of old", filtered_out=True, published_at=T0 - timedelta(days=9)),
    row(3, "Rain", filtered_out=True),
    row(4, "A chip story put away", filtered_out=True, is_archived=True),
    row(5, "chip toy", source_name="GitHub Trending", stars=0),
    row(6, "chip toy dropped", source_name="GitHub Trending", stars=0, filtered_out=True),
    row(7, "chip tool", source_name="GitHub Trending", stars=8000),
    row(8, "chip thing", source_name="GitHub Trending"),
    row(9, "One side", event_id=5, source_name="Daily"),
    row(10, "Other side", event_id=5, source_name="Weekly", why_it_matters="because"),
    row(11, "Third side", event_id=5, source_name="Weekly", filtered_out=True),
    row(12, "Alone", event_id=6),
    row(22, "Much discussed", heat=130.0),
    row(13, "No time", processed_at=None),
    row(14, "No time either", processed_at=None, is_processed=False),
    row(15, "Firm announces chip", is_sent=False, breaking_reason="event"),
    row(16, "Quiet chip", is_sent=False, breaking_reason="event"),
    row(17, "Quiet chip booked", is_sent=False, breaking_reason="event", deferred=True),
    row(18, "Quiet chip known", is_sent=False, breaking_reason="event", lost_reason="long ago"),
    row(19, "chip regated into a story", event_id=7, filtered_out=True, source_name="Monthly"),
    row(20, "Its other side", event_id=7, source_name="Daily"),
    row(21, None, filtered_out=None, is_processed=None),
]
NOTES = {1: ["regate"], 5: ["spam"], 9: ["matters"], 13: ["processed"], 16: ["lost"], 22: ["matters"], 19: ["regate"], 20: ["matters"]}


def run(spark, rows, readers=((111, "ghost"), (7, "someone")), ledger=((7,),)):
    articles = rows if not isinstance(rows, list) else spark.createDataFrame(rows, reconcile.ARTICLE)
    people, book = spark.createDataFrame(list(readers), "user_id long, name string"), spark.createDataFrame(list(ledger), "user_id long")
    return reconcile.reconcile(articles, people, book, as_of=at(T0), keywords=["chip"], phantom=111)


def test_repairs_change_what_they_should(spark):
    articles, readers, counts = run(spark, ROWS)
    got = {r.id: r for r in articles.collect()}
    assert {i: r.notes for i, r in got.items() if r.notes} == NOTES and len(got) == len(ROWS)
    names = [c.strip().split()[0] for c in reconcile.ARTICLE.split(",")]
    old = {r[0]: dict(zip(names, r)) for r in ROWS}
    changed = {i: {c: r[c] for c in names if r[c] != old[i][c]} for i, r in got.items()}
    assert {i: c for i, c in changed.items() if c} == {
        1: {"filtered_out": False, "is_processed": False, "processed_at": None, "attempts": 0},
        5: {"filtered_out": True},
        9: {"why_it_matters": "also in Weekly"},
        13: {"processed_at": T0 - timedelta(hours=1)},
        22: {"why_it_matters": "discussed, heat 130"},
        16: {"lost_reason": "held back, and now: no event"},
        19: {"filtered_out": False, "is_processed": False, "processed_at": None, "attempts": 0},
        20: {"why_it_matters": "also in Monthly"},
    }
    assert {r.step: r.n for r in counts.collect()} == {"regate": 2, "spam": 1, "matters": 3, "processed": 1, "ghost": 1, "lost": 1}
    assert [r.user_id for r in readers.collect()] == [7]
    assert {r.user_id for r in run(spark, ROWS[:1], ledger=((111,),))[1].collect()} == {7, 111}


def test_repairs_done_again_change_nothing(spark):
    once, readers, _ = run(spark, ROWS)
    again, left, counts = run(spark, once.drop("notes"), readers=[tuple(r) for r in readers.collect()])
    assert sorted(map(tuple, again.drop("notes").collect()), key=repr) == sorted(map(tuple, once.drop("notes").collect()), key=repr)
    assert again.filter(F.size("notes") > 0).count() == 0 and {r.n for r in counts.collect()} == {0} and left.count() == 1
    assert all(r.n == (r.step == "ghost") for r in run(spark, [])[2].collect())
