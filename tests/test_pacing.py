"""Paced alerts in slices of a day against one loop over each reader's attempts."""

import random
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest

from tidewire.operators import pacing

T0 = datetime(2024, 3, 1)
COLUMNS = "user_id long, round_at timestamp_ntz, article_id long, reissue boolean, place int"


def loop(rows, cooldown, cap, zone):
    """(user, round, article, reissue, place) -> verdict."""
    day = lambda t: t.replace(tzinfo=timezone.utc).astimezone(ZoneInfo(zone)).date()
    state, out = {}, {}
    for user, at, article, again, place in sorted((r for r in rows if None not in (r[0], r[1], r[2])), key=lambda r: (r[0], r[1], bool(r[3]), r[4], r[2])):
        s = state.setdefault(user, {"last": None, "days": {}, "sent": set()})
        used = s["days"].get(day(at), 0)
        spared = s["last"] == at and not again
        if article in s["sent"]:
            verdict = "already sent"
        elif used >= cap:
            verdict = "cap"
        elif s["last"] is not None and at - s["last"] < timedelta(minutes=cooldown) and not spared:
            verdict = "cooldown"
        else:
            verdict = "sent"
            s["last"], s["days"][day(at)] = at, used + 1
            s["sent"].add(article)
        out[user, at, article, bool(again), place] = verdict
    return out


def attempts(rnd, n, users, articles, step):
    out, at = {}, T0
    for k in range(n):
        at += timedelta(minutes=rnd.choice(step))
        for place in range(rnd.randrange(1, 4)):
            row = (rnd.randrange(users), at, rnd.randrange(articles), rnd.random() < 0.4, place)
            out[row[0], row[1], row[3], row[4]] = row
    return list(out.values())


@pytest.mark.parametrize("seed, cooldown, cap, zone, step, articles", [(1, 60, 5, "UTC", [5, 30, 200], 10_000), (2, 600, 3, "Asia/Tokyo", [20, 90], 400), (3, 90, 2, "America/New_York", [10, 60], 30), (4, 0, 4, "UTC", [30, 400], 60), (5, 60, 0, "UTC", [60], 50)])
def test_slices_equal_a_loop(spark, seed, cooldown, cap, zone, step, articles):
    rows = attempts(random.Random(seed), 400, 4, articles, step) + [(None, T0, 1, False, 0), (1, None, 1, False, 0)]
    found = pacing.paced_rounds(spark.createDataFrame(rows, COLUMNS), cooldown_minutes=cooldown, per_day=cap, zone=zone).collect()
    got = {(r.user_id, r.round_at, r.article_id, r.reissue, r.place): r.verdict for r in found}
    want = loop(rows, cooldown, cap, zone)
    assert got == want and len(found) == len(want)
    assert not cap or sum(v == "sent" for v in want.values()) > 20


def test_a_hot_reader_is_many_slices(spark):
    """One reader has nearly all rows; a slice is a day of theirs, and none sees another day's rows."""
    rows = [(7, T0 + timedelta(minutes=11 * k), k % 900, k % 5 == 0, k % 3) for k in range(6000)] + [(8, T0, 1, False, 0)]
    frame = spark.createDataFrame(rows, COLUMNS)
    got = {(r.user_id, r.round_at, r.article_id, r.reissue, r.place): r.verdict for r in pacing.paced_rounds(frame, cooldown_minutes=100, per_day=6).collect()}
    assert got == loop(rows, 100, 6, "UTC")


def test_an_article_stays_booked_while_anyone_waits(spark):
    rows = [(1, T0, 10, False, 0), (1, T0, 11, False, 1), (1, T0, 12, True, 0), (2, T0, 12, True, 0), (2, T0 + timedelta(minutes=5), 13, False, 0), (1, T0 + timedelta(hours=2), 12, True, 0)]
    verdicts = pacing.paced_rounds(spark.createDataFrame(rows, COLUMNS), cooldown_minutes=60, per_day=5)
    got = {(r.round_at, r.article_id): (r.keep, r.delivered) for r in pacing.settled(verdicts).collect()}
    later = T0 + timedelta(hours=2)
    assert got == {(T0, 10): (False, True), (T0, 11): (False, True), (T0, 12): (True, True), (T0 + timedelta(minutes=5), 13): (True, False), (later, 12): (False, True)}
    assert sorted((r.user_id, r.article_id) for r in pacing.first_of_each(verdicts).collect()) == [(1, 10), (1, 11), (1, 12), (2, 12)]
    assert pacing.paced_rounds(spark.createDataFrame([], COLUMNS)).count() == 0


def test_only_readers_with_repeats_are_folded_again(spark, monkeypatch):
    from datetime import datetime, timedelta

    at = datetime(2024, 1, 1, 12)
    rows = [(user, at + timedelta(days=day), user * 100 + (0 if user == 3 else day), False, 0) for user in range(20) for day in range(3)]
    folded, sliced = [], pacing._sliced  # noqa: SLF001
    monkeypatch.setattr(pacing, "_sliced", lambda df, *a: folded.append({r.user_id for r in df.select("user_id").distinct().collect()}) or sliced(df, *a))
    attempts = spark.createDataFrame(rows, "user_id long, round_at timestamp_ntz, article_id long, reissue boolean, place long")
    got = {(r.user_id, r.round_at): r.verdict for r in pacing.paced_rounds(attempts, cooldown_minutes=60, per_day=5).collect()}
    assert got == {(r[0], r[1]): "already sent" if r[0] == 3 and r[1] > at else "sent" for r in rows}
    assert folded[0] == set(range(20)) and len(folded) > 1 and all(users == {3} for users in folded[1:])
