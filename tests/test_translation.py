"""Rounds of translation against a loop over lines and routes."""

import random
from datetime import datetime, timedelta

import pytest

from tidewire.operators import translation

T0 = datetime(2024, 1, 1)
LINES, ANSWERS = "id long, field string, text string, priority int", "round int, route string, id long, field string, said string, text string"
FIELDS = ("title", "summary", "points")


def loop(lines, answers, rounds, per_round, park):
    said = {(n, route, i, f): (s, t) for n, route, i, f, s, t in answers}
    state = {(i, f): [0, None, None, None] for i, f, _, _ in lines}
    text, parked = {(i, f): t for i, f, t, _ in lines}, {}
    for n, now in enumerate(rounds):
        queue = sorted((-p, i, f) for i, f, _, p in lines if state[i, f][1] is None)[:per_round]
        for field in FIELDS:
            left, looked = [i for _, i, f in queue if f == field], False
            for route in ("first", "second"):
                if route in parked and now < parked[route]:
                    continue
                rest = []
                for k, i in enumerate(left):
                    what, got = said.get((n, route, i, field), ("error", None))
                    if what == "quota":
                        parked[route] = now + timedelta(minutes=park)
                        rest += left[k:]
                        break
                    looked |= what in ("ok", "refused")
                    if what == "ok":
                        state[i, field][1:] = [route, got, n]
                    else:
                        rest.append(i)
                left = rest
            if looked:
                for i in left:
                    own = state[i, field]
                    own[0] += 1
                    if own[0] >= (2 if field == "points" else 3):
                        own[1:] = ["source", text[i, field], n]
    return {k: tuple(v) for k, v in state.items()}, parked


@pytest.mark.parametrize("seed, quota", [(1, 0.0), (2, 0.08)])
def test_rounds_equal_a_loop(spark, seed, quota):
    rnd = random.Random(seed)
    lines = [(i, f, f"{f}{i}", rnd.randrange(3)) for i in range(14) for f in FIELDS if rnd.random() < 0.8]
    rounds = [T0 + timedelta(minutes=20 * k) for k in range(6)]
    what = lambda: "quota" if rnd.random() < quota else rnd.choice(["ok", "refused", "refused", "refused", "error"])
    answers = [(n, route, i, f, what(), f"{route}:{f}{i}") for n in range(len(rounds)) for route in ("first", "second") for i, f, _, _ in lines if rnd.random() < 0.9]
    answers = [a for a in answers if a[0] != 3]  # a round in which nobody answers
    state, routes = translation.translate_rounds(spark.createDataFrame(lines, LINES), spark.createDataFrame(answers, ANSWERS), rounds, per_round=20, park_minutes=45)
    want, parked = loop(lines, answers, rounds, 20, 45)
    assert {(r.id, r.field): (r.refusals, r.done_by, r.answer, r.round) for r in state.collect()} == want
    assert {r.route: r.parked_until for r in routes.collect()} == {"first": parked.get("first"), "second": parked.get("second")}
    assert {v[1] for v in want.values()} >= {"first", "second", "source"} and (not quota or parked)


def test_rounds_of_nothing(spark):
    state, routes = translation.translate_rounds(spark.createDataFrame([], LINES), spark.createDataFrame([], ANSWERS), [T0])
    assert state.count() == 0 and {r.parked_until for r in routes.collect()} == {None}
