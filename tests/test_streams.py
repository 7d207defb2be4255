"""Streams with state: any cut into micro-batches, and a restart between them, gives what a loop gives."""

import json
import os
import random
import uuid
from datetime import datetime, timedelta
from types import SimpleNamespace

import pytest

from difflib import SequenceMatcher

from pyspark.sql import Row
from pyspark.sql import functions as F

from tidewire.functions import text
from tidewire.operators import similar
from tidewire.plans import catalog
from tidewire.streaming.ordered import run_stream
from tidewire.streaming.remembered import ACTIONS, LastShown, last_shown
from tidewire.streaming.stories import Stories, stories

T0 = datetime(2024, 1, 1)
COLUMNS = f"user_id bigint, ts timestamp_ntz, event_id bigint, {ACTIONS}"


@pytest.fixture
def shared(tmp_path):
    """A folder for the test's own files."""
    return tmp_path


def files(spark, folder, parts, columns, start=0):
    """Each part as a file that is newer than the one before it."""
    for k, part in enumerate(parts, start):
        spark.createDataFrame(part, columns).coalesce(1).write.parquet(f"{folder}/tmp{k}")
        name = next(f for f in os.listdir(f"{folder}/tmp{k}") if f.endswith(".parquet"))
        os.makedirs(f"{folder}/in", exist_ok=True)
        os.rename(f"{folder}/tmp{k}/{name}", f"{folder}/in/{k:04d}.parquet")
        os.utime(f"{folder}/in/{k:04d}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))


def cut(rows, rnd, n):
    at = sorted(rnd.sample(range(1, len(rows)), n - 1))
    return [rows[i:j] for i, j in zip([0, *at], [*at, len(rows)])]


def stream_of(spark, folder, columns):
    return spark.readStream.schema(spark.createDataFrame([], columns).schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def actions(rnd, n=240, readers=4):
    out, at = [], T0
    for k in range(n):
        at += timedelta(minutes=rnd.choice([1, 20, 90, 200]), milliseconds=rnd.randrange(1000))
        what = rnd.choice(["list", "list", "days", "nth", "nth", "recall", "forget" if rnd.random() < 0.3 else "nth"])
        items = [10 * k + i for i in range(rnd.randrange(4))] if what == "list" else None
        out.append((rnd.randrange(readers), at, k, what, items, "news", rnd.choice([None, f"t{k}"]), rnd.choice([None, k]), k % 9, rnd.randrange(5)))
    out[-1] = (9, T0 + timedelta(days=30), n, "list", [1], "news", None, None, None, None)  # a reader who comes once, at the end
    return out


def by_hand(rows, ttl=timedelta(hours=6)):
    """The chat memory as a dictionary that looks at the clock."""
    store, out, millis = {}, [], lambda t: int((t - datetime(1970, 1, 1)).total_seconds() * 1000 + 0.5)
    for user, ts, k, what, items, _, title, total, days, place in sorted(rows, key=lambda r: (r[1], r[2])):
        for u, s in list(store.items()):
            if ts - s["at"] > ttl:
                out.append((u, millis(s["at"] + ttl), None, "expired", None, None, None, None, None))
                del store[u]
        own = store.get(user)
        if what == "list":
            store[user] = {"items": items, "title": title or (own and own["title"]), "total": total if total is not None else (own and own["total"]), "days": None, "at": ts}
        elif what == "days":
            store[user] = {**(own or {"items": [], "title": None, "total": None}), "days": days, "at": ts}
        elif what == "forget":
            store.pop(user, None)
        else:
            shown = [own["days"], own["title"], own["total"], len(own["items"])] if own else [None] * 4
            article = own["items"][place - 1] if what == "nth" and own and 1 <= place <= len(own["items"]) else None
            out.append((user, millis(ts), k, what, article, *shown))
    out += [(u, millis(s["at"] + ttl), None, "expired", None, None, None, None, None) for u, s in store.items()]
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed, n", [(1, 1), (2, 5)])
def test_memory_in_any_cut(spark, shared, seed, n):
    rnd = random.Random(seed)
    rows = actions(rnd)
    files(spark, shared, cut(rows, rnd, n) if n > 1 else [rows], COLUMNS)
    got = run_stream(spark, lambda pulse: last_shown(stream_of(spark, shared, COLUMNS).unionByName(pulse)), ts="ts", columns=COLUMNS)
    want = by_hand(rows)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert sum(r[3] == "expired" for r in want) > 5 and any(r[4] for r in want)


def test_memory_survives_a_restart_and_late_rows(spark, shared):
    """Half of the rows, a new run for the rest, and arrivals up to an hour out of order."""
    rnd = random.Random(5)
    rows = actions(rnd, 120)
    mixed = sorted(rows[:-1], key=lambda r: r[1] + timedelta(minutes=rnd.randrange(55))) + rows[-1:]
    build = lambda pulse: last_shown(stream_of(spark, shared, COLUMNS).unionByName(pulse), late="1 hour")
    name = f"memory-{uuid.uuid4().hex}"  # the shared folder may outlive a session
    files(spark, shared, cut(mixed[:60], rnd, 2), COLUMNS)
    early = run_stream(spark, build, ts="ts", columns=COLUMNS, name=name, close=False).count()
    files(spark, shared, cut(mixed[60:], rnd, 2), COLUMNS, start=2)
    got = run_stream(spark, build, ts="ts", columns=COLUMNS, name=name).collect()
    assert sorted((tuple(r) for r in got), key=repr) == by_hand(rows) and 0 < early < len(got)


def test_memory_of_an_empty_stream(spark, shared):
    files(spark, shared, [[]], COLUMNS)
    assert run_stream(spark, lambda pulse: last_shown(stream_of(spark, shared, COLUMNS).unionByName(pulse)), ts="ts", columns=COLUMNS).count() == 0


ARTICLE = "id bigint, title string, lane string, hash string, published_at timestamp_ntz, created_at timestamp_ntz"


def grouped_by_hand(spark, rows, hours=72):
    """Every article against every leader before it, one after another."""
    frame = spark.createDataFrame([(r[0], r[1]) for r in rows], "id bigint, title string")
    t = F.col("title")
    parts = {r.id: r for r in frame.select("id", text.title_key(t).alias("key"), text.title_tokens(t).alias("tokens"), text.versions(t).alias("numbers"), similar.content_terms(text.title_tokens(t)).alias("terms")).collect()}

    def score(a, b):
        if not a.key or not b.key:
            return 0.0
        if a.key == b.key:
            return 1.0
        x, y = set(a.tokens), set(b.tokens)
        best = max(SequenceMatcher(None, a.key.split(), b.key.split()).ratio(), SequenceMatcher(None, a.key, b.key).ratio(), 0.6 * len(x & y) / min(len(x), len(y)) + 0.4 * len(x & y) / len(x | y))
        conflict = a.numbers and b.numbers and not set(a.numbers) & set(b.numbers)
        return int((best * (0.5 if conflict else 1)) * 10000 + 0.5) / 10000

    leaders, seen, out = [], {}, {}
    for id_, _, lane, hash_, published, created in sorted(rows, key=lambda r: (r[5], r[0])):
        if (lane, hash_) in seen:
            out[id_] = (seen[lane, hash_], 1.0, "copy")
            continue
        own, best = parts[id_], (0.0, None)
        for other, other_lane, when in leaders:
            if other_lane == lane and when >= created - timedelta(hours=hours):
                x, y = set(own.tokens), set(parts[other].tokens)
                if x and y and len(x & y) >= 0.5 * min(len(x), len(y)) and (s := score(own, parts[other])) > best[0]:
                    best = (s, other)
        s, other = best
        terms = len(set(own.terms) & set(parts[other].terms)) if other is not None else 0
        tokens = len(set(own.tokens) & set(parts[other].tokens)) if other is not None else 0
        if other is not None and ((s >= 0.79 and (tokens >= 3 or s >= 0.95)) or (0.6 <= s < 0.79 and terms >= 3)):
            out[id_] = (other, s, "title")
        else:
            out[id_] = (id_, s, "new")
            leaders.append((id_, lane, published))
        seen[lane, hash_] = out[id_][0]
    return out


def headlines(rnd, n):
    things = ["kernel patch", "solar array", "rail bridge", "vaccine trial", "chip factory", "coral reef", "wheat harvest", "satellite 4.1", "satellite 4.2"]
    shapes = ["{} finished ahead of time in {}", "Report: {} in {} finished ahead of time", "{} delayed again in {}, officials say", "{}"]
    places = ["Lisbon", "Osaka", "Quito", "Tromso"]
    out, at = [], T0
    for k in range(n):
        at += timedelta(minutes=rnd.choice([0, 30, 400]))
        title = rnd.choice(shapes).format(rnd.choice(things).title(), rnd.choice(places))
        published = at - timedelta(hours=rnd.choice([0, 0, 1, 60, 90]))
        out.append((k, None if rnd.random() < 0.02 else title, rnd.choice(["en", "en", "de"]), f"h{rnd.randrange(n)}", published, at))
    return out


@pytest.mark.parametrize("n", [1, 6])
def test_stories_in_any_cut(spark, shared, n):
    rnd = random.Random(n)
    rows = headlines(rnd, 220)
    files(spark, shared, cut(rows, rnd, n) if n > 1 else [rows], ARTICLE)
    got = run_stream(spark, lambda pulse: stories(stream_of(spark, shared, ARTICLE).unionByName(pulse), late="1 second"), ts="created_at", columns=ARTICLE).collect()
    want = grouped_by_hand(spark, rows)
    assert {r.id: (r.leader, r.score, r.method) for r in got} == want and len(got) == len(rows)
    assert all(sum(m == method for *_, m in want.values()) > 10 for method in ("new", "copy", "title"))


def test_story_stream_of_the_documents(spark, tiny):
    got = catalog.queries()["stm01_story_stream"](spark, tiny).collect()
    docs = spark.read.parquet(f"{tiny}/documents.parquet").selectExpr("doc_id", "substr(split_part(text, '\n', 1), 1, 500) AS title", "lang", "sha1(text) AS h").collect()
    rows = [(d.doc_id, d.title, d.lang, d.h, T0 + timedelta(hours=d.doc_id) - timedelta(minutes=3000 if d.doc_id % 40 == 7 else 0), T0 + timedelta(hours=d.doc_id)) for d in docs]
    assert {r.id: (r.leader, r.score, r.method) for r in got} == grouped_by_hand(spark, rows)


class Held:
    """State of one key, as the fold of a stream sees it."""

    def __init__(self):
        self.rows, self.known = [], {}

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.rows = rows

    def clear(self):
        self.rows = []

    def containsKey(self, key):  # noqa: N802
        return key in self.known

    def getValue(self, key):  # noqa: N802
        return self.known[key]

    def updateValue(self, key, value):  # noqa: N802
        self.known[key] = value


def test_a_long_fold_meets_only_the_leaders_of_the_last_hours():
    """Rows of one batch: the words' lists hold the leaders of 72 hours, not all that ever led."""
    import time

    fold = Stories(72)
    fold.leaders, fold.seen = Held(), Held()
    hour, n = 3_600_000, 20_000
    rows = [(i * hour, i, f"h{i}", i * hour, f"the of in and {i} a{i} b{i} c{i} d{i} e{i}", ["the", "of", "in", "and", str(i), f"a{i}", f"b{i}", f"c{i}", f"d{i}", f"e{i}"], [], []) for i in range(n)]
    out, began = [], time.monotonic()
    assert fold.fold(("en",), None, rows, n * hour, out.append) == (n,)
    assert time.monotonic() - began < 30
    assert [(r.id, r.leader, r.method) for r in out] == [(i, i, "new") for i in range(n)]
    assert [r[0] for r in fold.leaders.get()] == list(range(n - 73, n))


def test_a_table_whose_files_are_in_no_order_of_time(spark, shared, tiny):
    """A table of several files, the newest times first and overlapping: no row is late, as the table is whole."""
    events = spark.read.parquet(f"{tiny}/events.parquet")
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    for k in range(4):
        events.filter(f"(day(ts) + event_id % 3) % 4 = {3 - k}").coalesce(1).write.mode("append").parquet(f"{shared}/events.parquet")
        docs.filter(f"doc_id div 20 % 4 = {3 - k}").coalesce(1).write.mode("append").parquet(f"{shared}/documents.parquet")
    for name in ("stm12_last_shown", "stm01_story_stream"):
        got, want = (sorted((tuple(r) for r in catalog.queries()[name](spark, folder).collect()), key=repr) for folder in (shared, tiny))
        assert got == want and len(got) > 100


class Store(list):
    """A list in state that counts the calls that write to it."""

    writes = 0

    def get(self):
        return iter(self)

    def appendValue(self, value):  # noqa: N802
        self.writes += 1
        self.append(value)


def test_rows_wait_in_packs():
    """A call to the store and a value in it for a thousand rows, not for each; the rest of a fold waits in packs, too."""
    n, timers, held = 5_000, [], Held()
    fold = LastShown()
    handle = SimpleNamespace(getListState=lambda *_: Store(), getValueState=lambda *_: held, registerTimer=timers.append)
    held.exists, held.update = lambda: False, held.known.update
    fold.init(handle)
    rows = [{"ms": i, "tie": i, "action": "recall", "title": 'a "b", ü\n'} for i in range(n)]
    fold.handleInputRows((1,), iter(Row(ms=r["ms"], row=json.dumps(r)) for r in reversed(rows)), None)
    assert fold.waiting.writes == 5 and timers == [0]
    told = list(fold.handleExpiredTimer((1,), SimpleNamespace(getCurrentWatermarkInMs=lambda: 2_999), None))
    assert [r.tie for r in told] == list(range(3_000)) and timers == [0, 3_000] and fold.waiting.writes == 7
    told = list(fold.handleExpiredTimer((1,), SimpleNamespace(getCurrentWatermarkInMs=lambda: n), None))
    assert [r.tie for r in told] == list(range(3_000, n)) and not list(fold.waiting)


class Counted(Held):
    """State of one key that counts the calls to it."""

    calls = 0

    def containsKey(self, key):  # noqa: N802
        self.calls += 1
        return super().containsKey(key)

    def updateValue(self, key, value):  # noqa: N802
        self.calls += 1
        super().updateValue(key, value)

    def keys(self):
        return iter(self.known)

    def clear(self):
        super().clear()
        self.known = {}


def test_addresses_are_asked_for_in_lists():
    """Twenty thousand rows of a batch call the store for each list of addresses, not for each address; the next batch knows them."""
    fold, n, hour = Stories(72), 20_000, 3_600_000
    fold.leaders, fold.seen = Held(), Counted()
    row = lambda i, h: (i * hour, i, h, i * hour, f"w{i}", [f"w{i}"], [], [])
    out = []
    fold.fold(("en",), None, [row(i, f"h{i}") for i in range(n)], n * hour, out.append)
    assert fold.seen.calls <= 4096 and all(r.method == "new" for r in out)
    more = [row(n, "h7"), row(n + 1, None), row(n + 2, "new \ud800"), row(n + 3, "new \ud800"), row(n + 4, None)]
    fold.fold(("en",), (n,), more, 2 * n * hour, out.append)
    assert [(r.id - n, r.leader, r.method) for r in out[n:]] == [(0, 7, "copy"), (1, n + 1, "new"), (2, n + 2, "new"), (3, n + 2, "copy"), (4, n + 4, "new")]


def test_rows_of_a_lane_wait_in_values_of_their_own():
    """An addition to a list in state reads all of it, so the many rows of a lane are no list; most stay texts until they are folded."""
    n, held = 5_000, Held()
    fold, maps = Stories(72), {}
    handle = SimpleNamespace(getListState=lambda name, *_: {"leaders": Held()}[name], getMapState=lambda name, *_: maps.setdefault(name, Counted()), getValueState=lambda *_: held, registerTimer=lambda _: None)
    held.exists, held.update = lambda: False, lambda _: None
    fold.init(handle)
    rows = [{"ms": i, "tie": i, "hash": f"h{i % 4_000}", "published": i, "key": f"w{i}", "tokens": [f"w{i}"]} for i in range(n)]
    fold.handleInputRows(("en",), iter(Row(ms=r["ms"], row=json.dumps(r)) for r in reversed(rows)), None)
    assert len(fold.waiting.packs.known) == 5
    told = list(fold.handleExpiredTimer(("en",), SimpleNamespace(getCurrentWatermarkInMs=lambda: 3_499), None))
    told += fold.handleExpiredTimer(("en",), SimpleNamespace(getCurrentWatermarkInMs=lambda: n), None)
    assert [(r.id, r.leader) for r in told] == [(i, i % 4_000) for i in range(n)] and not fold.waiting.packs.known
