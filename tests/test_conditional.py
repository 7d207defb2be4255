"""A cache of validators replayed answer by answer, and lists dealt into messages, against loops."""

import random
from datetime import datetime, timedelta

import pytest

from tidewire.operators import messages
from tidewire.sources import conditional

T0 = datetime(2024, 1, 1)
ANSWERS = "url string, at timestamp_ntz, seq long, status int, etag string, body string"


def loop(rows, max_body=50):
    cache, versions, out = {}, {}, {}
    for url, at, seq, status, etag, body in sorted((r for r in rows if r[0] and r[1]), key=lambda r: (r[0], r[1], r[2])):
        old = cache.get(url)
        used = body if status == 200 else old[1] if status == 304 and old else None
        if status == 200 and etag and body and len(body) <= max_body:
            kind = "stored"
            versions[url] = versions.get(url, 0) + (old is None or old[:2] != (etag, body))
            cache[url] = (etag, body, at)
        else:
            kind = {200: "fresh", 304: "replayed" if old else "empty", 404: "missing"}.get(status, "error")
        out[url, seq] = (old[0] if old else None, kind, used, status != 304, versions.get(url, 0), cache[url][2] if url in cache else None, at + timedelta(hours=6) if status == 404 else None)
    return out, cache


@pytest.mark.parametrize("hours", [1, 24, 10_000])
def test_replay_equals_a_loop(spark, hours):
    rnd = random.Random(hours)
    rows = [(rnd.choice(["hot", "hot", "hot", "a", "b", "c"]), T0 + timedelta(minutes=rnd.randrange(4000)), k, rnd.choice([200, 200, 304, 304, 404, 500, None]), rnd.choice(["e1", "e2", "", None]), rnd.choice(["x", "y" * 60, "z" * 50, "", None])) for k in range(500)]
    rows += [(None, T0, 1000, 200, "e", "b"), ("a", None, 1001, 200, "e", "b")]
    replayed = conditional.replay(spark.createDataFrame(rows, ANSWERS), max_body=50, slice_hours=hours)
    want, cache = loop(rows)
    got = {(r.url, r.seq): (r.sent_etag, r.outcome, r.used, r.metered, r.version, r.stored_at, r.ask_again) for r in replayed.collect()}
    assert got == want
    after = {r.url: (r.etag, r.body, r.stored_at) for r in conditional.cache_after(replayed).collect()}
    assert after == cache
    assert conditional.replay(spark.createDataFrame([], ANSWERS)).count() == 0


def deal_by_hand(chunks, limit, header, footer):
    """Blocks joined while they fit, long ones cut."""
    size = lambda s: len(s.encode("utf-16-le")) // 2
    front, back = f"{header}\n\n" if header else "", f"\n\n{footer}" if footer else ""
    room, out, current = limit - size(front) - size(back), [], ""
    for chunk in chunks:
        both = f"{current}\n\n{chunk}" if current else chunk
        if size(both) <= room:
            current = both
            continue
        if current:
            out.append(current)
        while size(chunk) > room:
            n = len(chunk)
            while size(chunk[:n]) > room:
                n -= 1
            cut = chunk.rfind("\n", 0, n)
            cut = cut if cut > 20 else n
            out.append(chunk[:cut])
            chunk = chunk[cut:].lstrip("\n")
        current = chunk
    return [front + m + back for m in ([*out, current] if current else out)]


def test_messages_equal_a_loop(spark):
    rnd = random.Random(2)
    word = lambda: rnd.choice(["plain", "😀😀😀", "漢字", "a\nb", "\n", "x" * 30])
    lists = {k: ["".join(word() for _ in range(rnd.choice([1, 2, 9, 40]))) for _ in range(rnd.randrange(12))] for k in [*range(30), None]}
    rows = [(k, i, t) for k, ts in lists.items() for i, t in enumerate(ts)] + [(3, 100, None), (3, 101, "")]
    frame = spark.createDataFrame(rows, "list_id long, place int, text string").repartition(7)
    for header, footer in (("", ""), ("Head 😀", "foot")):
        got = {}
        for r in messages.split_messages(frame, limit=100, header=header, footer=footer, least=20).orderBy("list_id", "message").collect():
            got.setdefault(r.list_id, []).append(r.text)
        want = {k: deal_by_hand([t for t in ts if t], 100, header, footer) for k, ts in lists.items()}
        assert got == {k: m for k, m in want.items() if m}
        assert all(len(m.encode("utf-16-le")) // 2 <= 100 for ms in got.values() for m in ms)
    with pytest.raises(ValueError):
        messages.split_messages(frame, limit=10, header="much too long")
    assert messages.split_messages(frame.limit(0)).count() == 0
