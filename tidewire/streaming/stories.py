"""Articles grouped into stories as they arrive: copies by address, retellings by title."""

from __future__ import annotations

import json
import math
from collections import defaultdict
from collections.abc import Callable, Sequence
from difflib import SequenceMatcher
from heapq import heappop, heappush
from itertools import count
from zlib import crc32

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessorHandle

from ..functions.text import title_key, title_tokens, versions
from ..operators.similar import content_terms
from .ordered import InOrder, Packs, fold_in_order

#: What the fold takes of an article, besides arrival and id.
_ROW = "hash string, published bigint, key string, tokens array<string>, numbers array<string>, terms array<string>"
#: Lists that addresses are dealt into. A fold reads and writes a list once, as each value is a call to the store.
_LISTS = 1024
STORY = "lane string, id bigint, leader bigint, score double, method string"


def title_score(a: tuple, b: tuple) -> float:
    """Likeness of two titles, given as (key, tokens, version numbers): as ``similar.score_pairs`` has it."""
    (key_a, tok_a, num_a), (key_b, tok_b, num_b) = a, b
    if not key_a or not key_b:
        return 0.0
    if key_a == key_b:
        return 1.0
    both = len(tok_a & tok_b)
    best = 0.6 * both / min(len(tok_a), len(tok_b)) + 0.4 * both / len(tok_a | tok_b) if tok_a and tok_b else 0.0
    for x, y in ((key_a.split(), key_b.split()), (key_a, key_b)):
        matcher = SequenceMatcher(None, x, y)
        # Two quick bounds from above come before the match itself.
        if matcher.real_quick_ratio() > best and matcher.quick_ratio() > best:
            best = max(best, matcher.ratio())
    if num_a and num_b and not num_a & num_b:
        best *= 0.5
    return math.floor(best * 10000 + 0.5) / 10000


def same_story(score: float, shared_tokens: int, shared_terms: int, *, high: float = 0.79, low: float = 0.60, terms: int = 3) -> bool:
    """A repeated title; or in the band below it, enough words in common that tell a story."""
    return (score >= high and (shared_tokens >= 3 or score >= 0.95)) or (low <= score < high and shared_terms >= terms)


class Stories(InOrder):
    """The leading titles of the last hours of a lane, by their words, and the addresses that were seen.

    Each article, in the order of arrival, joins the article whose address or
    content it repeats; else the leader of the most similar title, if that is
    the same story, the first such on a tie; else it leads. A leader takes part
    until ``hours`` after its publication, by the clock of arrivals.
    """

    row_schema = f"ms bigint, tie bigint, {_ROW}"
    state_schema = "n bigint"

    def __init__(self, hours: float = 72, least: float = 0.5):
        self.span, self.least = int(hours * 3_600_000), least

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.leaders = handle.getListState("leaders", f"id bigint, {_ROW}")
        self.seen = handle.getMapState("seen", "list int", "leaders string")

    def waits(self, handle: StatefulProcessorHandle) -> Packs:
        return Packs(handle.getMapState("waiting", "pack string", "rows string"))

    def fold(self, key: tuple, state: tuple | None, rows: Sequence[tuple], now: int, put: Callable[[Row], None]) -> tuple | None:
        if not rows:
            return state
        kept: dict[int, tuple] = {}
        index: dict[str, dict[int, None]] = defaultdict(dict)  # word -> leaders
        sets: dict[int, tuple] = {}
        place: dict[int, int] = {}  # leader -> its turn in the order of arrival
        ends: list[tuple[int, int]] = []  # (published, leader), the first to leave on top
        turns = count()
        lists: dict[int, dict[str, int]] = {}  # address -> leader, in the lists that the rows ask for
        grown: set[int] = set()

        def listed(address: str) -> int:
            n = crc32(address.encode(errors="surrogatepass")) % _LISTS
            if n not in lists:
                lists[n] = json.loads(self.seen.getValue((n,))[0]) if self.seen.containsKey((n,)) else {}
            return n

        def drop(gone: int) -> None:
            for word in sets.pop(gone)[1]:
                del index[word][gone]
                if not index[word]:
                    del index[word]
            del kept[gone], place[gone]

        def lead(row: tuple) -> None:
            if row[0] in kept:
                drop(row[0])
            kept[row[0]] = row
            place[row[0]] = next(turns)
            sets[row[0]] = (row[3], frozenset(row[4] or ()), frozenset(row[5] or ()), frozenset(row[6] or ()))
            heappush(ends, (row[2], row[0]))
            for word in sets[row[0]][1]:
                index[word][row[0]] = None

        def leave(before: int) -> None:
            while ends and ends[0][0] < before:
                published, gone = heappop(ends)
                if gone in kept and kept[gone][2] == published:
                    drop(gone)

        for row in {r[0]: r for r in map(tuple, self.leaders.get()) if r[2] >= rows[0][0] - self.span}.values():
            lead(row)
        for arrived, id_, hash_, published, *title in rows:
            leave(arrived - self.span)
            leader, score, method = id_, 0.0, "new"
            at = listed(hash_) if hash_ is not None else None
            first = lists[at].get(hash_) if at is not None else None
            if first is not None:
                leader, score, method = first, 1.0, "copy"
            else:
                own = (title[0], frozenset(title[1] or ()), frozenset(title[2] or ()), frozenset(title[3] or ()))
                shared: dict[int, int] = defaultdict(int)
                for word in own[1]:
                    for other in index.get(word, ()):
                        shared[other] += 1
                best = (0.0, 0, None)
                for other, n in shared.items():
                    if n >= self.least * min(len(own[1]), len(sets[other][1])):
                        likeness = title_score(own[:3], sets[other][:3])
                        if likeness > 0 and (best[2] is None or (likeness, -place[other]) > best[:2]):
                            best = (likeness, -place[other], other)
                score = best[0]
                if best[2] is not None and same_story(score, shared[best[2]], len(own[3] & sets[best[2]][3])):
                    leader, method = best[2], "title"
                else:
                    lead((id_, hash_, published, *title))
                if at is not None:
                    lists[at][hash_] = leader
                    grown.add(at)
            put(Row(lane=key[0], id=id_, leader=leader, score=float(score), method=method))
        for n in grown:
            self.seen.updateValue((n,), (json.dumps(lists[n]),))
        left = [r for r in kept.values() if r[2] >= rows[-1][0] - self.span]
        self.leaders.put(left) if left else self.leaders.clear()
        return ((state[0] if state else 0) + len(rows),)


def stories(articles: DataFrame, *, lane: str = "lane", hours: float = 72, late: str = "0 seconds", arrived: str = "created_at") -> DataFrame:
    """(lane, id, leader, score, method) of a stream of articles (id, title, published_at, hash, a lane and an arrival time).

    Titles are compared within a lane, a column such as the language; one lane
    for all compares all. A lane is worked on in order, by one task at a time:
    its state holds the leaders of the last ``hours`` and each address, in lists
    of which a batch reads and writes those that its rows ask for, once each.
    """
    title = F.col("title")
    rows = articles.select(
        F.col(lane).alias("lane"),
        F.col(arrived).alias("arrived"),
        F.col("id"),
        "hash",
        F.unix_millis(F.col("published_at").cast("timestamp")).alias("published"),
        title_key(title).alias("key"),
        title_tokens(title).alias("tokens"),
        versions(title).alias("numbers"),
        content_terms(title_tokens(title)).alias("terms"),
    )
    return fold_in_order(rows, Stories(hours), key="lane", ts="arrived", tie="id", schema=STORY, late=late)
