"""What a reader was last shown, remembered for some hours: state that expires."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Row

from .ordered import InOrder, fold_in_order

#: What a stream of a reader's actions must have, besides its key and time.
ACTIONS = "action string, items array<bigint>, kind string, title string, total int, days int, place int"
ANSWERS = "user_id bigint, ms bigint, tie bigint, answer string, article_id bigint, days int, title string, total int, shown int"


class LastShown(InOrder):
    """The last list of each reader, with its name and total, and the span of days that the reader chose.

    ``list`` remembers a list; a name or total that it doesn't give is that of
    the list before it. ``days`` remembers a span beside the list. Both keep the
    memory alive for ``ttl_hours`` more; ``forget`` ends it. ``nth`` asks for the
    article at a place from 1 on, ``recall`` for the list and the span. After
    the time nothing is remembered, and a row ``expired`` says so.
    """

    row_schema = f"ms bigint, tie bigint, {ACTIONS}"
    state_schema = "items array<bigint>, kind string, title string, total int, days int, updated bigint"

    def __init__(self, ttl_hours: float = 6):
        self.ttl = int(ttl_hours * 3_600_000)

    def wakes(self, state: tuple | None) -> int | None:
        return state and state[-1] + self.ttl + 1

    def fold(self, key: tuple, state: tuple | None, rows: Sequence[tuple], now: int, put: Callable[[Row], None]) -> tuple | None:
        def tell(ms, tie, answer, article=None, own=None):
            items, _, title, total, days, _ = own or (None, None, None, None, None, None)
            put(Row(user_id=key[0], ms=ms, tie=tie, answer=answer, article_id=article, days=days, title=title, total=total, shown=len(items) if items is not None else None))

        def alive(state: tuple | None, ms: int) -> tuple | None:
            if state and ms - state[-1] > self.ttl:
                tell(state[-1] + self.ttl, None, "expired")
                return None
            return state

        for ms, tie, action, items, kind, title, total, days, place in rows:
            state = alive(state, ms)
            _, old_kind, old_title, old_total, _, _ = state or (None,) * 6
            if action == "list":
                state = (list(items or []), kind or "news", old_title if title is None else title, old_total if total is None else total, None, ms)
            elif action == "days":
                state = (*(state[:4] if state else ([], "free", None, None)), days, ms)
            elif action == "forget":
                state = None
            elif action == "nth":
                known = state[0] if state else []
                tell(ms, tie, "nth", known[place - 1] if place is not None and 1 <= place <= len(known) else None, state)
            elif action == "recall":
                tell(ms, tie, "recall", None, state)
        return alive(state, now)


def last_shown(actions: DataFrame, *, ttl_hours: float = 6, late: str = "0 seconds", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """The answers to a stream of readers' actions (user_id, time, ``ACTIONS``); rows with a null action are ignored."""
    return fold_in_order(actions, LastShown(ttl_hours), key="user_id", ts=ts, tie=tie, schema=ANSWERS, late=late)
