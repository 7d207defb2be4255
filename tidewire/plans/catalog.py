"""All queries of the feed engine by name, with the SQL that checks them."""

from __future__ import annotations

from . import feed_queries, more_queries, policy_queries, process_queries, replay_queries, round_queries, stream_queries, text_queries, translation_queries, upkeep_queries, vocabulary_queries  # noqa: F401  (they register themselves)
from .registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
