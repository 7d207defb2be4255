"""Alerts to readers, paced by a cooldown and a daily cap, folded in slices of a day that join by a small state."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import drop_written, written
from .policy import local_day

_ATTEMPTS = "user_id bigint, ms bigint, round_at timestamp_ntz, article_id bigint, reissue boolean, place bigint, day date"


def _folded(df: DataFrame, keys: tuple[str, ...], make: Callable[[list[dict]], list[tuple]], schema: str) -> DataFrame:
    """What ``make`` makes of the rows of each key, one key after another in sorted partitions, so that small slices cost little."""
    names, columns = df.columns, [c.split()[0] for c in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []
        for part in parts:
            out: list[tuple] = []
            for values in part.itertuples(index=False, name=None):
                row = dict(zip(names, values, strict=True))
                own = tuple(row[k] for k in keys)
                if own != key:
                    out += make(held) if held else []
                    key, held = own, []
                held.append(row)
            yield pd.DataFrame(out, columns=columns)
        if held:
            yield pd.DataFrame(make(held), columns=columns)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def _known(value: object) -> int | None:
    """A number from a column that may have nulls."""
    return None if value is None or pd.isna(value) else int(value)


def _rounds(rows: list[dict]) -> tuple[list[int], list[list[tuple]]]:
    """Times of the rounds of a slice, and in each its attempts: (row, article, reissue), new ones first, by place."""
    ordered = sorted((r["ms"], r["reissue"], r["place"], r["article_id"], i) for i, r in enumerate(rows))
    each = [(ms, [(i, article, bool(again)) for _, again, _, article, i in group]) for ms, group in groupby(ordered, key=lambda r: r[0])]
    return [ms for ms, _ in each], [attempts for _, attempts in each]


def fold_slice(times: list[int], attempts: list[list[tuple]], allowed: int | None, cooldown: int, cap: int) -> tuple[dict[int, str], int | None]:
    """The verdict of each attempt of a reader's day, and when the last was sent, if one was.

    ``allowed`` is the first moment after the cooldown that the day before left.
    """
    verdicts: dict[int, str] = {}
    sent: set[int] = set()
    used, last = 0, None
    for at, round_ in zip(times, attempts):
        served = False  # the first of a round starts the cooldown, which its other new articles are spared
        for row, article, again in round_:
            waits = allowed is not None and at < allowed and (again or not served)
            if article in sent:
                verdicts[row] = "already sent"
            elif used >= cap:
                verdicts[row] = "cap"
            elif waits:
                verdicts[row] = "cooldown"
            else:
                verdicts[row], served, last, allowed = "sent", True, at, at + cooldown
                sent.add(article)
                used += 1
    return verdicts, last


def _entries(rows: list[dict], cooldown: int, cap: int) -> list[tuple[int, int | None]]:
    """(upto, last): whoever may be served from a moment up to ``upto`` on is served last at ``last``; neighbours with one outcome are one.

    The day before can hold back only what comes within a cooldown of the day's first round.
    """
    times, attempts = _rounds(rows)
    out: list[tuple[int, int | None]] = []
    for start in range(min(len(times), bisect_left(times, times[0] + cooldown) + 1)):
        last = fold_slice(times[start:], attempts[start:], None, cooldown, cap)[1]
        if out and out[-1][1] == last:
            out.pop()
        out.append((times[start], last))
    return out


def _sliced(attempts: DataFrame, cooldown: int, cap: int) -> DataFrame:
    """The attempts with their verdicts, as far as they follow from cooldown, cap and repeats on a day."""

    def summary(rows: list[dict]) -> list[tuple]:
        return [(rows[0]["user_id"], rows[0]["day"], upto, last) for upto, last in _entries(rows, cooldown, cap)]

    def carried(rows: list[dict]) -> list[tuple]:
        """The state that each day of a reader starts with: a few numbers a day."""
        last, out = None, []
        for day, own in groupby(sorted(rows, key=lambda r: (r["day"], r["upto"])), key=lambda r: r["day"]):
            out.append((rows[0]["user_id"], day, last))
            allowed = None if last is None else last + cooldown
            entry = next((r["last"] for r in own if allowed is None or allowed <= r["upto"]), None)
            last = last if _known(entry) is None else _known(entry)
        return out

    def verdicts(rows: list[dict]) -> list[tuple]:
        before = _known(rows[0]["before"])
        found, _ = fold_slice(*_rounds(rows), None if before is None else before + cooldown, cooldown, cap)
        return [(*(r[c.split()[0]] for c in _ATTEMPTS.split(", ")), found[i]) for i, r in enumerate(rows)]

    states = _folded(attempts, ("user_id", "day"), summary, "user_id bigint, day date, upto bigint, last bigint")
    starts = _folded(states, ("user_id",), carried, "u bigint, d date, before bigint")
    own = attempts.join(starts, (F.col("user_id") == F.col("u")) & (F.col("day") == F.col("d"))).drop("u", "d")
    return _folded(own, ("user_id", "day"), verdicts, f"{_ATTEMPTS}, verdict string")


def paced_rounds(attempts: DataFrame, *, cooldown_minutes: int = 60, per_day: int = 5, zone: str = "UTC") -> DataFrame:
    """The attempts (user_id, round_at, article_id, reissue, place) with a verdict: sent, already sent, cap or cooldown.

    In a round a reader is offered the new articles first, then those that
    waited, each by place. An article goes out if the reader never had it, had
    fewer than ``per_day`` on this local day, and had the last one a cooldown
    ago; the other new articles of a round in which one went out are spared the
    cooldown, those that waited are not. Rows without a reader, time or article
    are left out. Attempts of a reader must differ in (round_at, reissue, place, article_id).

    A reader's day is a slice, folded by a task of its own. What a slice does to
    the next is one moment, when the last was sent; for each moment that the day
    before may leave, a slice tells its own, and these few numbers are carried
    over the days. Repeats on later days are found afterwards and taken out,
    until there are none: each round takes all of what went out before a
    reader's earliest repeat, and folds only the readers who had one.
    """
    rows = attempts.select("user_id", F.unix_millis(F.col("round_at").cast("timestamp")).alias("ms"), F.col("round_at").cast("timestamp_ntz").alias("round_at"), "article_id", F.coalesce("reissue", F.lit(False)).alias("reissue"), F.col("place").cast("bigint").alias("place"))
    rows = rows.filter("user_id IS NOT NULL AND ms IS NOT NULL AND article_id IS NOT NULL").withColumn("day", local_day(F.col("round_at"), zone))
    rows, parts = written(rows), []
    while True:
        decided = written(_sliced(rows, int(cooldown_minutes * 60_000), per_day))
        first = decided.filter("verdict = 'sent'").groupBy("user_id", "article_id").agg(F.min("ms").alias("first"), F.min("day").alias("first_day"))
        met = written(decided.join(first, ["user_id", "article_id"], "left").withColumn("late", F.coalesce(F.col("day") > F.col("first_day"), F.lit(False))))
        # What went out before a reader's earliest repeat is sure; the days after may change when the repeat goes.
        sure = written(met.filter("late AND verdict = 'sent'").groupBy("user_id").agg(F.min("day").alias("until")))
        # A reader without repeats is done, and takes no part in the rounds that follow.
        done = met.join(sure, "user_id", "left_anti").withColumn("verdict", F.when(F.col("late"), "already sent").otherwise(F.col("verdict")))
        parts.append(written(done.select(*rows.columns, "verdict")))
        if sure.isEmpty():
            drop_written(rows, decided, met)
            return reduce(DataFrame.unionByName, parts).drop("ms", "day")
        gone = written(met.filter("late").join(sure, "user_id").filter("first_day < until").select(*rows.columns))
        parts.append(gone.withColumn("verdict", F.lit("already sent")))
        before, rows = rows, written(rows.join(sure.select("user_id"), "user_id", "left_semi").join(gone.select("user_id", "article_id", "day").distinct(), ["user_id", "article_id", "day"], "left_anti"))
        drop_written(before, decided, met)


def settled(verdicts: DataFrame) -> DataFrame:
    """(round_at, article_id, keep, delivered): after each round, whether an article is booked again or its mark is cleared.

    It stays booked as long as any reader waits for it, even if another had it.
    """
    waits = F.col("verdict").isin("cap", "cooldown")
    return verdicts.groupBy("round_at", "article_id").agg(F.bool_or(waits).alias("keep"), F.bool_or(F.col("verdict") == "sent").alias("delivered"))


def first_of_each(verdicts: DataFrame) -> DataFrame:
    """(user_id, article_id, round_at) of what went out, once for each reader and article."""
    order = Window.partitionBy("user_id", "article_id").orderBy("round_at")
    return verdicts.filter("verdict = 'sent'").withColumn("n", F.row_number().over(order)).filter("n = 1").select("user_id", "article_id", "round_at")
