"""Keyed state that sees the rows of its key in the order of their time, however the stream was cut into micro-batches."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import islice

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ListState, MapState

from .ingest import _checkpoint

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: The store that timers and lists in state need.
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A time after all others, which closes a stream that has ended.
END = "9999-01-01 00:00:00"
#: Rows of a value in state. Each value is a call to the store, so rows go there in packs.
_PACK = 1000


class Packs:
    """Packs of a key with very many rows, each a value of its own: a list in state is one value, which every addition reads whole."""

    def __init__(self, packs: MapState):
        self.packs = packs

    def get(self) -> Iterator[tuple]:
        return (self.packs.getValue(key) for key in list(self.packs.keys()))

    def appendValue(self, pack: tuple) -> None:  # noqa: N802
        self.packs.updateValue((uuid.uuid4().hex,), pack)

    def clear(self) -> None:
        self.packs.clear()


class _Unread(Sequence):
    """Rows that are read from their texts as they are asked for, and not kept."""

    def __init__(self, texts: list[str], read: Callable[[str], tuple]):
        self.texts, self.read = texts, read

    def __len__(self) -> int:
        return len(self.texts)

    def __getitem__(self, i: int) -> tuple:
        return self.read(self.texts[i])


class InOrder(StatefulProcessor):
    """Holds rows back until the watermark has passed their time, then folds them in order.

    Rows are the columns (ms, tie, ...) of ``row_schema``: time in milliseconds,
    and what orders rows of one time; the others are numbers, strings or arrays
    of these, as rows wait as JSON. A subclass gives ``fold``; ``wakes`` may ask
    for a call at a later time without rows. The state is one tuple of
    ``state_schema``, or None. One with few keys of very many rows has them wait
    in ``Packs``.
    """

    row_schema: str
    state_schema: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.names = _names(self.row_schema)
        self.waiting = self.waits(handle)
        self.held = handle.getValueState("state", self.state_schema)

    def waits(self, handle: StatefulProcessorHandle) -> ListState | Packs:
        return handle.getListState("waiting", "pack string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        new = ((r["ms"], r["row"]) for r in rows if r["row"] is not None)
        first = None
        while part := list(islice(new, _PACK)):
            self.waiting.appendValue(("\n".join(row for _, row in part),))
            first = min(ms for ms, _ in part) if first is None else min(first, *(ms for ms, _ in part))
        if first is not None:
            self.handle.registerTimer(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        texts = [text for (pack,) in self.waiting.get() for text in pack.split("\n")]
        few = len(texts) <= _PACK
        rows = [(*row[:2], text, row if few else None) for text in texts for row in (self._read(text),)]
        due, later = sorted((r for r in rows if r[0] <= now), key=lambda r: r[:2]), [r for r in rows if r[0] > now]
        if due:
            self.waiting.clear()
            left = (text for _, _, text, _ in later)
            while part := list(islice(left, _PACK)):
                self.waiting.appendValue(("\n".join(part),))
        # Many rows stay texts, which take a fraction of the memory.
        due = [row for *_, row in due] if few else _Unread([text for _, _, text, _ in due], self._read)
        before = tuple(self.held.get()) if self.held.exists() else None
        out: list[Row] = []
        after = self.fold(key, before, due, now, out.append)
        if after is None:
            if before is not None:
                self.held.clear()
        elif after != before:
            self.held.update(after)
        wakes = [r[0] for r in later] + ([w] if (w := self.wakes(after)) is not None and w > now else [])
        if wakes:
            self.handle.registerTimer(min(wakes))
        return iter(out)

    def _read(self, text: str) -> tuple:
        return tuple(map(json.loads(text).get, self.names))

    def close(self) -> None:
        pass

    def fold(self, key: tuple, state: tuple | None, rows: Sequence[tuple], now: int, put: Callable[[Row], None]) -> tuple | None:
        """The state after the rows, which come in order; ``put`` takes what is to go out. ``now`` is the watermark."""
        raise NotImplementedError

    def wakes(self, state: tuple | None) -> int | None:
        """A time at which ``fold`` is to be called even if no row comes."""
        return None


def _names(schema: str) -> list[str]:
    return [c.strip().split(" ")[0] for c in _columns(schema)]


def _columns(schema: str) -> Iterable[str]:
    """The columns of a DDL string, whose types may have commas of their own in brackets."""
    depth, start = 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            yield schema[start:i]
            start = i + 1
    yield schema[start:]


def fold_in_order(rows: DataFrame, processor: InOrder, *, key: str, ts: str, tie: str, schema: str, late: str = "0 seconds") -> DataFrame:
    """What the processor puts out for each key of a stream; rows more than ``late`` behind the newest are dropped.

    Times count in milliseconds. Rows of one time must not be more than ``late`` apart in arrival.
    """
    timed = rows.withColumn("at", F.date_trunc("millisecond", F.col(ts).cast("timestamp")))
    timed = timed.withColumns({"ms": F.unix_millis("at"), "tie": F.col(tie)}).withWatermark("at", late)
    # A value of a row is a step in Python, so a row comes as one text.
    timed = timed.select(key, "at", "ms", F.when(F.col("tie").isNotNull(), F.to_json(F.struct(*_names(processor.row_schema)))).alias("row"))
    return timed.groupBy(key).transformWithState(processor, schema, "Append", "EventTime")


def run_stream(spark: SparkSession, build: Callable[[DataFrame], DataFrame], *, ts: str, columns: str, name: str | None = None, close: bool = True) -> DataFrame:
    """Runs a stream to the end of what is there, and returns all that it has put out so far.

    ``build`` makes the stream; it gets a stream of (ts, ...) ``columns`` to be
    united with its rows, which is empty but for one row after all times that
    closes the stream at its end (unless ``close`` is false: then rows that the
    watermark hasn't passed wait for the next run). A stream with a ``name``
    goes on where its last run ended, with its state.
    """
    where = _checkpoint(spark, name)
    rocks = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        pulse = spark.createDataFrame([], columns)
        pulse.write.mode("append").parquet(f"{where}/pulse")
        for last in (False, True) if close else (False,):
            if last:
                others = [F.lit(None).cast(f.dataType).alias(f.name) if f.name != ts else F.to_timestamp_ntz(F.lit(END)).cast(f.dataType).alias(ts) for f in pulse.schema]
                spark.range(1).select(*others).write.mode("append").parquet(f"{where}/pulse")
            out = build(spark.readStream.schema(pulse.schema).parquet(f"{where}/pulse"))
            sink = out.writeStream.format("parquet").outputMode("append").option("path", f"{where}/out").option("checkpointLocation", f"{where}/progress")
            sink.trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(out.schema).parquet(f"{where}/out")
    finally:
        spark.conf.unset(_PROVIDER) if rocks is None else spark.conf.set(_PROVIDER, rocks)
