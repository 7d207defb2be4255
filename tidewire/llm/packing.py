"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of documents. A round serves every queue with its
quantum of tokens, a fraction of a window; what is left of a fraction is the
queue's deficit and carries into the next round. Token x of a queue with
quantum q is served in the first round r with floor(r * q) > x, so every round
can be worked out on its own: the deficits of all rounds, windows and
partitions follow from sums over the queues, and no task walks the corpus.
Where few queues are left a round is small, so a step takes as many rounds as
fill a window. The served tokens form one stream, cut into sequences of fixed
length.
"""

from __future__ import annotations

import string
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Shelf, require, text_hash

#: The quanta are counted in such parts of a token.
_PART = 1 << 16
#: Entries of a worker's word memory, and the longest word that it takes, which bound its bytes (some 150 MB at
#: worst). A full one is kept as the older half of a new one.
_MEMO, _LONGEST = 300_000, 48
_SPECIAL = "<|"
_ODD_SPACES = "\x1c\x1d\x1e\x1f"
_MARKS = string.punctuation
_CATEGORY = unicodedata.ucd_3_2_0.category


class WordEncoder:
    """Ids of whole texts, equal to the tokenizer's, by encoding each distinct word once.

    The tokenizer drops white space and never joins across it, so a text's ids
    are those of its words. Texts that hold separators on which Python and the
    tokenizer differ, or marks of special tokens, go through the tokenizer
    whole, and so do words with characters that Unicode 3.2 didn't have: their
    classes, cases and compositions depend on the version of the tables, while
    those of older characters are settled.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.cut = pattern.findall
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.settled: set[str] = set()
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in shown]
        self.shape = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def _part(self, part: str) -> bytes:
        got = self.parts.get(part)
        if got is None:
            shaped = part if part.isascii() and part.isprintable() else "".join(map(self.shape.__getitem__, part.encode()))
            got = array("H", [t.id for t in self.model.tokenize(shaped)]).tobytes()
            if len(part) <= _LONGEST:
                if len(self.parts) >= _MEMO:
                    self.parts.clear()
                self.parts[part] = got
        return got

    def _whole(self, text: str) -> bytes:
        return array("H", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _low(self, text: str) -> str:
        """As the tokenizer composes and lowers characters that Unicode 3.2 had."""
        low = unicodedata.normalize("NFC", text)
        return low.lower() if "Σ" not in low else "".join(c.lower() for c in low)  # no rule for a word's last letter

    def _settled(self, word: str) -> bool:
        """Whether Unicode 3.2 had all of its characters. They are looked up once each."""
        if not self.settled.issuperset(word):
            self.settled.update(c for c in word if _CATEGORY(c) != "Cn")
        return self.settled.issuperset(word)

    def _word(self, word: str) -> bytes:
        got = self.older.get(word)
        if got is None:
            if word.isascii():
                low = word.lower()
            elif self._settled(word):
                low = self._low(word)
            else:
                low = None
            if low is None:
                got = self._whole(word)
            else:
                core, known = low.rstrip(_MARKS), self.parts.get
                if core.isalpha():  # most words are letters, with marks after them at most
                    got = known(core) or self._part(core)
                    if len(core) < len(low):
                        marks = low[len(core) :]
                        got += known(marks) or self._part(marks)
                else:
                    got = b"".join(map(self._part, self.cut(low)))
        if len(word) <= _LONGEST:
            if len(self.words) >= _MEMO:
                self.older, self.words = self.words, {}
            self.words[word] = got
        return got

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 16-bit ids."""
        if _SPECIAL in text or any(c in text for c in _ODD_SPACES):
            return self._whole(text)
        if text.isascii():
            text = text.lower()  # fewer distinct words
        known, word = self.words.get, self._word
        return b"".join([known(w) or word(w) for w in text.split()])


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _tokenized(path: str, end_id: int):
    end = array("H", [end_id]).tobytes()

    def tokenize(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = encoder(path).ids
        for part in parts:
            for at in range(0, len(part), 500):
                some = part.slice(at, 500)
                ids = [to_ids(t or "") + end for t in some.column("text").to_pylist()]
                kept = [some.column(c) for c in ("doc_id", "source", "place")]
                made = [pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(kept + made, ["doc_id", "source", "place", "tokens", "ids"])

    return tokenize


def _summed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The checksum of each piece, cut from its document's ids. Other columns pass as they are."""
    for part in parts:
        sums = []
        for ids, starts, lengths in zip(part.column("ids"), part.column("starts").to_pylist(), part.column("lengths").to_pylist()):
            wide = memoryview(np.frombuffer(ids.as_buffer(), "<u2").astype("<u4")).cast("B")
            sums.append([zlib.crc32(wide[4 * s : 4 * (s + n)]) for s, n in zip(starts, lengths)])
        names = [c for c in part.schema.names if c != "ids"]
        yield pa.RecordBatch.from_arrays([*map(part.column, names), pa.array(sums, pa.list_(pa.int64()))], [*names, "sums"])


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _round_of(x: Column) -> Column:
    """The round in which token ``x`` of a queue is served. Exact for queues of up to 10**14 tokens."""
    return _div((x + 1) * F.lit(_PART).cast("long") + F.col("quantum") - 1, F.col("quantum"))


def _got(r: Column) -> Column:
    """What a queue has been given by the end of round ``r``."""
    return F.least(F.col("held"), _div(r * F.col("quantum"), F.lit(_PART).cast("long")))


class _Steps:
    """Rounds in steps of about a window of tokens each.

    Epoch 0 is round 1, epoch b the rounds from 2**(b-1) + 1 to 2**b. The queues
    that last beyond an epoch's begin say how many tokens a round of it serves at
    most, and so how many rounds make a step. There are 64 epochs at most.
    """

    def __init__(self, active: list[int], last: int, window: int, first_step: int):
        """``active``: for each epoch the quanta, in parts of a token, of the queues that reach it."""
        self.begins = [0 if b == 0 else 1 << (b - 1) for b in range(len(active))]
        self.ends = [min(1 << b, last) for b in range(len(active))]
        self.rounds = [max(1, window * _PART // max(1, q)) for q in active]
        self.before = [first_step]
        for lo, hi, m in zip(self.begins, self.ends, self.rounds):
            self.before.append(self.before[-1] + -(-(hi - lo) // m))

    def _pick(self, values: list[int], epoch: Column) -> Column:
        return F.get(F.array(*[F.lit(v).cast("long") for v in values]), epoch)

    def step_of(self, r: Column) -> Column:
        """The step, from 1 on, that round ``r`` belongs to."""
        epoch = F.when(r <= 1, 0).otherwise(F.length(F.bin(r - 1)))
        m = self._pick(self.rounds, epoch)
        return self._pick(self.before, epoch) + _div(r - self._pick(self.begins, epoch) + m - 1, m)

    def bounds(self, step: Column) -> tuple[Column, Column]:
        """The rounds at whose ends the step begins and ends."""
        epoch = F.size(F.filter(F.array(*[F.lit(v).cast("long") for v in self.before[:-1]]), lambda v: v < step)) - 1
        lo, m = self._pick(self.begins, epoch), self._pick(self.rounds, epoch)
        k = step - self._pick(self.before, epoch)
        return lo + (k - 1) * m, F.least(lo + k * m, self._pick(self.ends, epoch))


def pack(
    docs: DataFrame,
    *,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    end_id: int = 1,
    sequence_tokens: int = 2048,
    window_sequences: int = 16,
    targets: dict[str, float] | float | None = None,
) -> DataFrame:
    """Pack every document, followed by ``end_id``, into sequences of ``sequence_tokens``.

    ``targets`` maps sources to shares of each window of ``window_sequences``
    sequences; a source without one (or with 0) has share 0 and is served after
    the rest, by its size. A number t gives all sources shares in proportion to
    size ** t: 1 the natural mixture, in which all queues end together, 0 equal
    shares, and below 1 small sources come more often than their size says.
    None is 1. A queue that ends leaves its part to the others in their
    proportions. Within a queue the order is a fixed shuffle by hash of id and
    text. Every document is packed, whatever the targets.

    Returns a row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, source, round_id (the window that served it). Each id
    lies in one piece; sequences are full but for the last. A null or empty
    text is its end id alone; null sources form a queue of their own, named
    ''; null or repeated ids are documents like any other, told apart by the
    row. Ids must be below 65,536. No documents give no rows.
    """
    require(docs, id_col, text_col, source_col)
    spark = docs.sparkSession
    shelf = Shelf(spark, "packing")
    window = sequence_tokens * window_sequences
    texts = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        F.xxhash64(F.col(id_col).cast("long"), text_hash(F.col(text_col))).alias("place"),
        F.col(text_col).alias("text"),
    )
    made = texts.mapInArrow(_tokenized(tokenizer_path, end_id), "doc_id long, source string, place long, tokens long, ids binary")
    rows = shelf.put(made.withColumn("row", F.monotonically_increasing_id()), "tokens")
    lengths = rows.select("row", "doc_id", "source", "place", "tokens")

    # A queue position for each document: sums of slices of the shuffle, then within a slice.
    total = rows.agg(F.count("*").alias("n"), F.sum("tokens").alias("t")).first()
    if not total["n"]:
        return rows.selectExpr("doc_id", "0L AS start", "0L AS length", "0L AS ids_crc32", "tokens AS doc_tokens", "0L AS sequence_id", "0L AS offset", "source", "0L AS round_id")
    # Small slices, so that no task of a large source is longer than others; their sums in two levels.
    slices = max(1, -(-total["n"] // 500))
    lengths = lengths.withColumn("slice", F.pmod("place", F.lit(slices)))
    blocks = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("source", "block").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slice_sums = lengths.groupBy("source", "slice").agg(F.sum("tokens").alias("held")).withColumn("block", F.floor(F.col("slice") / 1024))
    block_sums = slice_sums.groupBy("source", "block").agg(F.sum("held").alias("s")).withColumn("base", F.coalesce(F.sum("s").over(blocks), F.lit(0)))
    slice_sums = slice_sums.withColumn("in_block", F.coalesce(F.sum("held").over(ahead), F.lit(0))).join(block_sums.select("source", "block", "base"), ["source", "block"])

    # Quanta in parts of a token, at least one part each. Targets are named by the caller, so their map is small.
    held = rows.groupBy("source").agg(F.sum("tokens").alias("held"))
    if isinstance(targets, dict):
        goals = {k: float(v) for k, v in targets.items() if v > 0}
        given = F.create_map(*[F.lit(x) for kv in goals.items() for x in kv]) if goals else F.create_map().cast("map<string,double>")
        aim = F.element_at(given, F.col("source")) / F.lit(sum(goals.values()) or 1.0)
        share, phase = F.coalesce(aim, F.col("held").cast("double") / F.lit(float(total["t"]))), aim.isNull().cast("int")
    else:
        weight = F.pow(F.col("held").cast("double"), F.lit(1.0 if targets is None else float(targets)))
        share, phase = weight / F.lit(held.agg(F.sum(weight)).first()[0]), F.lit(0)
    queues = held.withColumn("quantum", F.greatest(F.ceil(share * window * _PART), F.lit(1)).cast("long")).withColumn("phase", phase)
    queues = shelf.put(queues.withColumn("rounds", _round_of(F.col("held") - 1)), "queues")
    reach = queues.select("phase", "rounds", "quantum", F.when(F.col("rounds") <= 1, 0).otherwise(F.length(F.bin(F.col("rounds") - 1))).alias("epoch"))
    ended = reach.groupBy("phase", "epoch").agg(F.max("rounds").alias("last"), F.sum("quantum").alias("q")).collect()  # 128 rows at most
    steps, begun = [], 0
    for p in (0, 1):
        own = [r for r in ended if r["phase"] == p]
        active = [sum(r["q"] for r in own if r["epoch"] >= b) for b in range(max((r["epoch"] for r in own), default=-1) + 1)]
        steps.append(_Steps(active or [1], max((r["last"] for r in own), default=1), window, begun))
        begun = steps[-1].before[-1] if own else begun
    by_phase = lambda f: F.when(F.col("phase") == 0, f(steps[0])).otherwise(f(steps[1]))

    # A queue position for each document, and the steps that serve it: as many as it has tokens at most.
    within = Window.partitionBy("source", "slice").orderBy("place", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = slice_sums.join(queues.select("source", "held", "quantum", "phase").withColumnRenamed("held", "queue_held"), "source")
    placed = placed.select("source", "slice", (F.col("base") + F.col("in_block")).alias("before"), F.col("queue_held").alias("held"), "quantum", "phase")
    queued = lengths.withColumn("inner", F.coalesce(F.sum("tokens").over(within), F.lit(0))).join(placed, ["source", "slice"])
    queued = queued.withColumn("at", F.col("before") + F.col("inner"))
    step_of = lambda x: by_phase(lambda s: s.step_of(_round_of(x)))
    queued = queued.withColumn("first", step_of(F.col("at"))).withColumn("last", step_of(F.col("at") + F.col("tokens") - 1))
    one_by_one = F.array_distinct(F.transform(F.sequence(F.col("at"), F.expr("at + tokens - 1")), step_of))
    turns_of = F.when(F.col("last") - F.col("first") < F.col("tokens"), F.sequence("first", "last")).otherwise(one_by_one)
    parts = queued.select("row", "source", "tokens", "at", "held", "quantum", "phase", F.explode(turns_of).alias("step"))
    parts = parts.withColumn("begin", by_phase(lambda s: _got(s.bounds(F.col("step"))[0]))).withColumn("given", by_phase(lambda s: _got(s.bounds(F.col("step"))[1])) - F.col("begin"))
    parts = parts.withColumn("lo", F.greatest("at", "begin")).withColumn("hi", F.least(F.expr("at + tokens"), F.expr("begin + given"))).filter("lo < hi")
    parts = shelf.put(parts.select("row", "source", "step", "at", "lo", "hi", "begin", "given"), "parts")

    # Where in the stream each queue's part of a step lies: the steps before it, then the sources before it.
    turns = parts.groupBy("step", "source").agg(F.first("begin").alias("begin"), F.first("given").alias("given"))
    turns = shelf.put(turns, "turns")
    sums = turns.groupBy("step").agg(F.sum("given").alias("served")).withColumn("block", F.floor(F.col("step") / 1024))
    inside = Window.partitionBy("block").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    # A block holds a thousand steps, so that this window has a row for some 33 million tokens.
    over = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    wide = sums.groupBy("block").agg(F.sum("served").alias("s")).withColumn("base", F.coalesce(F.sum("s").over(over), F.lit(0)))
    bases = sums.withColumn("inner", F.coalesce(F.sum("served").over(inside), F.lit(0))).join(wide.select("block", "base"), "block").select("step", (F.col("base") + F.col("inner")).alias("base"))
    order = Window.partitionBy("step").orderBy("source").rowsBetween(Window.unboundedPreceding, -1)
    slots = turns.withColumn("inner", F.coalesce(F.sum("given").over(order), F.lit(0))).join(bases, "step").select("source", "step", (F.col("base") + F.col("inner")).alias("stream"))

    # Pieces by the sequences they reach.
    parts = parts.join(slots, ["source", "step"])
    parts = parts.withColumn("g", F.col("stream") + F.col("lo") - F.col("begin")).withColumn("n", F.expr("hi - lo"))
    parts = parts.withColumn("sequence_id", F.explode(F.sequence(F.expr(f"g DIV {sequence_tokens}"), F.expr(f"(g + n - 1) DIV {sequence_tokens}"))))
    parts = parts.withColumn("from", F.greatest("g", F.expr(f"sequence_id * {sequence_tokens}"))).withColumn("to", F.least(F.expr("g + n"), F.expr(f"(sequence_id + 1) * {sequence_tokens}")))
    piece = F.struct(F.expr("lo - at + from - g").alias("start"), F.expr("to - from").alias("length"), "sequence_id", F.expr(f"from - sequence_id * {sequence_tokens}").alias("offset"), F.col("step").alias("round_id"))
    pieces = parts.select("row", piece.alias("piece")).groupBy("row").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))

    # The ids once more, for the checksums.
    cut = pieces.select("row", "pieces", F.col("pieces.start").alias("starts"), F.col("pieces.length").alias("lengths"))
    checked = rows.join(cut, "row").select("doc_id", "source", "tokens", "pieces", "starts", "lengths", "ids")
    kind = cut.schema["pieces"].dataType.simpleString()
    checked = checked.mapInArrow(_summed, f"doc_id long, source string, tokens long, pieces {kind}, starts array<long>, lengths array<long>, sums array<long>")
    each = checked.select("doc_id", "source", "tokens", F.explode(F.arrays_zip("pieces", "sums")).alias("p"))
    return each.select(
        "doc_id",
        F.col("p.pieces.start").alias("start"),
        F.col("p.pieces.length").alias("length"),
        F.col("p.sums").alias("ids_crc32"),
        F.col("tokens").alias("doc_tokens"),
        F.col("p.pieces.sequence_id").alias("sequence_id"),
        F.col("p.pieces.offset").alias("offset"),
        "source",
        F.col("p.pieces.round_id").alias("round_id"),
    )
