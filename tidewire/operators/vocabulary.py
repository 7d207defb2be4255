"""Texts joined with a vocabulary that is a table: where in each text which of many terms stand."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..sources.shared import written

#: A letter or digit of a plain word; terms of such stand alone, but for a version behind them.
_PLAIN = "a-z0-9"
_WORD, _FOREIGN, _MARK = re.compile(f"[{_PLAIN}]+"), re.compile(r"[^\x00-\x7f]"), re.compile(f"[^{_PLAIN} ]")
_VERSION, _BEFORE = re.compile(r"(?<=.)(?=v[0-9])"), re.compile(f"[{_PLAIN}]")
_BEHIND = re.compile(f"(?!v[0-9])[{_PLAIN}]")
#: Bits of a sieve for keys.
_SLOTS = 1 << 20
#: Rows that a helper hands on at once, or those of a text where it has more.
_SLICE = 50_000
#: A vocabulary of so many terms and characters at most is carried to the texts: to look for each is then less than to list a text's keys.
_FEW, _SHORT = 500, 50_000


def _grams(text: str, n: int) -> set[str]:
    return {text[i : i + n] for i in range(len(text) - n + 1)}


def _keys(text: str, words: bool, n: int, of_term: bool) -> set[str]:
    """What a text is found by; or, where terms may stand anywhere, runs of ``n``.

    Plain words, pairs of neighbouring ones, and pairs with a foreign character.
    A term with foreign characters is known by these, one of several plain words by its pairs.
    """
    if not words:
        return _grams(text, n)
    foreign = {pair for m in _FOREIGN.finditer(text) for i in (m.start() - 1, m.start()) if i >= 0 and len(pair := text[i : i + 2]) == 2} if not text.isascii() else set()
    runs = _WORD.findall(text)
    plain, pairs = set(runs), set(map(" ".join, zip(runs, runs[1:], strict=False)))
    if of_term and (foreign or plain):
        return foreign or pairs or plain
    # Terms of marks alone, such as "$$", are found by their characters, with a sign before them that no word has.
    marks = {"\x01" + c for c in _MARK.findall(text)}
    if of_term:
        return marks
    # What of a run stands before a version is a word too ("name" of "namev2"), also as the last of a pair.
    heads = {k[: m.start()] for k in plain | pairs if "v" in k for m in _VERSION.finditer(k) if k[m.start() - 1] != " " and " " not in k[m.start() :]}
    return plain | pairs | foreign | marks | heads


def _starts(text: str, term: str, words: bool) -> list[int]:
    """Where the term stands in the text, from 0 on."""
    out, at, alone = [], text.find(term), words and term.isascii()
    while at >= 0:
        if not alone or not (at and _BEFORE.match(text, at - 1) or _BEHIND.match(text, at + len(term))):
            out.append(at)
        at = text.find(term, at + 1)
    return out


def _batch(ids: pa.Array, at: list[int], schema: pa.Schema, *values: list) -> pa.RecordBatch:
    """Values with the ids at their places."""
    own = ids.take(pa.array(at, pa.int64()))
    return pa.RecordBatch.from_arrays([own, *(pa.array(v, f.type) for v, f in zip(values, list(schema)[1:], strict=True))], names=schema.names)


def _sieve(asked: DataFrame) -> bytes:
    """A bit for each key's hash, of fixed size: what it lets through, a join still has to look up."""
    slot = F.crc32(F.col("key").cast("binary")).bitwiseAND(F.lit(_SLOTS - 1))
    bits = asked.select(slot.alias("slot")).groupBy(F.expr("slot DIV 64").alias("at")).agg(F.expr("bit_or(shiftleft(1L, CAST(slot % 64 AS INT)))").alias("bits"))
    out = bytearray(_SLOTS // 8)
    for at, own in bits.collect():  # a 64th of the slots at most
        out[8 * at : 8 * at + 8] = own.to_bytes(8, "little", signed=True)
    return bytes(out)


def _asked(sieve: bytes | None, keys: set[str]) -> list[str]:
    """The keys that a sieve lets through."""
    if sieve is None:
        return list(keys)
    return [k for k in keys if sieve[(slot := crc32(k.encode()) & (_SLOTS - 1)) >> 3] >> (slot & 7) & 1]


def _keyed(rows: DataFrame, words: bool, n: int, *, of_term: bool = False, sieve: bytes | None = None) -> DataFrame:
    """(id, key) of rows (id, text), each key of a text once; with a sieve only those that it lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, (at, keys) = batch.column(0), ([], [])
            schema = pa.schema([("id", ids.type), ("key", pa.string())])
            for i, text in enumerate(batch.column(1)):
                own = _asked(sieve, _keys(text.as_py(), words, n, of_term)) if text.is_valid else []
                keys += own
                at += [i] * len(own)
                if len(at) >= _SLICE:
                    yield _batch(ids, at, schema, keys)
                    at, keys = [], []
            yield _batch(ids, at, schema, keys)

    return rows.select("id", "text").mapInArrow(run, StructType([rows.schema["id"], StructField("key", StringType())]))


def _counted(rows: DataFrame, words: bool, n: int, sieve: bytes) -> DataFrame:
    """(key, n): how many texts have each key that a sieve lets through, added up in the tasks first."""

    def sums(count: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                count.update(_asked(sieve, _keys(text.as_py(), words, n, False)) if text.is_valid else ())
                if len(count) >= _SLICE:
                    yield sums(count)
                    count.clear()
        yield sums(count)

    return rows.select("text").mapInArrow(run, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))


def term_hits(texts: DataFrame, terms: DataFrame, *, id_col: str = "id", text_col: str = "text", term_col: str = "term", whole_words: bool = True) -> DataFrame:
    """(id, term, starts): for each text and each term that stands in it, the places, from 0 on, in any case.

    A term of plain characters must stand alone: no plain letter or digit before
    it, nor behind it but a version ("name" stands in "NAMEv2", not in
    "namely"); a term with other characters may stand anywhere, as may all if
    not ``whole_words``. Terms are trimmed and lower-case, of two characters or
    more, each once; null texts and terms have no hits. Ids must be unique.

    The vocabulary is inverted: a term is known by the rarest of its words,
    pairs of words or runs of characters, and only texts that have it are
    searched for the term. A vocabulary of any size is a join, not an expression.
    One of a few terms goes to the texts as it is, so that no text is shuffled.
    """
    rows, known = _lowered(texts, terms, id_col, text_col, term_col)
    few = _carried(known)
    fields = [rows.schema["id"], StructField("term", StringType()), StructField("starts", ArrayType(IntegerType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, (at, found, starts) = batch.column(0), ([], [], [])
            schema = pa.schema([("id", ids.type), ("term", pa.string()), ("starts", pa.list_(pa.int32()))])
            for i, text in enumerate(batch.column(1)):
                text = text.as_py()
                for term in few if few is not None else batch.column(2)[i].as_py():
                    if text is not None and (places := _starts(text, term, whole_words)):
                        at.append(i)
                        found.append(term)
                        starts.append(places)
                if len(at) >= _SLICE:
                    yield _batch(ids, at, schema, found, starts)
                    at, found, starts = [], [], []
            yield _batch(ids, at, schema, found, starts)

    if few is None:
        rows, maybe = _candidates(rows, known, "id", "text", "term", whole_words)
        rows = rows.join(maybe, "id").select("id", "text", "terms")
    return rows.mapInArrow(run, StructType(fields))


def contained(texts: DataFrame, terms: DataFrame, *, id_col: str = "id", text_col: str = "text", term_col: str = "term") -> DataFrame:
    """(id, term): for each text the terms that it contains anywhere, in any case; found as in ``term_hits``."""
    rows, known = _lowered(texts, terms, id_col, text_col, term_col)
    few = _carried(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, (at, found) = batch.column(0), ([], [])
            schema = pa.schema([("id", ids.type), ("term", pa.string())])
            for i, text in enumerate(batch.column(1)):
                text = text.as_py()
                own = [t for t in few if t in text] if text is not None else []
                found += own
                at += [i] * len(own)
                if len(at) >= _SLICE:
                    yield _batch(ids, at, schema, found)
                    at, found = [], []
            yield _batch(ids, at, schema, found)

    if few is not None:
        return rows.mapInArrow(run, StructType([rows.schema["id"], StructField("term", StringType())]))
    rows, maybe = _candidates(rows, known, "id", "text", "term", False)
    return rows.join(maybe, "id").select("id", "text", F.explode("terms").alias("term")).filter(F.contains("text", "term")).select("id", "term")


def _lowered(texts: DataFrame, terms: DataFrame, id_col: str, text_col: str, term_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, text) and (term), both in lower case, each term once."""
    known = terms.select(F.lower(F.trim(term_col)).alias("term")).filter(F.length("term") >= 2).distinct()
    return texts.select(F.col(id_col).alias("id"), F.lower(F.col(text_col)).alias("text")), known


def _carried(known: DataFrame) -> list[str] | None:
    """The terms of a small vocabulary; none of one that is larger."""
    n, size = known.agg(F.count("*"), F.sum(F.length("term"))).first()
    return sorted(r.term for r in known.collect()) if n <= _FEW and (size or 0) <= _SHORT else None


def _candidates(texts: DataFrame, terms: DataFrame, id_col: str, text_col: str, term_col: str, whole_words: bool) -> tuple[DataFrame, DataFrame]:
    """(id, text), and (id, terms): the terms whose rarest word or run of characters a text has.

    Keys are counted before any is posted, so that a text is listed for the rarest keys alone, however common the others are.
    """
    rows, known = _lowered(texts, terms, id_col, text_col, term_col)
    n = 2 if whole_words else min(3, known.agg(F.min(F.length("term"))).first()[0] or 3)
    asked = written(_keyed(known.select(F.col("term").alias("id"), F.col("term").alias("text")), whole_words, n, of_term=True).withColumnRenamed("id", "term"))
    # Where a term has but one key, there is nothing to choose.
    several = asked.groupBy("term").agg(F.count("*").alias("keys")).filter("keys > 1").select("term")
    if several.isEmpty():
        rarest = asked
    else:
        count = _counted(rows, whole_words, n, _sieve(asked.join(several, "term", "left_semi")))
        rarest = written(asked.join(count, "key", "left").groupBy("term").agg(F.min_by("key", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("key")))
    return rows, _keyed(rows, whole_words, n, sieve=_sieve(rarest)).join(rarest, "key").groupBy("id").agg(F.collect_set("term").alias("terms"))
