"""Benchmark leaks in training documents: rare n-gram seeds, then Smith-Waterman alignment on words.

The test items are the bounded side. They go to the workers in blocks of a
checked size, one scan of the documents for the counts and one for the
alignment, so that no text is shuffled and no key gathers rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shelf, require, text_hash

#: Points of the alignment for a word that matches, one that differs, and one left out or put in.
MATCH, DIFFER, GAP = 2, -1, -2
#: Most n-grams of test items that are sent to the workers at once, some 60 MB. More take more scans.
BLOCK_GRAMS = 1_000_000
_WORD = re.compile(r"\w+").findall
_OUT = "doc_id long, text_hash long, item_id long, score double, first_word long, last_word long, seeds long"


def word_ids(text: str | None) -> np.ndarray:
    """64-bit ids of the lower-cased words; marks and spaces don't count."""
    words = _WORD(text.lower()) if text else []
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def gram_ids(ids: np.ndarray, n: int) -> np.ndarray:
    if len(ids) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(ids) - n + 1, np.uint64)
    for i in range(n):
        out = (out ^ ids[i : len(ids) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return out


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """Best local alignment: its points and the position after its last word. A row of the table at a time."""
    rise = np.arange(len(words) + 1, dtype=np.int64) * -GAP
    row, best, end = np.zeros(len(words) + 1, np.int64), 0, 0
    for w in item:
        step = np.where(words == w, MATCH, DIFFER)
        new = np.maximum(row + GAP, 0)
        np.maximum(new[1:], row[:-1] + step, out=new[1:])
        row = np.maximum.accumulate(new + rise) - rise
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
    return best, end


class Items:
    """A block of test items with the grams that serve as seeds."""

    def __init__(self, rows: list[tuple[int, str]], n: int):
        self.n = n
        self.names = [i for i, _ in rows]
        self.words = [word_ids(t) for _, t in rows]
        grams = [gram_ids(w, n) for w in self.words]
        flat = np.concatenate([*grams, np.empty(0, np.uint64)])
        self.item = np.repeat(np.arange(len(rows)), [len(g) for g in grams])
        self.place = np.concatenate([*(np.arange(len(g)) for g in grams), np.empty(0, int)]).astype(int)
        order = np.argsort(flat, kind="stable")
        self.item, self.place, flat = self.item[order], self.place[order], flat[order]
        self.seeds, self.first = np.unique(flat, return_index=True)
        self.stop = np.append(self.first[1:], len(flat))

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in the document, and the seeds there."""
        grams = gram_ids(words, self.n)
        if not len(self.seeds) or not len(grams):
            return np.empty(0, int), np.empty(0, int)
        at = np.searchsorted(self.seeds, grams)
        at[at == len(self.seeds)] = 0
        where = np.flatnonzero(self.seeds[at] == grams)
        return where, at[where]

    def keep(self, counts: np.ndarray, limit: float) -> None:
        """Drop the common seeds: those in more than ``limit`` documents, but never the rarer half of an item's."""
        each = np.repeat(counts, self.stop - self.first)
        good = each <= limit
        order = np.lexsort((each, self.item))
        first, size = np.unique(self.item[order], return_index=True, return_counts=True)[1:]
        middle = each[order[first + (size - 1) // 2]]  # of each item's counts in order
        good[order] |= each[order] <= np.repeat(middle, size)
        seed = np.repeat(self.seeds, self.stop - self.first)[good]
        self.item, self.place = self.item[good], self.place[good]
        self.seeds, self.first = np.unique(seed, return_index=True)
        self.stop = np.append(self.first[1:], len(seed))

    def leaks(self, words: np.ndarray, least: float) -> list[tuple[int, float, int, int, int]]:
        """(item, score, first word, last word, seeds) of each item that the document holds."""
        where, seed = self.hits(words)
        if not len(where):
            return []
        spread = self.stop[seed] - self.first[seed]
        where = np.repeat(where, spread)
        entry = np.concatenate([np.arange(a, b) for a, b in zip(self.first[seed], self.stop[seed])])
        item, start = self.item[entry], where - self.place[entry]
        size = np.array([len(w) for w in self.words])[item]
        # Starts within one item length share a region, which reaches half a length beyond either end.
        key, count = np.unique(np.stack([item, start // size]), axis=1, return_counts=True)
        best: dict[int, tuple[float, int, int, int]] = {}
        for i, block, seeds in zip(*key, count):
            own = self.words[i]
            m = len(own)
            lo = max(0, block * m - m // 2)
            region = words[lo : (block + 2) * m + m // 2]
            if np.isin(own, region).sum() < least * m:  # bounds the score from above
                continue
            points, end = align(own, region)
            score = points / (MATCH * m)
            if score >= least and score > best.get(i, (0,))[0]:
                _, back = align(own[::-1], region[:end][::-1])
                best[i] = (score, lo + end - back, lo + end - 1, int(seeds))
        return [(int(i), *x) for i, x in sorted(best.items())]


def _counted(items: Items):
    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(len(items.seeds), np.int64)
        rows = 0
        for part in parts:
            rows += len(part)
            for text in part["text"]:
                counts[np.unique(items.hits(word_ids(text))[1])] += 1
        seen = np.flatnonzero(counts)
        yield pd.DataFrame({"seed": np.append(seen, -1), "n": np.append(counts[seen], rows)})

    return count


def _aligned(items: Items, least: float):
    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for doc, mark, text in zip(part["doc_id"].astype("Int64").tolist(), part["text_hash"], part["text"]):
                found = items.leaks(word_ids(text), least)
                out += [(None if doc is pd.NA else doc, mark, items.names[i], *rest) for i, *rest in found]
            names = [c.split()[0] for c in _OUT.split(", ")]
            yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64", "item_id": "Int64"})

    return scan


def benchmark_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    gram_words: int = 3,
    least_score: float = 0.5,
    rare_share: float = 1e-3,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """The (document, test item) pairs in which the document holds a copy of the item, edited or not.

    Seeds are the items' grams of ``gram_words`` words that are rare among the
    documents: in at most ``rare_share`` of them (or five), and in any case the
    rarer half of each item's, so that an item which leaked often keeps seeds.
    Each region of a document around a seed is aligned with the item; the score
    is the alignment's points over those of a whole copy, and pairs of
    ``least_score`` or more are returned: doc_id, text_hash, item_id, score,
    first_word, last_word (the copy's place in the document), seeds.

    Items shorter than a gram can't be told from chance and are left out, as
    are null texts on either side. Repeated rows give their pairs each; null
    ids are passed on; other columns are ignored; an empty table on either side
    gives no pairs.
    """
    require(docs, id_col, text_col)
    require(benchmark, item_col, item_text_col)
    spark = docs.sparkSession
    shelf = Shelf(spark, "leaks")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    tests = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text")).filter("text IS NOT NULL")
    size = tests.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_GRAMS))
    found = None
    for k in range(blocks):
        block = tests.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        items = Items([(r["item"], r["text"]) for r in block.orderBy("item", "text").collect()], gram_words)  # a block at most
        sums = texts.select("text").mapInPandas(_counted(items), "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).collect()
        counts = np.zeros(len(items.seeds), np.int64)
        rows = 0
        for r in sums:  # a row a seed of the block
            if r["seed"] < 0:
                rows = r["n"]
            else:
                counts[r["seed"]] = r["n"]
        items.keep(counts, max(5, rare_share * rows))
        pairs = shelf.put(texts.mapInPandas(_aligned(items, least_score), _OUT), "pairs")
        found = pairs if found is None else found.unionByName(pairs)
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents that hold no copy of a test item, with all their columns and repeated rows."""
    leaks = benchmark_leaks(docs, benchmark, **how).select(F.col("doc_id").alias("leak_id"), F.col("text_hash").alias("leak_hash")).distinct()
    match = docs["doc_id"].cast("long").eqNullSafe(leaks["leak_id"]) & (text_hash(docs["text"]) == leaks["leak_hash"])
    return docs.join(leaks, match, "left_anti")
