"""Which tokens of two tokenizers stand for the same bytes, and how often over the corpus.

Both tokenizers cut the same bytes; where both end a token, a group ends. Most
groups come again and again, so each distinct group is interned and its links
are expanded once, whatever its frequency: counts are links times frequencies,
and what a group is worth goes back to the documents by its key.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shelf, require, text_hash

#: Bytes of text whose groups are interned together; a longer text is a slice of its own.
SLICE = 1 << 22
#: Which characters byte-level vocabularies write the bytes as: printable ones as themselves, the others from U+0100 on.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_OF = {chr(b): b for b in _PRINTED} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}
#: How byte-level vocabularies part texts into words (a fixed value of theirs).
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteLevel:
    """A byte-level BPE vocabulary of the tokenizers library; special tokens in a text are ordinary text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.encode_special_tokens = True
        self.bytes = {i: bytes(_BYTE_OF[c] for c in token) for token, i in own.get_vocab(with_added_tokens=False).items()}
        spec = json.loads(own.to_str())
        self._own, self._ranks = own, None
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"].get("merges", [])]
        made = [own.token_to_id(a + b) for a, b in merges]
        plain = spec["normalizer"] is None and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        if plain and made == sorted(made) and len(made) + 256 == len(self.bytes):
            # Ids in the order of merges are ranks, with which another library makes the same tokens in a quarter of the time.
            import tiktoken

            self._ranks = tiktoken.Encoding("ranks", pat_str=_WORDS, mergeable_ranks={b: i for i, b in self.bytes.items()}, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        spaced = [" " + t for t in texts]
        if self._ranks:
            return [self._ranks.encode_ordinary(t) for t in spaced]
        return [e.ids for e in self._own.encode_batch(spaced, add_special_tokens=False)]


class Pieces:
    """A sentencepiece vocabulary, which puts a space before the text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self._own = sentencepiece.SentencePieceProcessor(model_file=path)
        name, byte = self._own.id_to_piece, self._own.is_byte
        self.bytes = {i: bytes([int(name(i)[3:5], 16)]) if byte(i) else name(i).replace("▁", " ").encode() for i in range(self._own.vocab_size())}

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._own.encode(texts, num_threads=1)


class Pair:
    """Both tokenizers of a worker process."""

    _made: dict[tuple[str, str], Pair] = {}

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        self.lengths = [np.array([len(v.bytes.get(i, b"")) for i in range(max(v.bytes) + 1)]) for v in (self.a, self.b)]

    @classmethod
    def of(cls, a_path: str, b_path: str) -> Pair:
        if (a_path, b_path) not in cls._made:
            cls._made[a_path, b_path] = cls(a_path, b_path)
        return cls._made[a_path, b_path]

    def tokens(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids by both; none where a text is empty, or where either's bytes aren't those of space and text."""
        filled = [t for t in texts if t]
        coded = iter(zip(filled, self.a.encode(filled), self.b.encode(filled), strict=True))
        out = []
        for text in texts:
            own: tuple[list[int], list[int]] = ([], [])
            if text:
                _, a, b = next(coded)
                whole = b" " + text.encode()
                if b"".join(map(self.a.bytes.__getitem__, a)) == whole == b"".join(map(self.b.bytes.__getitem__, b)):
                    own = (a, b)
            out.append(own)
        return out

    def links(self, key: str) -> Counter[tuple[int, int]]:
        """How often each pair of ids overlaps in a group."""
        a, b = ([int(i) for i in side.split(",")] for side in key.split("|"))
        return Counter(links(a, b, self.lengths[0][a], self.lengths[1][b]))


def links(a: list[int], b: list[int], a_lengths, b_lengths) -> Iterator[tuple[int, int]]:
    """The pairs of tokens that share bytes, from left to right."""
    i = j = 0
    a_end, b_end = a_lengths[0], b_lengths[0]
    while True:
        yield a[i], b[j]
        step_a, step_b = a_end <= b_end, b_end <= a_end
        i, j = i + step_a, j + step_b
        if i == len(a) or j == len(b):
            return
        a_end, b_end = a_end + step_a * a_lengths[i], b_end + step_b * b_lengths[j]


def group_bounds(a_lengths: np.ndarray, b_lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For consecutive texts: the tokens, counted from 1, of either side that end a group."""
    a_ends, b_ends = np.cumsum(a_lengths), np.cumsum(b_lengths)
    number = np.zeros((int(a_ends[-1]) if len(a_ends) else 0) + 1, np.int32)
    number[a_ends] = np.arange(1, len(a_ends) + 1)
    a_at = number[b_ends]
    both = a_at > 0
    return a_at[both], np.flatnonzero(both) + 1


def intern(a: np.ndarray, b: np.ndarray, a_upto: np.ndarray, b_upto: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """The number of each group's distinct group, and the keys of those: ids of either side, shape by shape."""
    a_from, b_from = np.concatenate([[0], a_upto[:-1]]), np.concatenate([[0], b_upto[:-1]])
    shape = (a_upto - a_from) * (len(b) + 1) + (b_upto - b_from)
    spots, keys = np.empty(len(shape), np.int64), []
    by_shape = np.argsort(shape, kind="stable")
    for rows in np.split(by_shape, np.flatnonzero(np.diff(shape[by_shape])) + 1) if len(shape) else []:
        n, m = a_upto[rows[0]] - a_from[rows[0]], b_upto[rows[0]] - b_from[rows[0]]
        ids = np.concatenate([a[a_from[rows, None] + np.arange(n)], b[b_from[rows, None] + np.arange(m)]], axis=1).astype(np.int32)
        codes = ids[:, 0].astype(np.int64) << 32 | ids[:, 1] if n == m == 1 else np.ascontiguousarray(ids).view(np.dtype((np.void, 4 * int(n + m)))).ravel()
        _, first, own = np.unique(codes, return_index=True, return_inverse=True)
        spots[rows] = own + len(keys)
        keys += [",".join(map(str, row[:n])) + "|" + ",".join(map(str, row[n:])) for row in ids[first].tolist()]
    return spots, keys


_CODED = pa.schema(
    [
        ("block", pa.int64()),
        ("doc_id", pa.int64()),
        ("text_hash", pa.int64()),
        ("n_a", pa.int64()),
        ("n_b", pa.int64()),
        ("n_groups", pa.int64()),
        ("groups_sha256", pa.string()),
        ("spots", pa.list_(pa.int32())),
        ("times", pa.list_(pa.int32())),
        ("spot", pa.int32()),
        ("key", pa.string()),
        ("freq", pa.int64()),
    ]
)


def _batch(n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in _CODED], schema=_CODED)


def code_slice(block: int, ids: pa.Array, hashes: pa.Array, texts: list[str], pair: Pair) -> Iterator[pa.RecordBatch]:
    """A row for each text with its distinct groups and their numbers, and one for each distinct group of the slice."""
    coded = pair.tokens(texts)
    sizes = np.array([(len(a), len(b)) for a, b in coded]).reshape(-1, 2)
    a, b = (np.concatenate([np.zeros(0, np.int64), *(np.array(x[k], np.int64) for x in coded)]) for k in (0, 1))
    a_upto, b_upto = group_bounds(pair.lengths[0][a], pair.lengths[1][b])
    spots, keys = intern(a, b, a_upto, b_upto)
    upto = np.searchsorted(a_upto, np.cumsum(sizes[:, 0]), side="right")  # both sides of a text end on the same byte
    since = np.concatenate([[0], upto[:-1]])
    digests = [hashlib.sha256(";".join(map(keys.__getitem__, spots[i:j].tolist())).encode()).hexdigest() if j > i else "" for i, j in zip(since, upto, strict=True)]
    doc_of = np.repeat(np.arange(len(texts)), upto - since)
    pairs, times = np.unique(doc_of * (len(keys) + 1) + spots, return_counts=True)
    bounds = pa.array(np.searchsorted(pairs, np.arange(len(texts) + 1) * (len(keys) + 1)), pa.int32())
    listed = lambda values: pa.ListArray.from_arrays(bounds, pa.array(values, pa.int32()))
    many = lambda x: pa.array(x, pa.int64())
    n = len(texts)
    yield _batch(n, block=many([block] * n), doc_id=ids, text_hash=hashes, n_a=many(sizes[:, 0]), n_b=many(sizes[:, 1]), n_groups=many(upto - since), groups_sha256=pa.array(digests, pa.string()), spots=listed(pairs % (len(keys) + 1)), times=listed(times))
    if n := len(keys):
        yield _batch(n, block=many([block] * n), spot=pa.array(np.arange(n), pa.int32()), key=pa.array(keys, pa.string()), freq=many(np.bincount(spots, minlength=n)))


def _summed(docs: pa.Table, worth: pa.Table) -> pa.Table:
    """The documents of a block with what their groups are worth."""
    docs, worth = docs.combine_chunks(), worth.combine_chunks()
    upto = int(pa.compute.max(worth["spot"]).as_py() or 0) + 1 if len(worth) else 0
    spots = np.concatenate([np.zeros(0, np.int64), *(c.flatten().to_numpy(zero_copy_only=False) for c in docs["spots"].chunks)]).astype(np.int64)
    times = np.concatenate([np.zeros(0, np.int64), *(c.flatten().to_numpy(zero_copy_only=False) for c in docs["times"].chunks)])
    ends = np.cumsum(pa.compute.list_value_length(docs["spots"]).to_numpy().astype(np.int64))
    out = {c: docs[c] for c in ("doc_id", "text_hash", "n_a", "n_b", "n_groups")}
    for name in ("n_links", "n_best", "count_sum"):
        of_spot = np.zeros(upto, np.int64)
        of_spot[worth["spot"].to_numpy()] = worth[name].to_numpy()
        total = np.concatenate([[0], np.cumsum(of_spot[spots] * times)])
        out[name] = pa.array(np.diff(total[np.concatenate([[0], ends])]), pa.int64())
    return pa.table(out | {"groups_sha256": docs["groups_sha256"]})


def align_tokens(docs: DataFrame, *, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: a row per document.

    A byte-level vocabulary (``a_path``) cuts space and text, a sentencepiece
    vocabulary (``b_path``), which adds the space, the text. Groups end where
    both end a token; links are the pairs of tokens that share bytes. The count
    of a pair of ids is the number of its links over all documents. ``n_best``
    are a document's links whose count no other pair with the same B id exceeds,
    ``count_sum`` is the sum of its links' counts. ``groups_sha256`` is the
    digest of the groups' ids in order (``a1,a2|b1;a3|b2,b3``).

    A text that is null or empty, or whose tokens on either side don't give
    back its bytes, has no tokens: zeros, and '' for the digest. Repeated rows
    count and come out each. Very long texts are encoded whole, in time about in
    proportion. Other columns are ignored; an empty table gives no rows.

    Slices of some megabytes of text intern their groups, so that a group that
    all documents have is one row a slice; nothing is gathered beyond a slice.
    """
    require(docs, id_col, text_col)
    shelf = Shelf(docs.sparkSession, "alignment")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, block = Pair.of(a_path, b_path), TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = batch["text"].to_pylist()
            size = np.cumsum([0, *(len(t or "") for t in texts)])
            at = 0
            while at < len(texts):
                upto = max(at + 1, int(np.searchsorted(size, size[at] + SLICE, side="right")) - 1)
                yield from code_slice(block, batch["doc_id"].slice(at, upto - at), batch["text_hash"].slice(at, upto - at), [t or "" for t in texts[at:upto]], pair)
                at, block = upto, block + 1

    def expand(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair = Pair.of(a_path, b_path)
        for part in parts:
            rows = [(key, freq, a, b, n) for key, freq in zip(part["key"], part["freq"], strict=True) for (a, b), n in pair.links(key).items()]
            yield pd.DataFrame(rows, columns=["key", "freq", "a", "b", "n"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    coded = shelf.put(rows.mapInArrow(code, "block long, doc_id long, text_hash long, n_a long, n_b long, n_groups long, groups_sha256 string, spots array<int>, times array<int>, spot int, key string, freq long"), "coded")
    texts = coded.filter("key IS NULL").select(F.col("block").alias("home"), "doc_id", "text_hash", "n_a", "n_b", "n_groups", "spots", "times", "groups_sha256")
    places = coded.filter("key IS NOT NULL").select("block", "spot", "key", "freq")
    groups = places.groupBy("key").agg(F.sum("freq").alias("freq"))
    expanded = shelf.put(groups.mapInPandas(expand, "key string, freq long, a int, b int, n long"), "links")
    pairs = expanded.groupBy("a", "b").agg(F.sum(F.col("freq") * F.col("n")).alias("count"))
    most = pairs.groupBy("b").agg(F.max("count").alias("most"))
    pairs = shelf.put(pairs.join(most, "b").withColumn("best", (F.col("count") == F.col("most")).cast("long")).drop("most"), "pairs")
    worth = expanded.join(pairs, ["a", "b"]).groupBy("key").agg(F.sum("n").alias("n_links"), F.sum(F.col("n") * F.col("best")).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    back = places.join(worth, "key").select("block", "spot", "n_links", "n_best", "count_sum")
    met = texts.groupBy("home").cogroup(back.groupBy("block"))
    return met.applyInArrow(_summed, "doc_id long, text_hash long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
