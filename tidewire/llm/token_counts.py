"""Token counts by a count-only Viterbi search over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary matches of a word; the
search carries the best score and its number of pieces for each position and
keeps no path. White space parts words, as the tokenizer does before its model,
so a word's count is the same wherever it stands and is worked out once.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import require, text_hash

#: Entries of a worker's word memory, beyond which it starts anew, and the longest word that it takes: together a bound
#: of some 100 MB. Longer words are worked out each time.
_MEMO, _LONGEST = 400_000, 48
#: The tokenizer's penalty for an unknown character, below the least score of the vocabulary.
UNKNOWN_PENALTY = 10.0
SPACE = "▁"


def load_vocabulary(path: str) -> list[tuple[str, float]]:
    """The pieces of a sentencepiece model with their scores, in id order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.vocab_size())]


class Counter:
    """Pieces and score of words under the tokenizer's rules.

    Of equal scores at a position the piece that starts first stays, as the
    tokenizer goes through the starts in order and asks for a better score. A
    character without a piece of its own is unknown at ``UNKNOWN_PENALTY``
    below the least score, and counts as one piece for each of its bytes.
    """

    def __init__(self, vocabulary: list[tuple[str, float]]):
        self.matcher = ahocorasick.Automaton()
        for piece, score in dict(vocabulary).items():
            if piece:
                self.matcher.add_word(piece, (len(piece), score))
        self.matcher.make_automaton()
        self.unknown = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        self.memo: dict[str, tuple[int, float]] = {}

    def word(self, word: str) -> tuple[int, float]:
        got = self.memo.get(word)
        if got is None:
            got = self._search(word)
            if len(word) <= _LONGEST:
                if len(self.memo) >= _MEMO:
                    self.memo.clear()
                self.memo[word] = got
        return got

    def _search(self, word: str) -> tuple[int, float]:
        n = len(word)
        score, pieces, done = [0.0] * (n + 1), [0] * (n + 1), 0

        def unknown(upto: int) -> None:
            """Close the positions before ``upto`` that no match has closed."""
            nonlocal done
            while done < upto:
                score[done + 1] = score[done] + self.unknown
                pieces[done + 1] = pieces[done] + len(word[done].encode("utf-8", "surrogatepass"))
                done += 1

        best, count, single = None, 0, False
        for end, (length, points) in self.matcher.iter(word):  # by end, the longest first
            if end > done:
                if best is not None:
                    done = self._close(word, score, pieces, done, best, count, single)
                    best, single = None, False
                unknown(end)
            total = score[end + 1 - length] + points
            if best is None or total > best:
                best, count = total, pieces[end + 1 - length] + 1
            single = single or length == 1
        if best is not None:
            done = self._close(word, score, pieces, done, best, count, single)
        unknown(n)
        return pieces[n], score[n]

    def _close(self, word, score, pieces, done, best, count, single) -> int:
        """Position ``done`` + 1 from its best match, or as unknown where that scores better."""
        if not single and (alone := score[done] + self.unknown) > best:
            best, count = alone, pieces[done] + len(word[done].encode("utf-8", "surrogatepass"))
        score[done + 1], pieces[done + 1] = best, count
        return done + 1


_COUNTERS: dict[str, Counter] = {}
_WORDS = regex.compile(f"{SPACE}[^{SPACE}]*|[^{SPACE}]+")


def counter(path: str) -> Counter:
    """One for each worker process."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(load_vocabulary(path))
    return _COUNTERS[path]


def count_text(text: str, word) -> tuple[int, float]:
    """Each space becomes the mark that starts a word; so does the text's start, if it isn't one."""
    if not text:
        return 0, 0.0
    if SPACE in text:
        marked = text.replace(" ", SPACE)
        words = _WORDS.findall(marked if marked[0] == SPACE else SPACE + marked)
    else:
        words = [SPACE + w for w in (text[1:] if text[0] == " " else text).split(" ")]
    found = [word(w) for w in words]
    return sum(n for n, _ in found), sum(s for _, s in found)


def token_counts(docs: DataFrame, *, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, n_tokens, score (of the best segmentation): a row per document.

    A null or empty text has no tokens and score 0. Repeated rows are counted
    each; other columns are ignored; an empty table gives no rows. Very long
    texts and words take time in proportion. There is no shuffle.
    """
    require(docs, id_col, text_col)

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        word = counter(vocabulary_path).word
        for part in parts:
            found = [count_text(t, word) for t in part.pop("text").fillna("")]
            yield part.assign(n_tokens=[n for n, _ in found], score=[s for _, s in found])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    return rows.mapInPandas(count, "doc_id long, text_hash long, n_tokens long, score double")
