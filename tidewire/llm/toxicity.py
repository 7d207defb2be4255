"""Severity of toxic text by cumulative-link ordinal regression on sparse word features.

The grades are those of the labels, 0 to ``GRADES`` at most, and nothing else
makes one: labels of two grades give one cut and a severity between 0 and 1.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import require, text_hash

#: The highest grade; labels above it count as it.
GRADES = 3
_WORD = re.compile(r"\w+").findall


@dataclass
class OrdinalModel:
    """P(grade > k) = sigmoid(w x - cut_k): one weight vector for all of the ordered cuts."""

    words: dict[str, int]
    weights: np.ndarray
    cuts: np.ndarray

    def exceed(self, text: str | None) -> np.ndarray:
        """P(grade > k) for each cut."""
        hits = self.words.keys() & set(_WORD(text.lower())) if text else ()
        # Summed in a fixed order, so that equal texts have equal scores.
        score = math.fsum(self.weights[self.words[w]] for w in hits)
        return 1 / (1 + np.exp(np.clip(self.cuts - score, -500, 500)))


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, n_words: int, *, penalty: float = 0.1, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered cuts of least penalized loss, by Adam steps over all rows. rows: the words of each row."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate([*rows, np.empty(0, int)]).astype(int)
    top = max(1, int(grades.max(initial=0)))
    share = np.array([(np.sum(grades <= k) + 0.5) / (len(grades) + 1) for k in range(top)])
    first = np.log(share / (1 - share))
    x = np.concatenate([np.zeros(n_words), first[:1], np.log(np.maximum(np.diff(first), 1e-2))])
    m, v = np.zeros_like(x), np.zeros_like(x)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    for step in range(1, steps + 1):
        w, gaps = x[:n_words], np.exp(x[n_words + 1 :])
        cuts = x[n_words] + np.concatenate([[0.0], np.cumsum(gaps)])
        s = np.bincount(at, w[col], len(rows))
        wide = np.concatenate([[-50.0], cuts, [50.0]])
        hi, lo = sig(wide[grades + 1] - s), sig(wide[grades] - s)
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / p, -lo * (1 - lo) / p  # of the log likelihood, by each cut
        grad_w = np.bincount(col, (d_hi + d_lo)[at], n_words) + penalty * w
        by_cut = np.bincount(grades + 1, d_hi, top + 2)[1 : top + 1] + np.bincount(grades, d_lo, top + 2)[1 : top + 1]
        g = np.concatenate([grad_w, [-by_cut.sum()], -np.cumsum(by_cut[::-1])[::-1][1:] * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - 0.1 * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return x[:n_words], x[n_words] + np.concatenate([[0.0], np.cumsum(np.exp(x[n_words + 1 :]))])


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = 20_000, max_words: int = 4096, min_docs: int = 5, least_z: float = 3.0) -> OrdinalModel:
    """Fit on at most ``fit_rows`` labelled documents, a fixed sample by hash of the id.

    Labels are the grades: 0 for none, up to ``GRADES``; of several labels of
    an id the highest counts, and of several texts that of least hash. There is
    a cut below each grade up to the highest that occurs, and one weight for
    each word over all cuts. Features are the ``max_words`` words (in
    ``min_docs`` rows at least) whose rates differ most between grade 0 and the
    rest, at a z score of ``least_z`` or more. Without labels of both sorts
    every text gets the grade that there is (0 if none).
    """
    require(docs, id_col, text_col)
    require(labels, id_col, label_col)
    marks = labels.select(F.col(id_col).cast("long").alias("l_id"), F.col(label_col).cast("int").alias("label")).filter("l_id IS NOT NULL AND label IS NOT NULL").groupBy("l_id").agg(F.max("label").alias("label"))
    marks = marks.orderBy(F.xxhash64("l_id"), "l_id").limit(fit_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(F.col(text_col)).alias("mark"), F.col(text_col).alias("text"))
    # The sample is bounded by fit_rows.
    rows = texts.join(F.broadcast(marks), F.col("doc_id") == F.col("l_id")).select("l_id", "label", "mark", "text")

    def words_of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"id": part["l_id"], "label": part["label"], "mark": part["mark"], "words": [sorted(set(_WORD(t.lower()))) if t else [] for t in part["text"]]})

    each = rows.mapInPandas(words_of, "id long, label int, mark long, words array<string>")
    sample = each.groupBy("id").agg(F.first("label").alias("label"), F.min_by("words", "mark").alias("words")).persist()
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy((F.col("label") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        sample.unpersist()
        return OrdinalModel({}, np.zeros(0), np.full(1, 50.0 if not n1 else -50.0))
    counts = sample.select(F.explode("words").alias("word"), (F.col("label") > 0).cast("int").alias("toxic")).groupBy("word").agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).filter(F.col("n") >= min_docs)
    a, b = (F.col("t") + 0.5) / (n1 + 1.0), (F.col("n") - F.col("t") + 0.5) / (n0 + 1.0)
    z = (F.log(a) - F.log(b)) / F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("n") - F.col("t") + 0.5))
    best = counts.withColumn("z", z).filter(F.abs("z") >= least_z).orderBy(F.desc(F.abs("z")), "word").limit(max_words).collect()
    words = {r["word"]: i for i, r in enumerate(sorted(best, key=lambda r: r["word"]))}
    names = F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")
    held = sample.select("id", "label", F.array_intersect("words", names).alias("words")).orderBy("id").collect()  # fit_rows at most
    sample.unpersist()
    hits = [np.array(sorted(words[w] for w in r["words"]), int) for r in held]
    grades = np.array([max(0, min(r["label"], GRADES)) for r in held])
    weights, cuts = fit_ordinal(hits, grades, len(words))
    return OrdinalModel(words, weights, cuts)


def score_toxicity(docs: DataFrame, model: OrdinalModel, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, text_hash, expected_severity (0 to the highest grade of the labels), grade (the likeliest), p_toxic, toxic: a row per document.

    ``toxic`` holds where P(grade > 0) reaches ``threshold``. Null and empty
    texts have no words and get the score of such. Repeated rows are scored
    each, null ids pass on, other columns are ignored, an empty table gives no
    rows. Nothing is shuffled.
    """
    require(docs, id_col, text_col)

    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            over = np.array([model.exceed(t) for t in part.pop("text")]).reshape(-1, len(model.cuts))
            each = -np.diff(np.concatenate([np.ones((len(over), 1)), over, np.zeros((len(over), 1))], axis=1), axis=1)
            yield part.assign(expected_severity=over.sum(axis=1), grade=each.argmax(axis=1), p_toxic=over[:, 0], toxic=over[:, 0] >= threshold)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    return rows.mapInPandas(score, "doc_id long, text_hash long, expected_severity double, grade int, p_toxic double, toxic boolean")
