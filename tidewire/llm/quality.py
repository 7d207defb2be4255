"""Document quality by co-training two views: the text's content, and the page's metadata.

The content view has the words, hashed, and the text's form; the metadata view
has source, language and the length that the page states, which the content
view leaves out.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, FloatType, StructField, StructType

from .common import Shelf, columns_of, require, text_hash

#: Buckets that sources and languages are hashed to.
SOURCES, LANGUAGES = 32, 8
#: Buckets that words are hashed to, and entries of a worker's memory of them.
WORDS, _MEMO = 2048, 100_000
#: Lengths beyond which a page counts as longer, in logarithms.
STEPS = (4.0, 5.0, 6.0, 7.0, 8.0, 9.0, 10.0)
#: Measures of a text's form, and of a page.
FORM, PAGE = 20, 2 + len(STEPS) + SOURCES + LANGUAGES
#: Rows whose features are unpacked at once, 8 KB each.
ROWS = 512
#: Pulls to zero among which the labelled documents choose.
PULLS = (0.001, 0.003, 0.01, 0.03, 0.1)
#: Labelled rows on which the pull is chosen, and the parts that they are left out by in turn.
_CHOOSE, _PARTS = 3_000, 4
#: Log odds of a probability of 1 - 1e-6, the most that a view brings to the last regression.
_MOST_ODDS = float(np.log(1e6 - 1))
_BYTES = np.zeros((8, 256))
for _row, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n", b".,;:!?'\"()-", b"|/\\_=<>[]{}", b"#$%&*+@^~`")):
    _BYTES[_row, list(_chars)] = 1


_SPOTS: dict[bytes, int] = {}


def _spot(word: bytes) -> int:
    """The bucket of a word without case and the marks around it."""
    at = xxhash.xxh3_64_intdigest(word.lower().strip(b".,;:!?'\"()-")) % WORDS
    if len(word) <= 48:
        if len(_SPOTS) >= _MEMO:
            _SPOTS.clear()
        _SPOTS[word] = at
    return at


def content(text: str | None) -> tuple[list[float], list[int]]:
    """What the text looks like (shares of kinds of bytes, repetition of words and lines, lengths of words) and the buckets of its words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * FORM, []
    shares = _BYTES @ np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / len(raw)
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), float, len(words))
    lines = raw.split(b"\n")
    pairs = len(set(zip(words, words[1:])))
    known = _SPOTS.get
    spots = {at if (at := known(w)) is not None else _spot(w) for w in counts}
    return [
        *shares,
        1 - shares.sum(),
        len(counts) / len(words),
        np.log(len(counts)) / (1 + np.log(len(words))),
        max(counts.values()) / len(words),
        pairs / max(1, len(words) - 1),
        lengths.mean(),
        lengths.std(),
        min(lengths.max(), 200.0),
        np.log1p(len(words) / len(lines)),
        len(set(lines)) / len(lines),
        sum(not w[-1:].isalpha() and w[-1] < 128 for w in words) / len(words),
        sum(w.isupper() for w in words) / len(words),
    ], sorted(spots)


def _packed(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Form and words of texts; the words as bits, one for each bucket."""
    forms, words = [], []
    for at in range(0, len(texts), ROWS):
        for text in texts.slice(at, ROWS).to_pylist():
            form, spots = content(text)
            bits = np.zeros(WORDS, np.uint8)
            bits[spots] = 1
            forms.append(np.asarray(form, np.float32))
            words.append(np.packbits(bits).tobytes())
    return pa.array(forms, pa.list_(pa.float32())), pa.array(words, pa.binary())


@F.arrow_udf(StructType([StructField("form", ArrayType(FloatType())), StructField("words", BinaryType())]))
def _content(texts: pa.Array) -> pa.Array:
    return pa.StructArray.from_arrays(_packed(texts), names=["form", "words"])


def _bucket(value: Column, n: int, seed: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.coalesce(value.cast("string"), F.lit(""))), F.lit(n)).cast("int")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row (all columns as one, so that no name clashes), doc_id, text_hash."""
    rows = docs.select(F.struct(*columns_of(docs)).alias("row"))
    return rows.withColumns({"doc_id": F.col(f"row.`{id_col}`").cast("long"), "text_hash": text_hash(F.col(f"row.`{text_col}`"))})


def _viewed(rows: DataFrame, columns: list[str], text_col: str) -> DataFrame:
    """The rows with both views, packed: form and words of the content; length, source and language of the page. Nothing is shuffled."""
    made = rows.withColumn("content", _content(F.col(f"row.`{text_col}`")))
    return made.withColumns({"form": F.col("content.form"), "words": F.col("content.words"), **_page(columns)}).drop("content")


def _page(columns: list[str]) -> dict[str, Column]:
    column = lambda c: F.col(f"row.{c}") if c in columns else F.lit(None)
    size = F.log1p(F.greatest(F.coalesce(column("n_chars").cast("double"), F.lit(0.0)), F.lit(0.0)))
    return {"size": size, "source": _bucket(column("source"), SOURCES, "source"), "lang": _bucket(column("lang"), LANGUAGES, "lang")}


def _floats(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.array(column.to_pylist(), np.float32)


def unpack(views: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The features of both views, a row each, with a 1 at the end for the constant."""
    n = views.num_rows
    text, page = np.ones((n, FORM + WORDS + 1), np.float32), np.zeros((n, PAGE + 1), np.float32)
    column = lambda c, kind: np.array(views[c].to_pylist(), kind)
    if n:
        text[:, :FORM] = column("form", np.float32)
        text[:, FORM:-1] = np.unpackbits(np.frombuffer(b"".join(views["words"].to_pylist()), np.uint8).reshape(n, -1), axis=1)
        size, at = column("size", np.float32), 2 + len(STEPS)
        page[:, 0], page[:, 1] = size, size * size / 10
        page[:, 2:at] = size[:, None] > np.array(STEPS)
        page[np.arange(n), at + column("source", int)] = 1
        page[np.arange(n), at + SOURCES + column("lang", int)] = 1
    page[:, -1] = 1
    return text, page


def _slices(views: pa.RecordBatch | pa.Table) -> Iterator[pa.RecordBatch | pa.Table]:
    return (views.slice(at, ROWS) for at in range(0, views.num_rows, ROWS))


def loss_sums(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Of some rows the logistic loss, their number, and the gradient."""
    odds = (x @ weights.astype(np.float32)).astype(np.float64)
    error = _sigmoid(odds) - y
    return np.concatenate([[(np.logaddexp(0, odds) - y * odds).sum(), len(y)], x.T @ error.astype(np.float32)])


def _sigmoid(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def minimise(objective: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, steps: int, least: float = 1e-5) -> np.ndarray:
    """L-BFGS with a backtracking line search; ``objective`` gives value and gradient."""
    x, (value, slope), pairs = start, objective(start), []
    for _ in range(steps):
        d, alphas = -slope, []
        for s, y, rho in reversed(pairs):
            alphas.append(rho * (s @ d))
            d = d - alphas[-1] * y
        if pairs:
            s, y, _ = pairs[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y, rho), alpha in zip(pairs, reversed(alphas), strict=True):
            d = d + (alpha - rho * (y @ d)) * s
        step, down = (1.0 if pairs else min(1.0, 1 / max(1e-12, np.abs(slope).sum()))), slope @ d
        for _ in range(12):
            new = x + step * d
            new_value, new_slope = objective(new)
            if new_value <= value + 1e-4 * step * down:
                break
            step /= 2
        else:
            return x
        s, y = new - x, new_slope - slope
        if s @ y > 1e-12:
            pairs = [*pairs[-7:], (s, y, 1 / (s @ y))]
        done = value - new_value < least * max(1e-9, abs(new_value))
        x, value, slope = new, new_value, new_slope
        if done:
            break
    return x


@dataclass(frozen=True)
class Scale:
    """Spreads of a view's features: weights are pulled to zero by what they move, and the constant is free."""

    spread: np.ndarray
    pull: float

    def whole(self, sums: np.ndarray, weights: np.ndarray) -> tuple[float, np.ndarray]:
        """Value and gradient of mean loss and pull."""
        moved = weights * self.spread
        return sums[0] / sums[1] + self.pull / 2 * (moved @ moved), sums[2:] / sums[1] + self.pull * moved * self.spread


class Sample:
    """One view of labelled rows on the driver: words stay packed, and are widened to floats a slice at a time."""

    def __init__(self, rows: pa.Table, view: int, y: np.ndarray):
        self.parts, self.y = [], y
        for part in _slices(rows):
            x = unpack(part)[view]
            self.parts.append((x[:, :FORM].copy(), np.packbits(x[:, FORM:-1].astype(np.uint8), axis=1)) if view == 0 else (x, None))

    def slices(self) -> Iterator[np.ndarray]:
        for x, bits in self.parts:
            yield x if bits is None else np.hstack([x, np.unpackbits(bits, axis=1), np.ones((len(x), 1), np.uint8)], dtype=np.float32)

    def sums(self, weights: np.ndarray) -> np.ndarray:
        bounds = np.cumsum([0, *(len(a) for a, _ in self.parts)])
        return sum(loss_sums(x, self.y[i:j], weights) for x, i, j in zip(self.slices(), bounds, bounds[1:]))

    def spread(self) -> np.ndarray:
        """How far each measure spreads; words and marks of a kind are 0 or 1 as they are, so that rare ones don't weigh more; the constant doesn't."""
        once, twice = (sum((x.astype(np.float64) ** k).sum(0) for x in self.slices()) / len(self.y) for k in (1, 2))
        out = np.sqrt(np.maximum(twice - once**2, 0))
        out[FORM if len(out) > PAGE + 1 else 2 : -1] = 1
        return out

    def fit(self, scale: Scale, steps: int = 40) -> np.ndarray:
        return minimise(lambda w: scale.whole(self.sums(w), w), np.zeros(len(scale.spread)), steps)


@dataclass(frozen=True)
class QualityModel:
    """The two views' weights and the regression that weighs their log odds; or, where there was nothing to learn, one share for all."""

    by_text: np.ndarray | None = None
    by_page: np.ndarray | None = None
    last: np.ndarray | None = None
    share: float = 1.0

    def odds(self, views: pa.RecordBatch | pa.Table) -> list[np.ndarray]:
        parts = [[x @ w.astype(np.float32) for x, w in zip(unpack(part), (self.by_text, self.by_page))] for part in _slices(views)]
        return [np.clip(np.concatenate([np.zeros(0), *(p[k] for p in parts)]), -_MOST_ODDS, _MOST_ODDS) for k in (0, 1)]

    def probabilities(self, views: pa.RecordBatch | pa.Table) -> pa.Array:
        odds = self.odds(views)
        total = self.last[0] * odds[0] + self.last[1] * odds[1] + self.last[2]
        return pa.StructArray.from_arrays([pa.array(_sigmoid(x)) for x in (*odds, total)], names=list(_SCORES))

    def _scored(self, df: DataFrame, first: list[Column], page: list[Column], pack: Callable) -> DataFrame:
        """Adds the scores, of texts or packed views, in one pass without a shuffle."""
        if self.last is None:
            return df.withColumns(dict.fromkeys(_SCORES, F.lit(self.share)))
        own = self

        @F.arrow_udf(StructType([StructField(c, DoubleType()) for c in _SCORES]))
        def scores(*parts: pa.Array) -> pa.Array:
            return own.probabilities(pa.table([*pack(*parts[:-3]), *parts[-3:]], names=list(_VIEWS)))

        scored = df.withColumn("scores", scores(*first, *page))
        return scored.withColumns({c: F.col(f"scores.{c}") for c in _SCORES}).drop("scores")

    def score(self, viewed: DataFrame) -> DataFrame:
        """p_text, p_page and quality in place of packed views."""
        cols = [F.col(c) for c in _VIEWS]
        return self._scored(viewed, cols[:2], cols[2:], lambda *packed: packed).drop(*_VIEWS)

    def score_rows(self, rows: DataFrame, columns: list[str], text_col: str) -> DataFrame:
        """p_text, p_page and quality beside the rows; a text's views are made and scored in one go."""
        return self._scored(rows, [F.col(f"row.`{text_col}`")], list(_page(columns).values()), _packed)


#: What a packed view has, and what becomes of it.
_VIEWS, _SCORES = ("form", "words", "size", "source", "lang"), ("p_text", "p_page", "quality")
#: Sums over documents are added as whole numbers of this part of one, so that they don't depend on the order of the tasks.
_PART = 2.0**20


def _taught(views: DataFrame, model: QualityModel, confident: float, tried: list[np.ndarray]) -> list[np.ndarray]:
    """Loss sums of both views at the weights that are ``tried``, over all documents on which the other view of ``model`` is confident."""
    sure = math.log(confident / (1 - confident))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(2 + len(w)) for w in tried]
        for batch in batches:
            for part in _slices(batch):
                both = unpack(part)
                odds = [x @ w.astype(np.float32) for x, w in zip(both, (model.by_text, model.by_page))]
                for k, x in enumerate(both):
                    teacher, pupil = odds[1 - k], odds[k]
                    chosen = ((teacher >= sure) & (pupil > -sure)) | ((teacher <= -sure) & (pupil < sure))
                    if chosen.any():
                        sums[k] += loss_sums(x[chosen], (teacher[chosen] > 0).astype(float), tried[k])
        yield pa.RecordBatch.from_arrays([pa.array([np.rint(np.concatenate(sums) * _PART).astype(np.int64)])], names=["sums"])

    parts = views.select("form", "words", "size", "source", "lang").mapInArrow(partial, "sums array<long>")
    total = parts.select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("total")).orderBy("pos").collect()  # one row for each weight
    out = np.array([r["total"] for r in total], float) / _PART if total else np.zeros(sum(2 + len(w) for w in tried))
    return np.split(out, [2 + len(tried[0])])


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    rounds: int = 2,
    confident: float = 0.97,
    pseudo_weight: float = 0.1,
    held_out: int = 4,
    fit_rows: int = 40_000,
    steps: int = 6,
) -> tuple[QualityModel, DataFrame]:
    """The model, and the documents' packed views (doc_id, text_hash and what ``QualityModel.score`` takes), written.

    Two logistic classifiers start from the labelled documents. In each round
    every document without a label in the fit on which one view is confident,
    and which the other view doesn't place as surely on the other side, teaches
    the other view at ``pseudo_weight``; each view then goes up to ``steps``
    further, every step a pass over the packed views of all documents. One
    labelled document in ``held_out``, by hash of its id, teaches neither view:
    on those a last regression weighs and calibrates the views' log odds. Where
    they are not of both classes, all labelled documents serve both ends. How
    strongly weights are pulled to zero is chosen by leaving out quarters of
    the teachers in turn.

    The labelled part is a sample by hash of id, of ``fit_rows`` labels, all
    where there are fewer; its packed views (some 400 bytes each) are gathered
    on the driver. The pseudo-labels are not sampled; there repeated rows count
    each. Of several texts with a labelled id the one with the least hash is in
    the sample and the others teach nothing. Of several labels of an id the
    least counts, null labels and ids are ignored. Without labels of both classes there is nothing to learn, and the
    model gives all documents the share of good labels (1 if none).
    """
    require(docs, id_col, text_col)
    require(labels, id_col, label_col)
    shelf = Shelf(docs.sparkSession, "quality")
    marks = labels.select(F.col(id_col).cast("long").alias("l_id"), F.col(label_col).cast("double").alias("label")).filter("l_id IS NOT NULL AND label IS NOT NULL")
    marks = marks.groupBy("l_id").agg((F.min("label") > 0).cast("double").alias("label"))
    share = round(2**20 * min(1.0, fit_rows / max(1, marks.count())))
    picked = marks.filter(F.pmod(F.xxhash64(F.lit("fit"), "l_id"), F.lit(2**20)) < share)
    held = F.pmod(F.xxhash64(F.lit("held"), "l_id"), F.lit(held_out)) == 0
    picked = shelf.put(picked.withColumn("held", held), "picked")
    if picked.count() <= 2 * fit_rows:  # a sample of fit_rows; more would be odd, and is joined by a shuffle
        picked = F.broadcast(picked)
    viewed = _viewed(_rows(docs, id_col, text_col), docs.columns, text_col).drop("row")
    views = shelf.put(viewed.join(picked, F.col("doc_id") == F.col("l_id"), "left").drop("l_id"), "views")
    first = F.min_by(F.struct("label", "held", "form", "words", "size", "source", "lang"), "text_hash").alias("own")
    known = views.filter("label IS NOT NULL").groupBy("doc_id").agg(first)
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").select("own.*").toArrow()  # a sample of fit_rows labels
    y, out = np.array(known["label"].to_pylist(), float), np.array(known["held"].to_pylist(), bool)
    if len(set(y)) < 2:
        return QualityModel(share=float(y.mean()) if len(y) else 1.0), views
    if len(set(y[out])) < 2 or len(set(y[~out])) < 2:
        teach = calm = np.ones(len(y), bool)
    else:
        teach, calm = ~out, out
    samples, scales = [], []
    for view in (0, 1):
        some = np.flatnonzero(teach)[:_CHOOSE]
        spread = Sample(known.take(pa.array(some)), view, y[some]).spread()
        loss = dict.fromkeys(PULLS, 0.0)
        for part in range(_PARTS):
            inside = np.arange(len(some)) % _PARTS != part
            fitted, asked = (Sample(known.take(pa.array(rows)), view, y[rows]) for rows in (some[inside], some[~inside]))
            if len(fitted.y) and len(asked.y):
                for pull in PULLS:
                    loss[pull] += asked.sums(fitted.fit(Scale(spread, pull)))[0]
        scales.append(Scale(spread, min(loss, key=loss.get)))
        samples.append(Sample(known.filter(pa.array(teach)), view, y[teach]))
    model = QualityModel(*(sample.fit(scale) for sample, scale in zip(samples, scales)))
    others = views.filter("label IS NULL")
    for _ in range(rounds):

        def objective(both: np.ndarray, model: QualityModel = model) -> tuple[float, np.ndarray]:
            tried = np.split(both, [len(model.by_text)])
            pseudo = _taught(others, model, confident, tried)
            parts = [scale.whole(sample.sums(w) + pseudo_weight * sums, w) for scale, sample, sums, w in zip(scales, samples, pseudo, tried)]
            return sum(value for value, _ in parts), np.concatenate([slope for _, slope in parts])

        start = np.concatenate([model.by_text, model.by_page])
        model = QualityModel(*np.split(minimise(objective, start, steps, 1e-3), [len(model.by_text)]))
    odds = np.stack([*model.odds(known.filter(pa.array(calm))), np.ones(calm.sum())], axis=1)
    scale = Scale(np.array([1.0, 1.0, 0.0]), 1e-3)
    last = minimise(lambda w: scale.whole(loss_sums(odds, y[calm], w), w), np.array([0.5, 0.5, 0.0]), 60)
    return QualityModel(model.by_text, model.by_page, last), views


def score_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, **how) -> DataFrame:
    """doc_id, text_hash, p_text, p_page, quality, keep: a row per document.

    ``fit_quality`` (which takes ``how``) trains; then all documents are scored,
    and ``keep`` holds where quality reaches ``threshold``. Null and empty texts
    have a form of zeros. Columns source, lang and n_chars may be missing or
    null. Repeated rows are scored each; other columns are ignored; an empty
    table gives no rows.
    """
    model, views = fit_quality(docs, labels, id_col=id_col, text_col=text_col, **how)
    return model.score(views).select("doc_id", "text_hash", "p_text", "p_page", "quality", (F.col("quality") >= threshold).alias("keep"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, **how) -> DataFrame:
    """The documents that ``score_quality`` keeps, with all their columns and repeated rows; a pass without a shuffle or join."""
    model, _ = fit_quality(docs, labels, id_col=id_col, text_col=text_col, **how)
    return model.score_rows(_rows(docs, id_col, text_col), docs.columns, text_col).filter(F.col("quality") >= threshold).select("row.*")
