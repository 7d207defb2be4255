"""Exact top-k inner products by aggregation of sorted lists without random access.

Vectors are dealt into blocks. In a block each dimension has a list of its
entries in order. The lists are read from both ends, a stretch of each at a
time: a query takes the upper end where its weight is positive, the lower where
it is negative. What was read of a vector, with what the rest of each list can
still give at least and at most, bounds its score from below and above, as
matrix products for many queries at once. When all but a few vectors are
bounded away from a query's best k, it stops, and the few are resolved.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Shelf, require

#: Numbers in a block of vectors and in a segment of it that has lists of its own; so a task's memory doesn't grow with the vectors' length.
BLOCK, SEGMENT = 1 << 20, 1 << 18
#: Queries that a block is met with at once, by the same measure.
QUERIES = 1 << 17
#: Parts of the lists that have been read after each stretch.
STRETCHES = (1 / 8, 1 / 4, 3 / 8, 1 / 2, 5 / 8, 3 / 4, 7 / 8, 1)
#: The reading ends when one vector in so many is left, or k.
FEW = 64
#: Queries whose bounds are worked out at once.
AT_ONCE = 256


class Lists:
    """The sorted lists of a segment's vectors, one list for each dimension."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.order = np.argsort(vectors, axis=0, kind="stable")
        self.sorted = np.take_along_axis(vectors, self.order, axis=0)

    def contenders(self, wants: np.ndarray, out: np.ndarray, k: int, floors: np.ndarray) -> np.ndarray:
        """For each row and query whether it may be among the k best; ``out`` marks pairs that take no part.

        ``floors`` has a score that k vectors read before have reached, for each
        query; it is raised to what k rows of this segment surely reach. Rows
        surely below it go, rows that may tie with the k-th stay.
        """
        (rows, dims), place = self.vectors.shape, np.arange(self.vectors.shape[1])
        up, down = np.maximum(wants, 0).T, np.minimum(wants, 0).T
        # Of each vector: what was read from the upper and the lower ends, and in which lists.
        seen = np.zeros((rows, 4 * dims), self.vectors.dtype)
        first, last = self.sorted[0][:, None], self.sorted[-1][:, None]
        alive, open_, read = ~out, np.arange(len(wants)), 0
        for part in STRETCHES:
            upto = math.ceil(part * rows)
            for end, stretch in ((0, slice(rows - upto, rows - read)), (1, slice(read, upto))):
                at = self.order[stretch]
                seen[at, place + end * dims] = self.sorted[stretch]
                seen[at, place + (2 + end) * dims] = 1
            read = upto
            # The next entries bound what the rest of a list gives from above, its far end does from below.
            upper, lower = (self.sorted[rows - 1 - read][:, None], self.sorted[read][:, None]) if read < rows else (first, last)
            u, d = up[:, open_], down[:, open_]
            high = (upper * u + lower * d).sum(0) + seen @ np.vstack([u, d, -upper * u, -lower * d])
            low = (first * u + last * d).sum(0) + seen @ np.vstack([u, d, -first * u, -last * d])
            if rows > k:
                low[~alive[:, open_]] = floors[open_].min()
                floors[open_] = np.maximum(floors[open_], np.partition(low, rows - k, axis=0)[rows - k])
            alive[:, open_] &= high >= floors[open_]
            open_ = open_[alive[:, open_].sum(0) > max(k, rows // FEW)]
            if not len(open_):
                break
        return alive


def _matrix(vectors: pd.Series, dims: int) -> np.ndarray:
    """One row for each vector; a shorter one ends in zeros."""
    if all(len(v) == dims for v in vectors):
        return np.array(vectors.tolist(), np.int64).reshape(len(vectors), dims)
    out = np.zeros((len(vectors), dims), np.int64)
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


def _most(vectors: np.ndarray) -> int:
    return max(int(vectors.max(initial=0)), -int(vectors.min(initial=0)))


def best_of_block(queries: pd.DataFrame, block: pd.DataFrame, k: int) -> pd.DataFrame:
    """query_no, vec_id, copies, score of each query's k best in the block, ties at the k-th among them cut by id.

    Whole numbers of 64 bits hold the sums where the largest entries leave room;
    else Python's numbers do, and a score beyond 64 bits is an error.
    """
    dims = max(1, *(len(v) for part in (queries, block) for v in part["vector"])) if len(queries) and len(block) else 1
    wants, has = _matrix(queries["vector"], dims), _matrix(block["vector"], dims)
    # Float sums of whole numbers below 2 ** 53 are exact, and products of matrices run on them fastest.
    room = 8 * dims * max(1, _most(wants)) * max(1, _most(has))
    kind = np.float64 if room < 2**53 else np.int64 if room < 2**63 else object
    wants, has = wants.astype(kind), has.astype(kind)
    ids, no_id, copies = (block[c].to_numpy() for c in ("id", "no_id", "copies"))
    spots = {no: spot for spot, no in enumerate(block["no"])}
    own = np.array([spots.get(no, -1) for no in queries["no"]])
    size = max(1, SEGMENT // dims)
    segments = [(at, Lists(has[at : at + size])) for at in range(0, len(has), size)]
    found = []
    for begin in range(0, len(wants), AT_ONCE):
        some = slice(begin, begin + AT_ONCE)
        alone = [spot if spot >= 0 and copies[spot] == 1 else -1 for spot in own[some]]  # a query isn't its own candidate, its other copies are
        floors = np.full(len(alone), -room, kind)  # below any score
        best = [(np.zeros(0, np.int64), np.zeros(0, kind))] * len(alone)
        for at, lists in segments:
            out = np.zeros((len(lists.vectors), len(alone)), bool)
            for q, spot in enumerate(alone):
                if at <= spot < at + len(out):
                    out[spot - at, q] = True
            alive = lists.contenders(wants[some], out, k, floors)
            for q, weights in enumerate(wants[some]):
                more = np.flatnonzero(alive[:, q])
                if len(more):
                    rows, scores = np.concatenate([best[q][0], more + at]), np.concatenate([best[q][1], lists.vectors[more] @ weights])
                    # The best k so far: by score, then by id, rows without one last.
                    order = np.lexsort((ids[rows], no_id[rows], -scores)) if kind is not object else sorted(range(len(rows)), key=lambda i: (-scores[i], no_id[rows[i]], ids[rows[i]]))
                    first = np.asarray(order[:k], np.int64)
                    best[q] = rows[first], scores[first]
                    if len(first) == k:
                        floors[q] = max(floors[q], best[q][1][-1])
        if kind is object and any(abs(x) >= 2**63 for _, scores in best for x in scores):
            raise OverflowError("a score doesn't fit 64 bits")
        rows, scores = (np.concatenate([b[i] for b in best]) for i in (0, 1))
        asked = np.repeat(np.arange(begin, begin + len(alone)), [len(b[0]) for b in best])
        left = copies[rows] - (rows == own[asked])
        found.append(pd.DataFrame({"query_no": queries["no"].to_numpy()[asked], "vec_id": pd.arrays.IntegerArray(ids[rows].astype(np.int64), no_id[rows].astype(bool)), "copies": left, "score": scores.astype(np.int64)}))
    return pd.concat(found) if found else pd.DataFrame({"query_no": [], "vec_id": [], "copies": [], "score": []})


def quantised(vector: Column, scale: int) -> Column:
    """Each component times ``scale``, rounded down; null where the vector or a component is null, or a component isn't finite."""
    values = vector.cast("array<double>")
    good = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(good, F.transform(values, lambda x: F.floor(x * F.lit(float(scale))).cast("long")))


def top_inner_products(vectors: DataFrame, *, k: int = 5, query_every: int = 50, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id ``query_every`` divides, its k best among all other rows.

    Components are scaled and rounded down (``quantised``), scores are exact
    inner products of those whole numbers. Ties go to the smaller id, a null id
    last; with fewer than k others, all are returned. A vector that is null, or
    holds a null or a component that isn't finite, takes no part. Vectors of
    unequal length meet as if the shorter ended in zeros; one without components
    scores 0. Equal rows are rows of their own: each is a candidate of the
    others, and as a query has its own k rows. An empty table gives no rows;
    other columns are ignored. A score that doesn't fit 64 bits is an error.

    Blocks of ``BLOCK`` numbers meet blocks of queries, each pair in a task; a
    block gives k rows for each of its queries, of which the best k stay.
    """
    require(vectors, id_col, vector_col)
    shelf = Shelf(vectors.sparkSession, "topk")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col), scale).alias("vector")).filter("vector IS NOT NULL")
    # Equal rows are one with a number of copies: so a vector that fills the table is small, and a row has a number of its own.
    rows = rows.groupBy("vec_id", "vector").agg(F.count("*").alias("copies"))
    rows = shelf.put(rows.withColumns({"no": F.concat_ws("/", F.coalesce(F.col("vec_id").cast("string"), F.lit("-")), F.sha2(F.to_json("vector"), 256)), "deal": F.xxhash64("vec_id", "vector")}), "rows")
    wanted = F.col("vec_id") % query_every == 0
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dims"), F.count_if(wanted).alias("queries")).first()
    dims = max(1, size["dims"] or 1)
    blocks, sets = (max(1, math.ceil(n / max(1, room // dims))) for n, room in ((size["n"], BLOCK), (size["queries"], QUERIES)))

    def dealt(df: DataFrame, own: str, of: int, other: str, others: int) -> DataFrame:
        return df.withColumn(own, F.pmod("deal", F.lit(of)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    asked = dealt(rows.filter(wanted), "query_set", sets, "block", blocks).select("query_set", "block", "no", "vector")
    offered = dealt(rows, "block", blocks, "query_set", sets).select("query_set", "block", "no", F.coalesce("vec_id", F.lit(0)).alias("id"), F.col("vec_id").isNull().alias("no_id"), "copies", "vector")
    met = asked.groupBy("query_set", "block").cogroup(offered.groupBy("query_set", "block"))
    found = met.applyInPandas(lambda q, b: best_of_block(q, b, k) if len(q) and len(b) else best_of_block(q[:0], b[:0], k), "query_no string, vec_id long, copies long, score long")
    one_each = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k).cast("long"))))).drop("copies", "copy")
    order = Window.partitionBy("query_no").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    best = one_each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    times = rows.filter(wanted).select(F.col("no").alias("query_no"), F.col("vec_id").alias("query_id"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    return best.join(times, "query_no").select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT row_number() OVER () AS no, vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.no, a.vec_id AS query_id, b.vec_id, CAST(list_sum([p[1] * p[2] FOR p IN list_zip(a.q, b.q)]) AS BIGINT) AS score
      FROM v a JOIN v b ON a.no <> b.no WHERE a.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY no ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
