"""Repeated passages by overlapping windows of three lines, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_of, per_salt, require, salt_of, salts_met, text_hash, unused

LINES = 3


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _windows(text: Column) -> Column:
    """array<struct<pos, k1, k2>>: the windows that aren't blank, with 128 bits of hash.

    The lines are bound once by the outer transform; a plain column in the
    inner function would be split anew for every window.
    """

    def keyed(lines: Column) -> Column:
        def at(i: Column) -> Column:
            three = [F.trim(F.get(lines, i + k)) for k in range(LINES)]
            blank = F.concat(*three) == ""
            return F.struct(i.alias("pos"), F.when(~blank, F.xxhash64(*three)).alias("k1"), F.xxhash64(F.lit("second"), *three).alias("k2"))

        some = F.size(lines) >= LINES
        places = F.when(some, F.sequence(F.lit(0), F.size(lines) - LINES)).otherwise(F.array().cast("array<int>"))
        return F.filter(F.transform(places, at), lambda w: w["k1"].isNotNull())

    return F.flatten(F.transform(F.array(_lines(text)), keyed))


def _covered(positions: Column) -> Column:
    """The lines that windows at these positions cover, each once."""
    return F.array_distinct(F.flatten(F.transform(positions, lambda p: F.array(*[p + k for k in range(LINES)]))))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove the lines of every later occurrence of a window of three consecutive lines.

    Lines are compared without spaces at their ends; windows of blank lines
    don't count, nor do texts of fewer than three lines have any. Of all
    occurrences in all documents the first in the order (id, text hash,
    position) stays, ids that are null last; the lines that later ones cover
    are merged and removed, also where a text repeats within itself. Rows that
    repeat an id and its text are later occurrences of their first, by a hash
    of their other columns.

    Returns the input with ``text_col`` cleaned (null becomes empty) and the
    new columns line_count and lines_removed; other columns pass through. An
    empty table gives an empty one.
    """
    require(docs, id_col, text_col)
    out = columns_of(docs, text_col, "line_count", "lines_removed")
    kind, row, hash_, spots, gone = keys = unused(docs, "kind", "row", "hash", "spots", "gone")
    # Texts without three lines lose nothing, repeated or not: each is a group of its own, so that no group of them is large.
    brief = F.size(_lines(F.col(text_col))) < LINES
    number = F.monotonically_increasing_id()
    keyed = docs.withColumns(
        {
            kind: F.when(brief, 2).when(F.col(id_col).isNull(), 1).otherwise(0),
            row: F.when(brief, number).otherwise(F.coalesce(F.col(id_col).cast("long"), F.lit(0))),
            hash_: F.when(brief, F.lit(0).cast("long")).otherwise(text_hash(F.col(text_col))),
        }
    )
    own = keyed.select(F.col(kind).alias("kind"), F.col(row).alias("row"), F.col(hash_).alias("hash"), F.col(text_col).alias("text")).filter("kind < 2")
    each = own.select("kind", "row", "hash", F.explode(_windows(F.col("text"))).alias("w")).select("kind", "row", "hash", "w.pos", "w.k1", "w.k2")
    place = F.struct("kind", "row", "hash", "pos")
    # A salt deals the occurrences of a common window out to several tasks; the bits tell which of them it needs.
    each = each.withColumn("salt", salt_of(F.col("hash")))
    firsts = each.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.count("*").alias("c"), salts_met(F.col("salt")).alias("bits")).filter("c > 1")
    firsts = per_salt(firsts.select("k1", "k2", "first", "bits"), "bits", "salt")
    later = each.join(firsts, ["k1", "k2", "salt"]).filter(place != F.col("first"))
    marks = later.groupBy(F.col("kind").alias(kind), F.col("row").alias(row), F.col("hash").alias(hash_)).agg(F.collect_set("pos").alias(spots))

    # One shuffle of the texts serves the join and the count of repeated rows.
    joined = keyed.join(marks, keys[:3], "left")
    rest = [F.to_json(F.struct(f"`{c}`")) if "map<" in kind_ else F.col(f"`{c}`") for c, kind_ in docs.dtypes if c not in (id_col, text_col)]
    copy = F.row_number().over(Window.partitionBy(*keys[:3]).orderBy(F.xxhash64(F.lit(0), *rest)))
    all_ = F.transform(_windows(F.col(text_col)), lambda w: w["pos"])
    none = F.array().cast("array<int>")
    split = joined.withColumn(row, copy).withColumn(gone, _covered(F.when(F.col(row) > 1, all_).otherwise(F.coalesce(F.col(spots), none))))

    def cleaned(lines: Column) -> Column:
        rest = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
        return F.concat_ws("\n", F.transform(rest, lambda i: F.get(lines, i)))

    text = F.when(F.size(gone) == 0, F.coalesce(F.col(text_col), F.lit(""))).otherwise(F.transform(F.array(_lines(F.col(text_col))), cleaned)[0])
    return split.select(*out, text.alias(text_col), F.size(_lines(F.col(text_col))).alias("line_count"), F.size(gone).alias("lines_removed"))


ORACLE = """
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id, text) AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
w AS (SELECT r, pos, trim(ls[pos]) || chr(10) || trim(ls[pos + 1]) || chr(10) || trim(ls[pos + 2]) AS k
      FROM (SELECT r, ls, unnest(range(1, len(ls) - 1)) AS pos FROM d WHERE len(ls) >= 3)),
o AS (SELECT r, pos, row_number() OVER (PARTITION BY k ORDER BY r, pos) AS n FROM w WHERE replace(k, chr(10), '') <> ''),
gone AS (SELECT DISTINCT r, pos + x AS line FROM (SELECT r, pos, unnest([0, 1, 2]) AS x FROM o WHERE n > 1)),
l AS (SELECT r, line, ls[line] AS s FROM (SELECT r, ls, unnest(range(1, len(ls) + 1)) AS line FROM d)),
kept AS (SELECT l.r, string_agg(l.s, chr(10) ORDER BY l.line) AS text, count(*) AS n
         FROM l LEFT JOIN gone ON l.r = gone.r AND l.line = gone.line WHERE gone.r IS NULL GROUP BY l.r)
SELECT d.doc_id, coalesce(kept.text, '') AS text, CAST(len(d.ls) AS INTEGER) AS line_count,
       CAST(len(d.ls) - coalesce(kept.n, 0) AS INTEGER) AS lines_removed
FROM d LEFT JOIN kept ON d.r = kept.r
"""
