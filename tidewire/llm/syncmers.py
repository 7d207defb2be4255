"""Document fingerprints from closed syncmers, in DataFrame operations only.

The text is a string of units: words, cut after sixteen characters, and single
characters of scripts that don't part words. A k-mer of units is a closed
syncmer if its least inner s-mer, by hash, lies at either edge. That depends on
the k-mer alone, so the same passage gives the same anchors wherever it stands,
and two neighbours are never more than k - s units apart. A fingerprint keeps
all anchors of the text with their positions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Shelf, require, text_hash

K, S = 5, 2
#: Kana, Han and Hangul characters are units alone.
_UNIT = r"[\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{ac00}-\x{d7a3}]|[^\s\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{ac00}-\x{d7a3}]{1,16}"
#: Documents to a slice of the ring, and to a range of ids.
_SLICE_ROWS, _RANGE_ROWS = 128, 200_000


def _let(value: Column, use) -> Column:
    """Bind a value once for use inside lambdas, where a plain column would be worked out for each element."""
    return F.transform(F.array(value), use)[0]


def _units(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_UNIT), F.lit(0))


def _anchors(units: Column, k: int, s: int) -> Column:
    last = k - s

    def edge(h: Column):
        def is_anchor(i: Column) -> Column:
            head, tail = F.get(h, i), F.get(h, i + last)
            at_start = reduce(lambda a, b: a & b, [head <= F.get(h, i + j) for j in range(1, last + 1)])
            at_end = reduce(lambda a, b: a & b, [tail < F.get(h, i + j) for j in range(last)])
            return at_start | at_end

        return is_anchor

    n = F.size(units)
    inner = F.transform(F.sequence(F.lit(0), n - s), lambda i: F.xxhash64(*[F.get(units, i + j) for j in range(s)]))
    spots = _let(inner, lambda h: F.filter(F.sequence(F.lit(0), n - k), edge(h)))
    found = F.transform(spots, lambda i: F.struct(i.alias("pos"), F.xxhash64(*[F.get(units, i + j) for j in range(k)]).alias("hash")))
    whole = F.array(F.struct(F.lit(0).alias("pos"), F.xxhash64(F.concat_ws(" ", units)).alias("hash")))
    return F.when(n >= k, found).when(n > 0, whole).otherwise(F.slice(whole, 1, 0))


def syncmers(text: Column, k: int = K, s: int = S) -> Column:
    """array<struct<pos, hash>>: the closed syncmers in text order, by unit position.

    Of equal s-mers the leftmost counts as the least. A text of fewer than
    ``k`` units is one anchor; one without units (null, empty, white space)
    has none.
    """
    return _let(_units(text), lambda u: _anchors(u, k, s))


def fingerprint(text: Column) -> Column:
    """Every anchor of the text in order: two hex digits for its distance from the one before, eight for its hash.

    At the end, after a dot, stands the number of units from the last anchor to
    the text's end. A text without units has the fingerprint ''.
    """

    def coded(units: Column) -> Column:
        def line(found: Column) -> Column:
            def code(a: Column, i: Column) -> Column:
                gap = a["pos"] - F.coalesce(F.get(found, i - 1)["pos"], F.lit(0))
                return F.lower(F.concat(F.lpad(F.hex(gap), 2, "0"), F.lpad(F.hex(F.shiftrightunsigned(a["hash"], 32)), 8, "0")))

            rest = F.size(units) - F.coalesce(F.get(found, F.size(found) - 1)["pos"], F.lit(0))
            return F.when(F.size(found) > 0, F.concat(F.concat_ws("", F.transform(found, code)), F.lit("."), rest.cast("string"))).otherwise(F.lit(""))

        return _let(_anchors(units, K, S), line)

    return _let(_units(text), coded)


def anchors_of(fingerprint: Column) -> Column:
    """array<struct<pos, hash>> of a fingerprint, the hashes of 32 bits in hex: what it tells of the text."""
    codes = F.regexp_extract_all(fingerprint, F.lit("([0-9a-f]{10})"), F.lit(1))
    gap = lambda c: F.conv(F.substring(c, 1, 2), 16, 10).cast("int")
    return _let(_running(F.transform(codes, gap)), lambda at: F.transform(codes, lambda c, i: F.struct(F.get(at, i).alias("pos"), F.substring(c, 3, 8).alias("hash"))))


def _running(gaps: Column) -> Column:
    """Running sums, by blocks of a hundred, as a fold over an array copies it at each step."""
    blocks = F.transform(F.sequence(F.lit(0), F.size(gaps), F.lit(100)), lambda b: F.slice(gaps, b + 1, F.lit(100)))
    fold = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    sums = lambda block, base: F.transform(block, lambda _, i: base + fold(F.slice(block, F.lit(1), i + 1)))
    totals = F.transform(blocks, fold)
    return _let(blocks, lambda bs: _let(totals, lambda ts: F.flatten(F.transform(bs, lambda b, i: sums(b, fold(F.slice(ts, F.lit(1), i)))))))


def _stretches(fingerprint: Column) -> Column:
    """A number for each stretch from an anchor to the next: its low byte is the length, the rest tells both ends and the length.

    Two texts share a stretch only if both anchors stand in both at the same
    distance. A last one reaches from the last anchor to the end.
    """
    codes = F.regexp_extract_all(fingerprint, F.lit("([0-9a-f]{10})"), F.lit(1))

    def numbered(c: Column) -> Column:
        def number(x: Column, i: Column) -> Column:
            gap = F.conv(F.substring(F.get(c, i + 1), 1, 2), 16, 10).cast("long")
            mark = F.xxhash64(F.substring(x, 3, 8), F.substring(F.get(c, i + 1), 1, 10))
            return F.shiftleft(F.shiftrightunsigned(mark, 8), 8).bitwiseOR(gap)

        inner = F.transform(F.slice(c, F.lit(1), F.size(c) - 1), number)
        rest = F.regexp_extract(fingerprint, r"\.(\d+)$", 1)
        tail = F.shiftleft(F.shiftrightunsigned(F.xxhash64(F.substring(F.get(c, F.size(c) - 1), 3, 8), rest), 8), 8).bitwiseOR(F.least(rest.cast("long"), F.lit(255).cast("long")))
        return F.when(F.size(c) > 0, F.concat(inner, F.array(tail))).otherwise(F.array().cast("array<bigint>"))

    return _let(codes, numbered)


def likeness(a: Column, b: Column) -> Column:
    """What part of two texts' units lies in stretches that both hold, anchors and distances alike: 0 to 1.

    The units of distinct shared stretches over those of all distinct ones.
    Moved passages match wherever they stand; 1 for two fingerprints without
    anchors. Time is in proportion to the anchors.
    """
    size = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda n, x: n + x.bitwiseAND(F.lit(255).cast("long")))
    share = lambda x, y: size(F.array_intersect(x, y)) / size(F.array_union(x, y)).cast("double")
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(_let(_stretches(a), lambda x: _let(_stretches(b), lambda y: share(x, y))))


def shared_passages(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(key, begin_a, begin_b, units): the passages that two fingerprints of a row share, by unit position in either text.

    Shared stretches at the same offset that follow each other are one passage;
    of a stretch that a text repeats its first place counts. ``key`` names the
    row; rows without anchors or without shared stretches give none.
    """

    def side(name: str, begin: str) -> DataFrame:
        zipped = F.arrays_zip(F.transform(anchors_of(F.col(name)), lambda x: x["pos"]).alias("pos"), _stretches(F.col(name)).alias("mark"))
        each = pairs.select(F.col(key).alias("key"), F.explode(zipped).alias("z")).select("key", "z.pos", "z.mark")
        return each.groupBy("key", "mark").agg(F.min("pos").alias(begin))

    met = side(a, "begin_a").join(side(b, "begin_b"), ["key", "mark"]).withColumn("units", F.col("mark").bitwiseAND(F.lit(255).cast("long")))
    line = Window.partitionBy("key", "offset").orderBy("begin_a")
    met = met.withColumn("offset", F.col("begin_b") - F.col("begin_a"))
    met = met.withColumn("new", F.coalesce((F.lag(F.col("begin_a") + F.col("units")).over(line) != F.col("begin_a")).cast("int"), F.lit(1)))
    met = met.withColumn("run", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return met.groupBy("key", "offset", "run").agg(F.min("begin_a").alias("begin_a"), F.min("begin_b").alias("begin_b"), F.sum("units").alias("units")).select(F.col("key").alias(key), "begin_a", "begin_b", "units")


def with_successor(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(slice, extra, rank, no_id, id, copies, text): each different document, in slices of the ring of documents.

    The ring's order is (id, text hash), null ids last; after the last comes
    the first. Rows that repeat an id and a text are one row with their number,
    ``copies``. Ids are ranked by ranges that follow their distribution, on
    rows without texts; a slice is a run of ranks, and the next slice's first
    document stands at its end as ``extra``. Texts are shuffled twice, once to
    meet their rank and once into slices, whatever the ids look like.
    """
    shelf = Shelf(docs.sparkSession, "ring")
    rows = docs.select(F.col(id_col).isNull().alias("no_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"), text_hash(F.col(text_col)).alias("hash"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    key = ["no_id", "id", "hash"]
    keys = shelf.put(rows.select(*key).distinct(), "keys")
    total = keys.count()
    ranges = shelf.put(keys.repartitionByRange(max(1, -(-total // _RANGE_ROWS)), *key).withColumn("range", F.spark_partition_id()), "ranges")
    before = ranges.groupBy("range").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each range
    ranked = ranges.join(before.select("range", "before"), "range").withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy(*key)) - 1)
    own = F.floor(F.col("rank") / _SLICE_ROWS).cast("long")
    last = max(0, total - 1) // _SLICE_ROWS
    head = F.array(F.struct(F.when(own == 0, F.lit(last)).otherwise(own - 1).alias("slice"), F.lit(True).alias("extra")))
    place = F.array(F.struct(own.alias("slice"), F.lit(False).alias("extra")))
    places = ranked.select(*key, "rank", F.explode(F.when(F.col("rank") % _SLICE_ROWS == 0, F.concat(place, head)).otherwise(place)).alias("p")).select(*key, "rank", "p.slice", "p.extra")
    texts = rows.groupBy(*key).agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    return texts.join(places, key).select("slice", "extra", "rank", "no_id", "id", "copies", "text")


def edited_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, with their likeness.

    The edited text has its last floor(n_chars / 2) code points replaced by the
    first as many (or all) of the next document. Returns doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. A
    null text counts as empty; rows that repeat an id and a text follow each
    other, so each but the last is followed by itself; a single row is its own
    next; an empty table gives no rows; other columns are ignored.
    """
    require(docs, id_col, text_col)
    ring = Window.partitionBy("slice").orderBy("extra", "rank")
    paired = with_successor(docs, id_col=id_col, text_col=text_col).withColumn("next_text", F.lead("text").over(ring))
    half = F.expr("length(text) DIV 2").cast("int")
    with_next = lambda other: F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring(F.coalesce(other, F.lit("")), F.lit(1), half))
    marked = paired.select(
        "slice",
        "extra",
        "rank",
        "no_id",
        "id",
        "copies",
        F.length("text").cast("long").alias("n_chars"),
        F.when(~F.col("extra"), with_next(F.col("next_text"))).alias("edited"),
        F.when(~F.col("extra") & (F.col("copies") > 1), with_next(F.col("text"))).alias("again"),
        fingerprint(F.col("text")).alias("fingerprint"),
    )
    followed = marked.withColumn("next_fingerprint", F.lead("fingerprint").over(ring)).filter(~F.col("extra"))

    def variant(n: Column, edited: str, after: str) -> Column:
        return F.struct(n.alias("n"), F.col(edited).alias("edited"), F.col(after).alias("after"))

    # The last of repeated rows comes before the next document, the others before themselves.
    variants = F.array(variant(F.lit(1).cast("long"), "edited", "next_fingerprint"), variant(F.col("copies") - 1, "again", "fingerprint"))
    each = followed.withColumn("v", F.explode(F.filter(variants, lambda v: v["n"] > 0))).withColumn("edited_fingerprint", fingerprint(F.col("v.edited")))
    result = each.select(
        F.when(~F.col("no_id"), F.col("id")).alias("doc_id"),
        "n_chars",
        F.sha2(F.col("v.edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("v.after")).alias("near_next"),
        F.col("v.n").alias("left"),
    )
    # As many rows as there were copies, by blocks, so that no array is long.
    block = 10_000
    result = result.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("left") - 1) / block).cast("long"))))
    result = result.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(block).cast("long"), F.col("left") - F.col("block") * block))))
    return result.drop("left", "block", "copy")
