"""Near-duplicate documents by circulant MinHash.

Two permutations make the whole signature: sigma scatters the shingle ids over
a ring of 2**32 places, and one permutation pi of the ring, shifted by k
places, gives coordinate k. Bands of the signature propose candidates; every
link is confirmed by the exact Jaccard likeness of the full shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Shelf, columns_of, per_salt, require, salt_of, salts_met, text_hash, unused
from .components import connected_components

SIGNATURE = 180
#: A link at the threshold is missed by the bands with at most this probability, and about as rarely by the bit test.
MISS = 1e-6
_BLOCK = 2048


def band_rows(threshold: float) -> int:
    """The most rows to a band with which a pair at the threshold meets in some band, but for ``MISS``."""
    fit = [r for r in range(1, 11) if SIGNATURE % r == 0 and (1 - threshold**r) ** (SIGNATURE // r) <= MISS]
    return max(fit, default=1)


def most_unequal_bits(threshold: float) -> int:
    """One-bit signatures of a linked pair differ in more places than this only with a probability near 1e-7."""
    p = (1 - threshold) / 2
    for t in range(math.ceil(p * SIGNATURE) + 1, SIGNATURE):
        q = t / SIGNATURE
        if SIGNATURE * (q * math.log(q / p) + (1 - q) * math.log((1 - q) / (1 - p))) > 16.2:
            return t
    return SIGNATURE


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_ids(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit ids of the word shingles; A-Z are lower-cased, words end at ASCII white space."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not tokens:
        return np.empty(0, np.uint64)
    n, h = min(words, len(tokens)), np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    out = np.full(len(tokens) - n + 1, n, np.uint64)
    for i in range(n):
        out = (out ^ h[i : len(h) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(_mix64(out))


def signature(ids: np.ndarray) -> np.ndarray:
    """``SIGNATURE`` coordinates: for each shift k the least pi((sigma(x) + k) mod 2**32)."""
    least = np.full(SIGNATURE, 0xFFFFFFFF, np.uint32)
    shifts = np.arange(SIGNATURE, dtype=np.uint32)[:, None]
    ring = (_mix64(ids ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(ring), _BLOCK):
        x = ring[None, at : at + _BLOCK] + shifts
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x7FEB352D)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x846CA68B)
        x ^= x >> np.uint32(16)
        np.minimum(least, x.min(axis=1), out=least)
    return least


def _signed(words: int, rows: int):
    def sign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for text in part.pop("text"):
                ids = shingle_ids(text, words)
                if not len(ids):
                    out.append((0, None, None, None))
                    continue
                sig = signature(ids)
                bands = [xxhash.xxh3_64_intdigest(sig[k * rows : (k + 1) * rows].tobytes(), seed=k) for k in range(SIGNATURE // rows)]
                bits = np.packbits(np.pad((sig >> np.uint32(7) & np.uint32(1)).astype(np.uint8), (0, -SIGNATURE % 64))).view(np.int64)
                out.append((len(ids), xxhash.xxh3_128_digest(ids.tobytes()), np.array(bands, np.uint64).view(np.int64), bits))
            yield part.assign(**{c: [row[i] for row in out] for i, c in enumerate(("n_shingles", "set_key", "bands", "bits"))})

    return sign


def _shingled(words: int):
    def shingle(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            ids = [shingle_ids(t, words).view(np.int64) for t in part.pop("text")]
            yield part.assign(shingles=ids)

    return shingle


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """Group the documents whose shingle sets reach ``percent`` of Jaccard likeness, through any chain of links.

    Returns a row per input row: doc_id, n_shingles (set size), component_id
    (smallest id of the group), kept (the row has that id), text_hash. Texts
    with fewer words than a shingle count as one shingle; texts without words
    (null, empty, white space) have size 0, link with nothing and are their own
    group. Equal sets are one node, so groups of exact copies cost nothing.
    A null id sorts after all others: such a row is kept only if its group has
    no id, and then the one of least text_hash stays. Rows that repeat an id
    and its text share a result. Other columns are ignored; no rows give no
    rows. ``percent`` of 100 links equal sets only.
    """
    require(docs, id_col, text_col)
    spark = docs.sparkSession
    shelf = Shelf(spark, "minhash")
    share = percent / 100
    rows, bits = band_rows(share), most_unequal_bits(share)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    signed = shelf.put(
        texts.mapInPandas(_signed(shingle_words, rows), "doc_id long, text_hash long, n_shingles long, set_key binary, bands array<long>, bits array<long>"),
        "signed",
    )

    # A node for each distinct set; its home is the first row that has it.
    home = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    sets = signed.filter("n_shingles > 0").groupBy("set_key").agg(F.min(home).alias("home"), F.first("n_shingles").alias("n"), F.first("bits").alias("bits"), F.first("bands").alias("bands"))
    nodes = shelf.put(sets.withColumn("node", F.monotonically_increasing_id()), "nodes")
    facts = nodes.select("node", "n", F.col("bits")[0].alias("b0"), F.col("bits")[1].alias("b1"), F.col("bits")[2].alias("b2"))

    # Buckets of two nodes or more, each with its first node.
    # The buckets of a large group are dealt out by a salt wherever they meet what is known of a bucket.
    places = nodes.select(F.explode("bands").alias("bucket"), "node", salt_of(F.col("node")).alias("salt"))
    heads = places.groupBy("bucket").agg(F.min("node").alias("head"), F.count("*").alias("c"), salts_met(F.col("salt")).alias("bits")).filter("c > 1")
    live = shelf.put(places.join(per_salt(heads.select("bucket", "head", "bits"), "bits", "salt"), ["bucket", "salt"]), "live")

    # Full sets of the nodes in such buckets, from the documents again.
    wanted = live.select("node").distinct().join(nodes.select("node", "home"), "node").select("node", F.col("home.doc_id").alias("h_id"), F.col("home.text_hash").alias("h_hash"))
    full = shelf.put(
        texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("text_hash") == F.col("h_hash")))
        .select("node", "text")
        .mapInPandas(_shingled(shingle_words), "node long, shingles array<long>")
        .dropDuplicates(["node"]),
        "sets",
    )

    def unequal(x: str, y: str) -> Column:
        return sum((F.bit_count(F.col(f"b{i}_{x}").bitwiseXOR(F.col(f"b{i}_{y}"))) for i in range(3)), F.lit(0))

    def with_facts(pairs: DataFrame) -> DataFrame:
        a, b = (facts.select(*[F.col(c).alias(f"{c}_{x}") for c in facts.columns]) for x in "uv")
        return pairs.join(a, F.col("u") == F.col("node_u")).join(b, F.col("v") == F.col("node_v")).drop("node_u", "node_v")

    possible = (F.least("n_u", "n_v") * 100 >= F.greatest("n_u", "n_v") * percent) & (unequal("u", "v") <= bits)

    def with_sets(pairs: DataFrame) -> DataFrame:
        a = full.select(F.col("node").alias("u"), F.col("shingles").alias("s_u"))
        b = full.select(F.col("node").alias("v"), F.col("shingles").alias("s_v"))
        return pairs.join(a, "u").join(b, "v")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The (u, v) pairs that the full sets confirm."""
        both = F.size(F.array_intersect("s_u", "s_v"))
        return with_sets(pairs).filter(100 * both >= percent * (F.size("s_u") + F.size("s_v") - both)).select("u", "v")

    # The most central node of each bucket becomes its hub: that of least mean distance from the first nodes of its buckets.
    far = with_facts(live.filter("node <> head").select(F.col("head").alias("u"), F.col("node").alias("v")).distinct()).withColumn("gap", unequal("u", "v"))
    central = far.select(F.explode(F.array("u", "v")).alias("node"), "gap").groupBy("node").agg(F.avg("gap").alias("gap"))
    hubs = live.join(central, "node").groupBy("bucket").agg(F.min(F.struct("gap", "node"))["node"].alias("hub"), salts_met(F.col("salt")).alias("bits"))
    live = shelf.put(live.select("bucket", "salt", "node").join(per_salt(hubs, "bits", "salt"), ["bucket", "salt"]), "hubs")

    # Every node against its hubs, which joins most groups.
    spokes = shelf.put(with_facts(live.filter("node <> hub").select(F.col("hub").alias("u"), F.col("node").alias("v")).distinct()), "spokes")
    links = shelf.put(confirmed(spokes.filter(possible).select("u", "v")), "near_hubs")
    labels = connected_components(links, shelf)

    # Buckets within one component are done. In the others let D(x) be what x and the hub don't share, d its size. A
    # linked pair x, y of different components differs in at most a = (n_x + n_y)(1 - p)/(1 + p) shingles, and one of
    # them isn't linked to the hub; so D(x) and D(y) share (d_x + d_y - a)/2 > 0 shingles, and at least one of them is
    # among the first d - that + 1 of either, in any fixed order. Rare shingles first, hardly another pair meets there.
    # Before y is known, x takes the first d - t + 1, in whole numbers: t >= d_x - a always, and n_y <= n_x / p. Only
    # if y isn't linked to the hub, d_y > (n_y + n_hub)(1 - p)/(1 + p) and so t >= d_x p/(1 + p) too. That is sure of
    # nodes outside the hub's component: they meet each other by short lists (``early``), as the hub's own component
    # has short lists for them, but meet that component by long ones.
    placed = live.join(labels, "node", "left").select("bucket", "node", "hub", F.coalesce("component", "node").alias("component"))
    placed = shelf.put(placed, "placed")
    split = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("bucket")
    homes = placed.filter("node = hub").select(F.col("hub").alias("u"), F.col("component").alias("hub_component")).distinct()
    rays = placed.join(split, "bucket").filter("node <> hub").select(F.col("hub").alias("u"), F.col("node").alias("v"), "component").distinct()
    rays = rays.join(homes, "u").withColumn("near", F.col("component") == F.col("hub_component")).drop("hub_component")
    apart = F.concat(F.array_except("s_u", "s_v"), F.array_except("s_v", "s_u"))
    rays = shelf.put(with_sets(rays).select(F.col("u").alias("hub"), F.col("v").alias("node"), "component", "near", F.size("s_v").alias("size"), apart.alias("apart")), "rays")
    each = rays.select("hub", "node", F.explode("apart").alias("shingle"))
    shared = each.groupBy("hub", "shingle").agg(F.count("*").alias("c")).filter("c > 1")
    # Shingles that one node alone has come first and need no rows.
    ranked = each.join(shared, ["hub", "shingle"]).groupBy("hub", "node").agg(F.sort_array(F.collect_list(F.struct("c", "shingle"))).alias("common"))
    d = F.size("apart")
    ranked = ranked.join(rays, ["hub", "node"]).select("hub", "node", "component", "near", "size", d.alias("d"), (d - F.size("common")).alias("alone"), "common")
    long = F.least(F.expr(f"size * {100 - percent}L DIV {percent}"), F.col("d") - 1) + 1
    short = F.least(long, F.expr(f"d * 100L DIV {100 + percent}") + 1)
    ranked = ranked.withColumn("short", short)
    reach = F.greatest((F.when(F.col("near"), F.col("short")).otherwise(long) - F.col("alone")).cast("int"), F.lit(0))
    heads = ranked.withColumn("common", F.slice("common", F.lit(1), reach)).filter(F.size("common") > 0)
    heads = heads.select("hub", "node", "component", "near", "size", "d", "alone", "short", F.posexplode("common").alias("i", "s"))
    at = F.col("alone") + F.col("i") + 1
    heads = shelf.put(heads.select("hub", F.col("s.shingle").alias("shingle"), "node", "component", "near", "size", "d", at.alias("at"), (at <= F.col("short")).alias("early")), "heads")

    def meeting(a: DataFrame, b: DataFrame, differ: Column) -> DataFrame:
        a, b = (x.select("hub", "shingle", *[F.col(c).alias(f"{c}_{y}") for c in ("node", "component", "size", "d", "at")]) for x, y in ((a, "u"), (b, "v")))
        # Twice (100 + percent) times what the pair must share, and the room each has beyond its place.
        need = (F.col("d_u") + F.col("d_v")) * F.lit(100 + percent) - (F.col("size_u") + F.col("size_v")) * F.lit(100 - percent)
        fits = [(F.col(f"d_{x}") + 1 - F.col(f"at_{x}")) * F.lit(2 * (100 + percent)) >= need for x in "uv"]
        return a.join(b, (a["hub"] == b["hub"]) & (a["shingle"] == b["shingle"]) & differ & fits[0] & fits[1]).select("node_u", "node_v")

    others = heads.filter(~F.col("near"))
    meets = meeting(others.filter("early"), others.filter("early"), F.col("component_u") < F.col("component_v"))
    meets = meets.union(meeting(heads.filter("near"), others, F.lit(True)))
    rest = meets.select(F.least("node_u", "node_v").alias("u"), F.greatest("node_u", "node_v").alias("v")).distinct()
    more = shelf.put(confirmed(with_facts(rest).filter(possible).select("u", "v")), "more")
    chain = labels.select(F.col("node").alias("u"), F.col("component").alias("v"))
    labels = connected_components(more.union(chain), shelf)

    # The first home of each component, then back to the rows.
    placed = nodes.select("node", "set_key", "home").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    firsts = placed.groupBy("component").agg(F.min("home").alias("first"))
    keyed = shelf.put(placed.join(firsts, "component").select("set_key", "first"), "groups")
    mine = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    out = signed.select("doc_id", "text_hash", "n_shingles", "set_key").join(keyed, "set_key", "left")
    alone = F.col("first").isNull()
    return out.select(
        "doc_id",
        "n_shingles",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"),
        (alone | (mine == F.col("first")) | F.coalesce(F.col("doc_id") == F.col("first.doc_id"), F.lit(False))).alias("kept"),
        "text_hash",
    )


def drop_near_duplicates(docs: DataFrame, *, percent: int = 80, shingle_words: int = 5) -> DataFrame:
    """The documents without the copies: one row of each group stays, with all its columns.

    It is the row of smallest id (see ``near_duplicates`` for nulls); texts
    without words all stay; of rows that repeat an id and its text one stays.
    """
    groups = near_duplicates(docs, percent=percent, shingle_words=shingle_words)
    no_id, row, mark = keys = unused(docs, "no_id", "row", "mark")
    kept = groups.filter("kept").select(F.col("doc_id").isNull().alias(no_id), F.coalesce("doc_id", F.lit(0)).alias(row), F.col("text_hash").alias(mark)).distinct()
    keyed = docs.withColumns({no_id: F.col("doc_id").isNull(), row: F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), mark: text_hash(F.col("text"))})
    return keyed.join(kept, keys, "left_semi").dropDuplicates(keys).select(*columns_of(docs))
