"""Multi-party dialogues rendered once from each participant's side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SALTS, Shelf, require

SYSTEM, UNKNOWN, END = "system", "unknown", "<|end|>"


def _plain(text: Column) -> Column:
    """A text can't hold the marks of the format."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def _user_head(speaker: Column) -> Column:
    return F.when(speaker == SYSTEM, F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user:"), speaker, F.lit("|>\n")))


OWN_HEAD = "<|assistant|>\n"


def _numbered(turns: DataFrame, shelf: Shelf) -> DataFrame:
    """Adds n, a turn's place in its conversation from 1 on.

    Rows are dealt by ranges of their order, so that a conversation of any
    length is in as many tasks as it needs; each range counts its own rows, and
    the counts of those before it are carried.
    """
    order = ["conv_id", "no_turn", "turn", "speaker", "text", "uid"]
    dealt = turns.withColumn("uid", F.monotonically_increasing_id()).repartitionByRange(*order).withColumn("range", F.spark_partition_id())
    dealt = shelf.put(dealt, "turns")
    sizes = dealt.groupBy("conv_id", "range").agg(F.count("*").alias("size"))
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("conv_id").alias("c"), F.col("range").alias("r"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("carried"))
    own = F.row_number().over(Window.partitionBy("conv_id", "range").orderBy(*order[1:]))
    both = dealt.withColumn("own", own).join(sizes, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("range") == F.col("r")))
    return both.withColumn("n", F.col("own") + F.col("carried")).select("conv_id", "n", "speaker", "text")


def rotate_perspectives(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", part_turns: int = 1000) -> DataFrame:
    """Each conversation rendered for each participant, who is the assistant there.

    All other participants are users by their names; system turns stay so and
    have no side of their own. A turn is ``<|assistant|>``, ``<|user:NAME|>`` or
    ``<|system|>``, a line end, the text, ``<|end|>`` and a line end.

    Returns conv_id, perspective, part, n_turns, begin, text, turns, spans. A
    dialogue of more than ``part_turns`` turns comes in parts of so many, for
    every participant alike; one behind another their texts are the dialogue,
    and ``begin`` says where in it a part stands. ``turns`` (at, begin, finish,
    mine) and ``spans`` (begin, finish) are in code points of the part's text:
    where a turn and its words begin and end, whether they are the assistant's;
    and what to train on, the assistant's words with their end mark.

    Turns are ordered by (turn, speaker, text), null turns last. A null text is
    empty, a null or empty speaker is ``unknown``, a null conversation id is a
    conversation like any other. Repeated rows are turns of their own. A
    conversation of system turns alone gives no row, nor does an empty table;
    other columns are ignored. No task holds more than a part of a
    conversation, however long it is.
    """
    require(turns, conv_col, turn_col, speaker_col, text_col)
    shelf = Shelf(turns.sparkSession, "chat")
    speaker = F.coalesce(F.nullif(F.col(speaker_col), F.lit("")), F.lit(UNKNOWN))
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).isNull().alias("no_turn"), F.col(turn_col).alias("turn"), _plain(speaker).alias("speaker"), _plain(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    numbered = _numbered(rows, shelf).withColumn("part", F.floor((F.col("n") - 1) / part_turns).cast("long"))
    # What a turn takes up where it isn't the assistant's.
    size = F.length(_user_head(F.col("speaker"))) + F.length("text") + F.lit(len(END) + 1)
    parts = numbered.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("n", "speaker", "text"))).alias("rows"), F.sum(size).cast("long").alias("size"))
    parts = shelf.put(parts, "parts")

    heads = parts.select("conv_id", "part", "size")
    by_part = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn("before", F.coalesce(F.sum("size").over(by_part), F.lit(0))).withColumn("salt", (F.col("part") % SALTS).cast("int"))
    spoken = parts.select("conv_id", "part", F.explode("rows.speaker").alias("speaker")).groupBy("conv_id", "part", "speaker").agg(F.count("*").alias("own")).filter(F.col("speaker") != SYSTEM)
    people = spoken.groupBy("conv_id", "speaker").agg(F.lit(1).alias("there"))
    lengths = heads.groupBy("conv_id").agg(F.max("part").alias("last"))
    people = people.alias("p").join(lengths.alias("l"), F.expr("p.conv_id <=> l.conv_id")).select("p.conv_id", F.col("speaker").alias("perspective"), F.explode(F.sequence(F.lit(0), F.least("last", F.lit(SALTS - 1).cast("long")).cast("int"))).alias("salt"))
    sides = heads.alias("h").join(people.alias("p"), F.expr("h.conv_id <=> p.conv_id AND h.salt = p.salt")).select("h.conv_id", "h.part", "h.before", "p.perspective")
    sides = sides.alias("s").join(spoken.alias("o"), F.expr("s.conv_id <=> o.conv_id AND s.part = o.part AND s.perspective = o.speaker"), "left").select("s.*", F.coalesce("o.own", F.lit(0)).alias("own"))
    # Each own turn so far takes up the other head.
    earlier = Window.partitionBy("conv_id", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    saved = F.coalesce(F.sum("own").over(earlier), F.lit(0)) * (F.length(_user_head(F.col("perspective"))) - F.lit(len(OWN_HEAD)))
    sides = sides.select("conv_id", "part", "perspective", (F.col("before") - saved).cast("long").alias("begin"))
    made = sides.alias("s").join(parts.alias("t"), F.expr("s.conv_id <=> t.conv_id AND s.part = t.part")).select("s.*", "t.rows")

    def piece(r: Column) -> Column:
        mine = r["speaker"] == F.col("perspective")
        return F.struct(F.when(mine, F.lit(OWN_HEAD)).otherwise(_user_head(r["speaker"])).alias("head"), F.concat(r["text"], F.lit(END)).alias("body"), mine.alias("mine"))

    made = made.withColumn("pieces", F.transform("rows", piece))
    kind = "array<struct<at:int,begin:int,finish:int,mine:boolean>>"
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("turns"))

    def step(so_far: Column, p: Column) -> Column:
        begin = so_far["at"] + F.length(p["head"])
        finish = begin + F.length(p["body"])
        turn = F.array(F.struct(so_far["at"].alias("at"), begin.alias("begin"), finish.alias("finish"), p["mine"].alias("mine")))
        return F.struct((finish + 1).alias("at"), F.concat(so_far["turns"], turn).alias("turns"))

    made = made.withColumn("turns", F.aggregate("pieces", empty, step)["turns"])
    return made.select(
        "conv_id",
        "perspective",
        "part",
        F.size("rows").alias("n_turns"),
        "begin",
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "").alias("text"),
        "turns",
        F.transform(F.filter("turns", lambda t: t["mine"]), lambda t: F.struct(t["begin"].alias("begin"), t["finish"].alias("finish"))).alias("spans"),
    )


def rendered_turns(sides: DataFrame, part_turns: int = 1000) -> DataFrame:
    """conv_id, perspective, n, at, trained, text: a row for each turn of what ``rotate_perspectives`` gives, with its place in the whole dialogue."""
    each = sides.select("conv_id", "perspective", "part", "begin", "text", F.posexplode("turns").alias("pos", "t"))
    return each.select(
        "conv_id",
        "perspective",
        (F.col("part") * part_turns + F.col("pos") + 1).alias("n"),
        (F.col("begin") + F.col("t.at")).alias("at"),
        F.col("t.mine").alias("trained"),
        F.substring("text", F.col("t.at") + 1, F.col("t.finish") + 1 - F.col("t.at")).alias("text"),
    )


ORACLE = """
WITH t AS (SELECT conv_id, turn, replace(coalesce(nullif(role, ''), 'unknown'), '<|', '< |') AS sp, replace(coalesce(text, ''), '<|', '< |') AS tx FROM conversations),
p AS (SELECT DISTINCT conv_id, sp AS perspective FROM t WHERE sp <> 'system'),
s AS (SELECT t.conv_id, perspective, sp = perspective AS trained,
             CASE WHEN sp = 'system' THEN '<|system|>' WHEN sp = perspective THEN '<|assistant|>' ELSE '<|user:' || sp || '|>' END || chr(10) || tx || '<|end|>' || chr(10) AS piece,
             row_number() OVER (PARTITION BY t.conv_id, perspective ORDER BY turn NULLS LAST, sp, tx) AS n
      FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id)
SELECT conv_id, perspective, n, trained, piece AS text,
       CAST(sum(length(piece)) OVER (PARTITION BY conv_id, perspective ORDER BY n) - length(piece) AS BIGINT) AS at
FROM s
"""
