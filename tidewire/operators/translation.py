"""Rounds of translation over several routes: refusals are counted, spent routes are parked, lines are given up."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import drop_written, written

#: What a route may say to a line: a translation, a refusal, that its quota is spent, or nothing.
SAID = ("ok", "refused", "quota", "error")


def translate_rounds(
    lines: DataFrame,
    answers: DataFrame,
    rounds: list[datetime],
    *,
    routes: tuple[str, ...] = ("first", "second"),
    fields: tuple[str, ...] = ("title", "summary", "points"),
    per_round: int = 120,
    park_minutes: int = 60,
    give_up: dict[str, int] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(lines, routes): the state after all rounds.

    ``lines`` has (id, field, text, priority), ``answers`` (round, route, id,
    field, said, text): what a route would say to a line, of ``SAID``, in the
    round of that number from 0 on; a line without an answer is an error.

    A round takes the ``per_round`` open lines of highest priority, then least
    id, and goes through the fields in order. A field's lines go to the first
    route in order of priority; what it doesn't translate goes to the next.
    From the first line that finds the quota spent a route says no more, in any
    field, until ``park_minutes`` are over. If any route has looked at a line of
    the field, those left untranslated are refused once more; after ``give_up``
    refusals (3, for points 2) a line keeps its own text. Where no route looked
    at any, it was an outage, and nothing is counted.

    Lines get done_by (the route, ``source`` where given up, null while open),
    answer, refusals and round. Routes get (route, parked_until).
    """
    most = {"points": 2} | (give_up or {})
    state = written(lines.select("id", "field", "text", "priority", F.lit(0).alias("refusals"), F.lit(None).cast("string").alias("done_by"), F.lit(None).cast("string").alias("answer"), F.lit(None).cast("int").alias("round")))
    parked: dict[str, datetime] = {}
    for number, now in enumerate(rounds):
        queue = state.filter("done_by IS NULL").orderBy(F.desc("priority"), "id", "field").limit(per_round).select("id", "field", "priority")
        place = Window.partitionBy("field").orderBy(F.desc("priority"), "id")
        queue = written(queue.withColumn("place", F.row_number().over(place)))
        said = answers.filter(F.col("round") == number).select("route", "id", "field", "said", F.col("text").alias("got"))
        moves, tables = [], []
        for field in fields:
            left, looked = queue.filter(F.col("field") == field), 0
            for route in routes:
                if route in parked and now < parked[route]:
                    continue
                asked = left.join(said.filter((F.col("route") == route) & (F.col("field") == field)).drop("route", "field"), "id", "left")
                asked = written(asked.withColumn("said", F.coalesce("said", F.lit("error"))))
                tables.append(asked)
                spent = asked.agg(F.min(F.when(F.col("said") == "quota", F.col("place"))).alias("at")).first()["at"]
                heard = asked if spent is None else asked.filter(F.col("place") < spent)
                looked += heard.filter(F.col("said").isin("ok", "refused")).count()
                if spent is not None:
                    parked[route] = now + timedelta(minutes=park_minutes)
                done = heard.filter("said = 'ok'").select("id", "field", F.lit(route).alias("by"), "got")
                moves.append(done)
                left = left.join(done.select("id"), "id", "left_anti")
            if looked:
                moves.append(left.select("id", "field", F.lit(None).cast("string").alias("by"), F.lit(None).cast("string").alias("got")))
        if not moves:
            continue
        moved = moves[0]
        for more in moves[1:]:
            moved = moved.unionByName(more)
        after = state.join(moved.withColumn("moved", F.lit(True)), ["id", "field"], "left")
        refused = F.coalesce("moved", F.lit(False)) & F.col("by").isNull()
        limit = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in most.items() for x in kv]), F.col("field")), F.lit(3))
        refusals = F.col("refusals") + refused.cast("int")
        gone = refused & (refusals >= limit)
        settled = F.coalesce("moved", F.lit(False)) & (F.col("by").isNotNull() | gone)
        before, state = state, written(
            after.select(
                "id",
                "field",
                "text",
                "priority",
                refusals.alias("refusals"),
                F.when(gone, "source").otherwise(F.coalesce("by", "done_by")).alias("done_by"),
                F.when(gone, F.col("text")).otherwise(F.coalesce("got", "answer")).alias("answer"),
                F.when(settled, F.lit(number)).otherwise(F.col("round")).cast("int").alias("round"),
            )
        )
        drop_written(before, queue, *tables)
    spark = lines.sparkSession
    return state, spark.createDataFrame([(r, parked.get(r)) for r in routes], "route string, parked_until timestamp_ntz")
