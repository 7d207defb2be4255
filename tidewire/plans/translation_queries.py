"""Registered query: rounds of translation over two routes, with SQL that goes through them step by step."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ..operators import translation
from .articles import articles
from .registry import query
from .text_queries import W

_START, _MINUTES, _ROUTES, _FIELDS, _PER_ROUND, _PARK = datetime(2024, 2, 1), (0, 20, 40), ("first", "second"), ("title", "summary"), 300, 25
#: What a route says to a line, from whole numbers: id, round, route and field by their places.
_SAID = "CASE WHEN ({id} * 7 + {n} * 13 + {r} * 5 + {f} * 3) % 23 < 8 THEN 'ok' WHEN ({id} * 7 + {n} * 13 + {r} * 5 + {f} * 3) % 23 < 20 THEN 'refused' WHEN ({id} * 7 + {n} * 13 + {r} * 5 + {f} * 3) % 23 = 21 AND {id} % 50 < 9 THEN 'quota' ELSE 'error' END"


def _sql() -> str:
    ctes = ["s0 AS MATERIALIZED (SELECT id, 'title' AS field, n_chars % 5 AS priority, 0 AS refusals, CAST(NULL AS VARCHAR) AS done_by, CAST(NULL AS INTEGER) AS round FROM art UNION ALL SELECT id, 'summary', n_chars % 5, 0, NULL, NULL FROM art)"]
    ctes += [f"{r}0 AS (SELECT CAST(NULL AS INTEGER) AS u)" for r in _ROUTES]
    park = dict.fromkeys(_ROUTES, 0)
    for n, now in enumerate(_MINUTES):
        ctes.append(f"q{n} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY field ORDER BY priority DESC, id) AS place FROM (SELECT id, field, priority FROM s{n} WHERE done_by IS NULL ORDER BY priority DESC, id, field LIMIT {_PER_ROUND}))")
        done, seen = [], []
        for f, field in enumerate(_FIELDS):
            earlier: list[str] = []
            for r, route in enumerate(_ROUTES):
                k = f"{n}_{f}_{r}"
                gone = "".join(f" AND id NOT IN (SELECT id FROM d{e})" for e in earlier)
                ctes.append(f"a{k} AS MATERIALIZED (SELECT id, place, {_SAID.format(id='id', n=n, r=r, f=f)} AS said FROM q{n} WHERE field = '{field}'{gone} AND coalesce((SELECT u FROM {route}{park[route]}) <= {now}, true))")
                ctes.append(f"h{k} AS MATERIALIZED (SELECT id, said FROM a{k} WHERE place < coalesce((SELECT min(place) FROM a{k} WHERE said = 'quota'), 1000000))")
                ctes.append(f"d{k} AS MATERIALIZED (SELECT id FROM h{k} WHERE said = 'ok')")
                ctes.append(f"{route}{park[route] + 1} AS MATERIALIZED (SELECT CASE WHEN (SELECT count(*) FROM a{k} WHERE said = 'quota') > 0 THEN {now + _PARK} ELSE (SELECT u FROM {route}{park[route]}) END AS u)")
                park[route] += 1
                earlier.append(k)
                done.append(f"SELECT id, '{field}' AS field, '{route}' AS by FROM d{k}")
            looked = " + ".join(f"(SELECT count(*) FROM h{k} WHERE said IN ('ok', 'refused'))" for k in earlier)
            seen.append(f"SELECT id, field FROM q{n} WHERE field = '{field}' AND {looked} > 0")
        ctes.append(f"g{n} AS MATERIALIZED ({' UNION ALL '.join(done)})")
        ctes.append(f"m{n} AS MATERIALIZED (SELECT x.id, x.field, g.by FROM ({' UNION ALL '.join(seen)}) x LEFT JOIN g{n} g ON g.id = x.id AND g.field = x.field)")
        miss = "m.id IS NOT NULL AND m.by IS NULL"
        ctes.append(
            f"s{n + 1} AS MATERIALIZED (SELECT s.id, s.field, s.priority, s.refusals + CASE WHEN {miss} THEN 1 ELSE 0 END AS refusals, CASE WHEN {miss} AND s.refusals >= 2 THEN 'source' ELSE coalesce(m.by, s.done_by) END AS done_by, "
            f"CASE WHEN m.by IS NOT NULL OR ({miss} AND s.refusals >= 2) THEN {n} ELSE s.round END AS round FROM s{n} s LEFT JOIN m{n} m ON m.id = s.id AND m.field = s.field)"
        )
    return W + ", " + ", ".join(ctes) + f" SELECT id, field, CAST(refusals AS INTEGER) AS refusals, done_by, CAST(round AS INTEGER) AS round FROM s{len(_MINUTES)}"


@query(_sql())
def stm07_translation_rounds(spark, sf_dir):
    """Three rounds over titles and summaries of all articles, two routes with answers by whole-number arithmetic."""
    art = articles(spark, sf_dir)
    lines = art.select("id", F.explode(F.array(*map(F.lit, _FIELDS))).alias("field"), F.col("title").alias("text"), (F.col("n_chars") % 5).alias("priority"))
    asked = art.select("id", F.explode(F.sequence(F.lit(0), F.lit(len(_MINUTES) - 1))).alias("round"), F.lit(True).alias("x"))
    asked = asked.select("id", "round", F.posexplode(F.array(*map(F.lit, _ROUTES))).alias("r", "route")).select("id", "round", "r", "route", F.posexplode(F.array(*map(F.lit, _FIELDS))).alias("f", "field"))
    answers = asked.withColumn("said", F.expr(_SAID.format(id="id", n="round", r="r", f="f"))).withColumn("text", F.concat_ws(":", "route", "id"))
    state, _ = translation.translate_rounds(lines, answers, [_START + timedelta(minutes=m) for m in _MINUTES], routes=_ROUTES, fields=_FIELDS, per_round=_PER_ROUND, park_minutes=_PARK)
    return state.select("id", "field", "refusals", "done_by", "round")
