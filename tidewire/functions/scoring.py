"""Column functions for scores. Rounding is by floor(x * 10^n + 0.5), the same in every engine."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights, tiers, caps and ceilings of the score model.
WEIGHTS = {"importance": 0.35, "relevance": 0.30, "novelty": 0.15, "source": 0.10, "heat": 0.10}
TIERS = {"A": 95.0, "B": 80.0, "C": 65.0, "D": 45.0}
CAPS = {"A": 100.0, "B": 100.0, "C": 78.0, "D": 68.0}
HEAT = {"points": (1.0, 2000), "upvotes": (1.0, 2000), "score": (1.0, 2000), "stars": (0.35, 20000), "stars_today": (1.5, 2000), "comments": (0.3, 2000)}
BONUS = 15.0


def rounded(x: Column, digits: int = 1) -> Column:
    k = float(10**digits)
    return F.floor(x * k + 0.5).cast("double") / k


def by_tier(tier: Column, values: dict[str, float], default: float) -> Column:
    t = F.upper(F.substring(F.coalesce(tier, F.lit("C")), 1, 1))
    out = F.lit(default)
    for name, value in values.items():
        out = F.when(t == name, F.lit(value)).otherwise(out)
    return out


def source_quality(tier: Column) -> Column:
    return by_tier(tier, TIERS, 65.0)


def tier_cap(tier: Column) -> Column:
    return by_tier(tier, CAPS, 78.0)


def community_heat(signals: dict[str, Column]) -> Column:
    """0 to 100: the strongest signal on a log scale, a little more with much discussion."""
    parts = [F.least(F.lit(100.0), F.log10(1 + F.coalesce(v, F.lit(0)).cast("double") * HEAT[k][0]) / math.log10(1 + HEAT[k][1]) * 100) for k, v in signals.items()]
    best = F.greatest(F.lit(0.0), F.lit(0.0), *parts)
    if "comments" in signals:
        best = F.when(signals["comments"] >= 50, F.least(F.lit(100.0), best + 8)).otherwise(best)
    return rounded(best)


def novelty(age_hours: Column) -> Column:
    return (
        F.when(age_hours <= 0, 100.0)
        .when(age_hours <= 6, 95.0)
        .when(age_hours <= 24, 85.0)
        .when(age_hours <= 48, 65.0)
        .when(age_hours <= 96, 45.0)
        .otherwise(F.greatest(F.lit(10.0), F.lit(100.0) - age_hours / 6.0))
    )


def rule_importance(hits: Column, tier: Column) -> Column:
    return F.least(F.lit(85.0), 28 + 4.5 * hits + F.when(tier == "A", 12).otherwise(0))


def rule_relevance(hits: Column) -> Column:
    return F.least(F.lit(88.0), 32 + 4.5 * hits)


def interest_bonus(text: Column, tags: Column, category: Column, interests: list[tuple[str, str, float]]) -> Column:
    """interests: (type, value, weight). Topics that a reader excludes cost more than any wish brings."""
    total = F.lit(0.0)
    for kind, value, weight in interests:
        v = value.lower().strip()
        if not v:
            continue
        hit = F.contains(text, F.lit(v)) | F.array_contains(tags, v) | (F.lower(F.coalesce(category, F.lit(""))) == v)
        total = total + F.when(hit, -BONUS * 1.6 if kind == "exclude" else BONUS * weight * 0.5).otherwise(0.0)
    return rounded(F.greatest(F.lit(-2 * BONUS), F.least(F.lit(BONUS), total)))


def final_score(importance: Column, relevance: Column, novelty_: Column, source: Column, heat: Column, tier: Column, bonus: Column | None = None) -> Column:
    """Weighted mean under the tier's cap. Without heat its weight is shared out; without importance relevance stands in."""
    w = WEIGHTS
    imp = F.when(importance <= 0, rounded(relevance * 0.6)).otherwise(importance)
    cold = 1.0 - w["heat"]
    base = imp * w["importance"] + relevance * w["relevance"] + novelty_ * w["novelty"] + source * w["source"]
    mean = F.when(heat > 0, base + heat * w["heat"]).otherwise(base / cold)
    return rounded(F.greatest(F.lit(0.0), F.least(tier_cap(tier), mean + (bonus if bonus is not None else F.lit(0.0)))))
