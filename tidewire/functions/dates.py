"""When something ends, from how it is said: dates and spans relative to when it was published."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = "january february march april may june july august september october november december".split()
WEEKDAYS = "monday tuesday wednesday thursday friday saturday sunday".split()
_MONTH = "|".join([*MONTHS, *(m[:3] for m in MONTHS)])
_UPTO = r"\b(?:until|till|through|by|ends(?: on)?|expires(?: on)?)\s+(?:the\s+)?"
_DAY = r"(\d{1,2})(?:st|nd|rd|th)?"

#: Kinds of phrases, the first that a text holds decides; groups are what ``ends`` reads.
PHRASES = {
    "iso": rf"(?:{_UPTO}|(?:截止|截至)\s*到?\s*)(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})\b",
    "day_month": rf"{_UPTO}{_DAY}\s+(?:of\s+)?({_MONTH})\b(?:,?\s+(\d{{4}}))?",
    "month_day": rf"{_UPTO}({_MONTH})\s+{_DAY}\b(?:,?\s+(\d{{4}}))?",
    "month": rf"{_UPTO}({_MONTH})\b",
    "weekday": rf"{_UPTO}({'|'.join(WEEKDAYS)})\b",
    "named": rf"{_UPTO}(midnight|tonight|tomorrow|eoy|year end|end of the year|month end|end of the month)\b",
    "span": r"\bfor\s+(?:a\s+|the\s+next\s+)?(\d{1,3})\s*(hour|day|week|month)s?\b",
    "han_date": r"(?:截止|截至)\s*到?\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日",
    "han_before": r"(\d{1,2})\s*月\s*(\d{1,2})\s*日(?:前|之前|截止)",
    "han_span": r"(?:限时|活动期间|促销期|优惠期)[^。，,\d]{0,8}(\d{1,3})\s*(?:个)?(小时|天|周|月)",
}
_UNITS = {"hour": "hour", "小时": "hour", "day": "day", "天": "day", "week": "week", "周": "week", "month": "month", "月": "month"}


def _part(text: Column, kind: str, group: int) -> Column:
    return F.regexp_extract(text, PHRASES[kind], group)


def _number(text: Column, kind: str, group: int) -> Column:
    return _part(text, kind, group).try_cast("int")


def _month(name: Column) -> Column:
    """1 to 12 from a name or its first three letters."""
    return F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), F.substring(name, 1, 3)).cast("int")


def _date(year: Column, month: Column, day: Column) -> Column:
    """Null where there is no such day."""
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd")


def _next(published: Column, month: Column, day: Column, year: Column | None = None) -> Column:
    """The day in the given year, or the first on or after the publication; 29 February may have to wait."""
    own = F.year(published)
    soon = F.filter(F.transform(F.sequence(F.lit(0), F.lit(8)), lambda k: _date(own + k, month, day)), lambda d: d.isNotNull() & (d >= published))
    first = F.get(soon, F.lit(0))
    return first if year is None else F.when(year.isNotNull(), _date(year, month, day)).otherwise(first)


def _after(moment: Column, n: Column, unit: Column) -> Column:
    """The day on which ``n`` units after the moment end."""
    out = F.when(unit == "hour", F.timestamp_add("HOUR", n, moment)).when(unit == "day", F.timestamp_add("DAY", n, moment))
    return out.when(unit == "week", F.timestamp_add("WEEK", n, moment)).when(unit == "month", F.timestamp_add("MONTH", n, moment)).cast("date")


def expiry(text: Column, published_at: Column) -> Column:
    """struct<phrase, ends>: how a text says that its offer ends, and the day; nulls where it doesn't say.

    Of several kinds of phrases the first of ``PHRASES`` counts. A month alone
    ends on its last day; a day without a year, a month or a weekday is the
    first on or after the publication; spans count from it. An impossible day
    (31 June) keeps its phrase and has no date.
    """
    low, day = F.lower(F.coalesce(text, F.lit(""))), published_at.cast("date")
    weekday = F.array_position(F.array(*map(F.lit, WEEKDAYS)), _part(low, "weekday", 1)).cast("int")
    named = _part(low, "named", 1)
    first = _next(F.trunc(day, "month").cast("date"), _month(_part(low, "month", 1)), F.lit(1))
    ends = {
        "iso": _date(_number(low, "iso", 1), _number(low, "iso", 2), _number(low, "iso", 3)),
        "day_month": _next(day, _month(_part(low, "day_month", 2)), _number(low, "day_month", 1), _number(low, "day_month", 3)),
        "month_day": _next(day, _month(_part(low, "month_day", 1)), _number(low, "month_day", 2), _number(low, "month_day", 3)),
        "month": F.last_day(first),
        "weekday": F.date_add(day, F.pmod(weekday - 1 - F.weekday(day), F.lit(7)).cast("int")),
        "named": F.when(named.isin("midnight", "tonight"), day).when(named == "tomorrow", F.date_add(day, 1)).when(named.isin("month end", "end of the month"), F.last_day(day)).otherwise(_date(F.year(day), F.lit(12), F.lit(31))),
        "span": _after(published_at, _number(low, "span", 1), _part(low, "span", 2)),
        "han_date": _next(day, _number(low, "han_date", 1), _number(low, "han_date", 2)),
        "han_before": _next(day, _number(low, "han_before", 1), _number(low, "han_before", 2)),
        "han_span": _after(published_at, _number(low, "han_span", 1), F.element_at(F.create_map(*[F.lit(x) for k in ("小时", "天", "周", "月") for x in (k, _UNITS[k])]), _part(low, "han_span", 2))),
    }
    phrase, when = F.lit(None).cast("string"), F.lit(None).cast("date")
    for kind in reversed(PHRASES):
        found = low.rlike(PHRASES[kind])
        phrase = F.when(found, F.trim(_part(low, kind, 0))).otherwise(phrase)
        when = F.when(found, ends[kind]).otherwise(when)
    return F.struct(phrase.alias("phrase"), when.alias("ends"))
