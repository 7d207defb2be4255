"""How offers say when they end."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidewire.functions import dates

T = datetime(2024, 2, 27, 15, 30)  # a Tuesday
CASES = [
    ("free until March 5", "until march 5", date(2024, 3, 5)),
    ("free until 5 March, 2026", "until 5 march, 2026", date(2026, 3, 5)),
    ("free through the 3rd of January", "through the 3rd of january", date(2025, 1, 3)),
    ("Ends on Feb 29", "ends on feb 29", date(2024, 2, 29)),
    ("until 31 June", "until 31 june", None),
    ("until Feb 27", "until feb 27", date(2024, 2, 27)),
    ("by May", "by may", date(2024, 5, 31)),
    ("by February", "by february", date(2024, 2, 29)),
    ("until January", "until january", date(2025, 1, 31)),
    ("till Friday", "till friday", date(2024, 3, 1)),
    ("till Tuesday", "till tuesday", date(2024, 2, 27)),
    ("until midnight", "until midnight", date(2024, 2, 27)),
    ("expires tomorrow", "expires tomorrow", date(2024, 2, 28)),
    ("until month end", "until month end", date(2024, 2, 29)),
    ("until the end of the year", None, None),
    ("by EOY", "by eoy", date(2024, 12, 31)),
    ("free for 3 days", "for 3 days", date(2024, 3, 1)),
    ("free for the next 9 hours", "for the next 9 hours", date(2024, 2, 28)),
    ("for a 2 month run", "for a 2 month", date(2024, 4, 27)),
    ("until 2024-02-30", "until 2024-02-30", None),
    ("until 2025-1-2", "until 2025-1-2", date(2025, 1, 2)),
    ("免费，截至 3月31日", "截至 3月31日", date(2024, 3, 31)),
    ("截止到2024-06-01", "截止到2024-06-01", date(2024, 6, 1)),
    ("1月8日前免费", "1月8日前", date(2025, 1, 8)),
    ("限时免费7天", "限时免费7天", date(2024, 3, 5)),
    ("for 3 days, until March 9", "until march 9", date(2024, 3, 9)),
    ("standby may help; whereby june", None, None),
    ("free as ever", None, None),
    ("", None, None),
    (None, None, None),
]


def test_phrases(spark):
    rows = spark.createDataFrame([(i, t, T) for i, (t, _, _) in enumerate(CASES)], "id int, t string, at timestamp_ntz")
    got = {r.id: (r.e.phrase, r.e.ends) for r in rows.select("id", dates.expiry(F.col("t"), F.col("at")).alias("e")).collect()}
    for i, (text, phrase, ends) in enumerate(CASES):
        if text == "until the end of the year":
            assert got[i] == ("until the end of the year", date(2024, 12, 31))
        else:
            assert got[i] == (phrase, ends), text


@pytest.mark.parametrize("year, want", [(2024, date(2024, 2, 29)), (2025, date(2028, 2, 29))])
def test_leap_days_wait(spark, year, want):
    row = spark.createDataFrame([("until 29 February", datetime(year, 1, 5))], "t string, at timestamp_ntz")
    assert row.select(dates.expiry(F.col("t"), F.col("at"))["ends"].alias("d")).first().d == want
