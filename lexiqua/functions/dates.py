"""Calendar arithmetic on DATE columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Date formats in the order that they are tried.
FORMATS = ["yyyy-M-d", "yyyy/M/d", "d-M-yyyy", "d/M/yyyy"]


def parse_date(c: Column) -> Column:
    """The first format that fits; null where none does."""
    return F.coalesce(*(F.try_to_date(F.trim(c), f) for f in FORMATS), F.try_to_date(F.trim(c)))


def format_date(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def weekday_name(c: Column) -> Column:
    return F.date_format(c, "EEEE")


def add_business_days(d: Column, n: Column) -> Column:
    """``n`` weekdays on (back, if negative); 0 stays, even on a weekend.

    In closed form: whole weeks, then the days left from the weekday that counting starts on.
    """
    forward, k, day = n > 0, F.abs(n), F.weekday(d)
    # From a weekend, counting starts as if from Friday (forward) or Monday (back).
    start = F.when(day < 5, d).when(forward, F.date_sub(d, day - 4)).otherwise(F.date_add(d, 7 - day))
    at = F.when(day < 5, day).when(forward, F.lit(4)).otherwise(F.lit(0))
    weeks, left = F.floor(k / 5).cast("int"), F.pmod(k, F.lit(5)).cast("int")
    more = weeks * 7 + left + F.when(forward & (at + left > 4) | ~forward & (at - left < 0), 2).otherwise(0)
    return F.when(n == 0, d).when(forward, F.date_add(start, more)).otherwise(F.date_sub(start, more))


def add_months(d: Column, n: Column) -> Column:
    """The same day ``n`` months on, or the month's last."""
    return F.add_months(d, n)


def diff_parts(a: Column, b: Column) -> Column:
    """``a - b`` as years, months and days; the sign is on the years only."""
    hi, lo = F.greatest(a, b), F.least(a, b)
    days = F.day(hi) - F.day(lo)
    borrow = days < 0
    months = F.month(hi) - F.month(lo) - borrow.cast("int")
    years = F.year(hi) - F.year(lo) - (months < 0).cast("int")
    return F.struct(
        (F.when(a < b, -1).otherwise(1) * years).alias("years"), F.pmod(months, F.lit(12)).alias("months"),
        F.when(borrow, days + F.day(F.last_day(F.add_months(hi, -1)))).otherwise(days).alias("days"),
    )
