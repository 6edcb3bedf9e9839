"""Column helpers that carry the engine's null, division and window rules."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(c: str | Column) -> Column:
    """A double in which NaN is missing."""
    d = col(c).cast("double")
    return F.when(~F.isnan(d), d)


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b; missing where b is zero or missing."""
    return F.try_divide(col(a), F.nullif(col(b), F.lit(0.0)))


def change(now: str | Column, before: str | Column) -> Column:
    """(now - before) / before, missing where before is zero or missing."""
    return ratio(col(now) - col(before), before)


def by_symbol(*keys: str) -> WindowSpec:
    return Window.partitionBy(*(keys or ("symbol",))).orderBy("date")


def last_rows(n: int, *keys: str) -> WindowSpec:
    return by_symbol(*keys).rowsBetween(-(n - 1), 0)


def full(aggregate, c: str | Column, n: int) -> Column:
    """An aggregate over the last n rows, missing until they hold n values."""
    over = last_rows(n)
    return F.when(F.count(col(c)).over(over) == n, aggregate(col(c)).over(over))


def past_return(c: str = "close", n: int = 1) -> Column:
    return ratio(F.col(c), F.lag(c, n).over(by_symbol())) - 1


def forward_return(c: str = "close", n: int = 1) -> Column:
    return ratio(F.lead(c, n).over(by_symbol()), F.col(c)) - 1


def yes(c: Column) -> Column:
    """A condition in which a missing value is false."""
    return F.coalesce(c, F.lit(False))


def regime(c: str | Column) -> Column:
    r = col(c)
    return F.when(r >= 0, "rising").when(r < 0, "falling").otherwise("unknown")


def period_split(date: str | Column, unseen_start: str | None) -> Column:
    if unseen_start is None:
        return F.lit("full_sample")
    return F.when(col(date) >= F.lit(unseen_start).cast("date"), "unseen").otherwise("selection")


def after_close(date: str | Column) -> Column:
    """When what a day's bar shows is known: that day at 18:10, UTC+3."""
    return F.concat(F.date_format(col(date), "yyyy-MM-dd"), F.lit("T18:10:00+03:00"))


def local_date(stamp: str | Column) -> Column:
    """The calendar date of a time stamp as it is written."""
    return F.substring(col(stamp), 1, 10).cast("date")


def utc_date(stamp: str | Column) -> Column:
    """The UTC date of a time stamp with a zone."""
    return F.to_date(F.to_timestamp(col(stamp)))
