"""Dates: 'YYYYMMDD' strings, 'd/Mon/YYYY' log dates, decimal years."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .missing import col

#: Methods that `call` may name.
CALLS = {"weekday": F.weekday, "year": F.year, "month": F.month, "day": F.dayofmonth, "yearday": F.dayofyear, "isoweek": F.weekofyear}


def today() -> Column:
    return F.date_format(F.current_date(), "yyyyMMdd")


def dt(s, call: str | None = None) -> Column:
    d = F.try_to_date(col(s), "yyyyMMdd")
    return CALLS[call](d) if call else d


def decimalize(s) -> Column:
    """year + (month - 1) / 12 + day / 31 / 12; missing for ''."""
    d = dt(s)
    return F.year(d) + (F.month(d) - 1) / 12 + F.dayofmonth(d) / 31 / 12


def str2date(s) -> Column:
    """A log date, with or without a time after ':'."""
    return F.to_date(F.split(col(s), ":")[0], "d/MMM/yyyy")


def days_since(s, since) -> Column:
    base = str2date(F.lit(since)) if isinstance(since, str) else since
    return F.datediff(str2date(s), base)
