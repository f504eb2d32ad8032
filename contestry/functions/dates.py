"""Refit dates: a regular grid from one step before a test window."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def refit_dates(start: str, end: str, every: int) -> list[str]:
    """Every so many days from one step before the start, up to the end."""
    day, last, out = datetime.date.fromisoformat(start) - datetime.timedelta(days=every), datetime.date.fromisoformat(end), []
    while day <= last:
        out.append(day.isoformat())
        day += datetime.timedelta(days=every)
    return out


def refit_date(day: Column, start: str, every: int) -> Column:
    """The latest grid date not after a day, by arithmetic: the grid is regular. Null before the grid."""
    first = F.date_sub(F.lit(start).cast("date"), every)
    n = F.floor(F.datediff(day, first) / every).cast("int")
    return F.when(n >= 0, F.date_add(first, n * every))
