"""Calendar columns."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def day(c: Column | str) -> Column:
    return F.to_date(c)


def week(c: Column | str) -> Column:
    """The Monday of the ISO week."""
    return F.to_date(F.date_trunc("week", c))


def month(c: Column | str) -> Column:
    return F.to_date(F.date_trunc("month", c))


def iso_week_label(c: Column) -> Column:
    """2024-W03."""
    year = F.extract(F.lit("YEAROFWEEK"), c).cast("string")
    return F.concat(year, F.lit("-W"), F.lpad(F.weekofyear(c).cast("string"), 2, "0"))


def boundary_minutes(start: Column, end: Column) -> Column:
    """Minute boundaries crossed: 00:00:59 to 00:01:01 is 1."""
    # expr keeps the arithmetic whole: both sides are whole minutes.
    a, b = F.date_trunc("minute", start), F.date_trunc("minute", end)
    return ((F.unix_timestamp(b) - F.unix_timestamp(a)) / 60).cast("bigint")


def sunday_first(c: Column | str) -> Column:
    """0 for Sunday ... 6 for Saturday."""
    return F.dayofweek(c) - 1


def period_end(start: Column, unit: str) -> Column:
    """Last day of the week or month that begins at ``start``."""
    return F.date_add(start, 6) if unit == "week" else F.last_day(start)


_WINDOW = re.compile(r"^(?:last)?\s*(\d+)\s*([hdwm])$")


def parse_window(text: str) -> dt.timedelta | None:
    """'24h', '7d', '2w', '3m' (a month is 30 days), with or without 'last'; None if it is none."""
    m = _WINDOW.match((text or "").strip().lower())
    if not m or not int(m[1]):
        return None
    n = int(m[1])
    return {"h": dt.timedelta(hours=n), "d": dt.timedelta(days=n), "w": dt.timedelta(weeks=n), "m": dt.timedelta(days=30 * n)}[m[2]]
