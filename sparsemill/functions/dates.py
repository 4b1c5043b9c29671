"""Relative and loosely written dates, as column expressions and for command lines."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_OFFSET = re.compile(r"([+-])(\d+)([ymwd]?)")


def relative_date(written: str, today: Column) -> Column:
    """The date that `written` means on the day `today`.

    Nothing or `today`, `yesterday`, an offset of days such as +3 or -3d, of weeks (w), months (m)
    or years (y), where a day that its month lacks becomes the month's last; else a date as
    year-month-day or year.month.day.
    """
    word = written.strip().lower()
    if word in ("", "today"):
        return today
    if word == "yesterday":
        return F.date_sub(today, 1)
    if m := _OFFSET.fullmatch(word):
        n = int(m[1] + m[2])
        if m[3] in ("y", "m"):
            return F.add_months(today, n * (12 if m[3] == "y" else 1))
        return F.date_add(today, n * (7 if m[3] == "w" else 1))
    return parsed_date(F.lit(written))


def parsed_date(text: Column) -> Column:
    """year-month-day or year.month.day; a day beyond its month's last becomes the last."""
    part = lambda k: F.get(F.split(F.trim(text), "[-.]"), F.lit(k)).cast("int")
    first = F.make_date(part(0), part(1), F.lit(1))
    return F.date_add(first, F.least(part(2), F.dayofmonth(F.last_day(first))) - 1)


def parsed_timestamp(text: Column) -> Column:
    """Year, month, day and, as far as given, hour, minute and second, parted by anything that isn't a digit."""
    parts = F.filter(F.split(text, "[^0-9]+"), lambda x: x != "")
    part = lambda k: F.coalesce(F.get(parts, F.lit(k)).cast("int"), F.lit(0))
    return F.make_timestamp(part(0), part(1), part(2), part(3), part(4), part(5))
