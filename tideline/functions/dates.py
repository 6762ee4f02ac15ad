"""Dates as feeds write them, as column expressions.  ``now`` is always an argument."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def coerce_date(c: Column, now: dt.datetime) -> Column:
    """A day from epoch seconds or milliseconds, an ISO date or time (in its own offset), or a month and day.

    Anything else is null.  A string of digits is an epoch.  A day without a year is the
    latest one no more than a day after ``now``.
    """
    text = F.trim(c.cast("string"))
    seconds = F.when(text.rlike(r"^\d+$"), text.try_cast("double"))
    seconds = F.when(seconds > 1e11, seconds / 1000.0).otherwise(seconds)
    epoch = F.when(seconds < 253402300800.0, F.date_add(F.lit(dt.date(1970, 1, 1)), F.floor(seconds / 86400).cast("int")))
    iso_form = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}(?::\d{2}(?::\d{2}(?:[.,]\d+)?)?)?(?:Z|[+-]\d{2}:?\d{2})?)?$"
    iso = F.when(text.rlike(iso_form), F.substring(text, 1, 10).try_cast("date"))
    return F.when(text.rlike(r"^\d+$"), epoch).otherwise(F.coalesce(iso, _yearless(text, now)))


def _yearless(text: Column, now: dt.datetime) -> Column:
    form = r"^([A-Za-z]{3,9})\.?\s+(\d{1,2})$"
    name = F.lower(F.substring(F.regexp_extract(text, form, 1), 1, 3))
    month = F.nullif(F.array_position(F.array(*(F.lit(m) for m in MONTHS)), name), F.lit(0))
    day = F.nullif(F.regexp_extract(text, form, 2), F.lit("")).try_cast("int")
    limit = F.lit((now + dt.timedelta(days=1)).date())

    def in_year(year: int) -> Column:
        made = F.format_string("%04d-%02d-%02d", F.lit(year), month.cast("int"), day).try_cast("date")
        return F.when(month.isNotNull() & day.isNotNull() & (made <= limit), made)

    return F.coalesce(in_year(now.year), in_year(now.year - 1))


def mmddyyyy(day: Column) -> Column:
    return F.coalesce(F.date_format(day, "MMddyyyy"), F.lit(""))


def iso_date(text: Column) -> Column:
    """MMDDYYYY as an ISO date; anything else is empty."""
    y = F.concat_ws("-", F.substring(text, 5, 4), F.substring(text, 1, 2), F.substring(text, 3, 2))
    return F.coalesce(F.when(text.rlike(r"^\d{8}$"), y.try_cast("date").cast("string")), F.lit(""))
