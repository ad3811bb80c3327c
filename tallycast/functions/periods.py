"""Calendar periods: start date, label, index arithmetic for Y, Q, M and W."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNIT = {"Y": "YEAR", "Q": "QUARTER", "M": "MONTH", "W": "WEEK"}
_MONTHS = {"Y": 12, "Q": 3, "M": 1}


def check_freq(freq: str) -> str:
    if freq not in _UNIT:
        raise ValueError(f"frequency must be one of {sorted(_UNIT)}, not {freq!r}")
    return freq


def period_start(c: Column, freq: str) -> Column:
    """First day of the period that holds the date; weeks run Monday to Sunday."""
    return F.trunc(c.cast("date"), _UNIT[check_freq(freq)])


def period_label(start: Column, freq: str) -> Column:
    """Text of a period given its first day: 2021, 2021Q1, 2021-01, 2021-01-04/2021-01-10."""
    if freq == "Y":
        return F.date_format(start, "yyyy")
    if freq == "Q":
        return F.concat(F.date_format(start, "yyyy"), F.lit("Q"), F.quarter(start).cast("string"))
    if check_freq(freq) == "M":
        return F.date_format(start, "yyyy-MM")
    return F.concat_ws("/", start.cast("string"), F.date_add(start, 6).cast("string"))


def ordinal(start: Column, freq: str) -> Column:
    """Whole number that grows by one from a period to the next."""
    if freq == "W":
        return F.floor(F.datediff(start, F.lit("1970-01-05").cast("date")) / 7).cast("int")
    months = F.year(start) * 12 + F.month(start) - 1
    return F.floor(months / _MONTHS[check_freq(freq)]).cast("int")


def shift(start: Column, k: Column, freq: str) -> Column:
    """First day of the period k periods later."""
    if check_freq(freq) == "W":
        return F.date_add(start, (k * 7).cast("int"))
    return F.add_months(start, (k * _MONTHS[freq]).cast("int"))
