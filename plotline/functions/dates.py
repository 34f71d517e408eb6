"""Date parsing, calendar features and output formats."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["parse_yy_mon", "parse_mm_yyyy", "parse_iso", "date_parts", "calendar_flags",
           "is_quarter_end", "cyclic_month", "format_iso", "format_mon_yy", "month_spine"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_yy_mon(x) -> Column:
    """``"11-Jan"`` -> 2011-01-01.  Two-digit years pivot like C/pandas ``%y``:
    69-99 -> 1969-1999, 00-68 -> 2000-2068 (Spark alone would read 99 as 2099)."""
    d = F.to_date(_c(x), "yy-MMM")
    return F.when(F.year(d) >= 2069, F.add_months(d, -1200)).otherwise(d)


def parse_mm_yyyy(x) -> Column:
    """``"03/2017"`` -> 2017-03-01."""
    return F.to_date(_c(x), "MM/yyyy")


def parse_iso(x) -> Column:
    return F.to_date(_c(x))


def date_parts(d) -> list[Column]:
    d = _c(d)
    return [F.year(d).alias("year"), F.month(d).alias("month"), F.quarter(d).alias("quarter")]


def is_quarter_end(d) -> Column:
    """1 only on the last day of March/June/September/December."""
    d = _c(d)
    return ((d == F.last_day(d)) & F.month(d).isin(3, 6, 9, 12)).cast("int")


def cyclic_month(d) -> list[Column]:
    m = F.month(_c(d)).cast("double")
    ang = F.lit(2 * math.pi) * m / F.lit(12.0)
    return [F.sin(ang).alias("month_sin"), F.cos(ang).alias("month_cos")]


def calendar_flags(d, post_year: int = 2013) -> list[Column]:
    d = _c(d)
    return [(F.month(d) == 12).cast("int").alias("is_december"),
            F.month(d).isin(6, 7, 8).cast("int").alias("is_summer"),
            is_quarter_end(d).alias("is_quarter_end"),
            (F.year(d) > post_year).cast("int").alias("post_%d" % post_year)]


def format_iso(d) -> Column:
    return F.date_format(_c(d), "yyyy-MM-dd")


def format_mon_yy(d) -> Column:
    return F.date_format(_c(d), "MMM yy")


def month_spine(last, months: int) -> Column:
    """Array of the ``months`` month starts after ``last`` (a first-of-month DATE)."""
    return F.sequence(F.add_months(_c(last), 1), F.add_months(_c(last), months),
                      F.expr("INTERVAL 1 MONTH"))
