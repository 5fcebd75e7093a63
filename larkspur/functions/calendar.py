"""Fiscal calendar."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def year_end_month(mmdd: Column) -> Column:
    """Month of an ``MMDD`` field; December if it is missing or no month."""
    month = F.when(mmdd.rlike(r"^\d{4}$"), F.substring(mmdd, 1, 2).try_cast("int"))
    return F.when(month.between(1, 12), month).otherwise(12)


def fiscal_year(day: Column, end_month: Column) -> Column:
    """Calendar year in which the fiscal year ends, by months."""
    return F.year(day) + F.when(F.month(day) <= end_month, 0).otherwise(1)


def fiscal_quarter(day: Column, end_month: Column) -> Column:
    """Quarter, counted back from the end of the fiscal year."""
    end = F.last_day(F.make_date(fiscal_year(day, end_month), end_month, F.lit(1)))
    left = F.bround(F.datediff(end, day) / 91.25).cast("int")
    return F.concat(F.lit("Q"), F.greatest(F.lit(1), F.least(F.lit(4), 4 - left)).cast("string"))
