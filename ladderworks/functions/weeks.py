"""Packed ISO weeks (yyyyww) as column expressions. Week 53 counts as week 52, so both form one rating period."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def packed_week(day: Column, clip: bool = True) -> Column:
    """Date to yyyyww of its ISO year; ``clip`` puts week 53 into week 52. Null stays null."""
    week = F.weekofyear(day)
    return (F.extract(F.lit("YEAROFWEEK"), day) * 100 + (F.least(week, F.lit(52)) if clip else week)).cast("int")


def split_week(week: Column) -> tuple[Column, Column]:
    return F.floor(week / 100).cast("int"), (week % 100).cast("int")


def week_sunday(week: Column) -> Column:
    """The Sunday that ends a packed week."""
    year, number = split_week(week)
    return F.date_add(F.trunc(F.make_date(year, F.lit(1), F.lit(4)), "WEEK").cast("date"), ((number - 1) * 7 + 6).cast("int"))


def week_monday(week: Column) -> Column:
    return F.date_sub(week_sunday(week), 6)


def weeks_between(earlier: Column, later: Column) -> Column:
    """Whole weeks from one packed week to another, never below 0."""
    return F.greatest(F.lit(0), F.floor(F.datediff(week_sunday(later), week_sunday(earlier)) / 7).cast("int"))


def parse_date(text: Column) -> Column:
    """ISO dates, else day first with years of four or two digits; two-digit years from 69 on are 19yy."""
    text = F.trim(text)
    short = F.regexp_extract(text, r"^(\d{1,2})/(\d{1,2})/(\d{2})$", 3)
    year = F.when(short.cast("int") >= 69, short.cast("int") + 1900).otherwise(short.cast("int") + 2000)
    day, month = F.regexp_extract(text, r"^(\d{1,2})/", 1), F.regexp_extract(text, r"^\d{1,2}/(\d{1,2})/", 1)
    full = F.regexp_extract(text, r"^\d{1,2}/\d{1,2}/(\d{4})$", 1)
    written = lambda y: F.try_to_date(F.concat_ws("-", y.cast("string"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")
    return F.when(short != "", written(year)).when(full != "", written(full)).otherwise(F.try_to_date(text, "yyyy-MM-dd"))


def season_of(day: Column) -> Column:
    """The year that a season starting in July began in."""
    return F.year(day) - (F.month(day) < 7).cast("int")
