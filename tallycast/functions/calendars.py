"""Months, working days, holidays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixed


def month_start(c: Column) -> Column:
    return F.trunc(c, "month")


def month_end(c: Column) -> Column:
    return F.last_day(c)


def future_months(last: Column, months: Column) -> Column:
    """The month starts after ``last``, as an array of ``months`` dates."""
    first = F.trunc(last, "month").cast("date")
    return F.when(
        months >= 1,
        F.sequence(F.add_months(first, 1), F.add_months(first, months.cast("int")), F.expr("interval 1 month")),
    ).otherwise(F.array().cast("array<date>"))


def is_weekday(c: Column) -> Column:
    """Monday to Friday."""
    return F.weekday(c) < 5


def holiday_table(spark: SparkSession, days: list[str] | None = None) -> DataFrame:
    """The holiday calendar as a table of one ``holiday`` column; a few rows a year."""
    days = fixed.HOLIDAYS if days is None else days
    return spark.createDataFrame([(d,) for d in days], "holiday string").select(F.col("holiday").cast("date"))


def flag_business_days(df: DataFrame, holidays: DataFrame, date: str = "date") -> DataFrame:
    """Add ``is_holiday`` and ``is_business_day``. The calendar has one row per holiday and year, so the
    planner broadcasts it by its size; no hint is forced."""
    days = holidays.select(F.col("holiday")).distinct()
    joined = df.join(days, F.col(date) == F.col("holiday"), "left")
    return (
        joined.withColumn("is_holiday", F.col("holiday").isNotNull())
        .withColumn("is_business_day", is_weekday(F.col(date)) & F.col("holiday").isNull())
        .drop("holiday")
    )


def business_days_only(df: DataFrame, holidays: DataFrame, date: str = "date") -> DataFrame:
    """Rows on weekdays that are no holiday."""
    days = holidays.select(F.col("holiday").alias(date))
    return df.filter(is_weekday(F.col(date))).join(days, date, "left_anti")


def holidays_only(df: DataFrame, holidays: DataFrame, date: str = "date") -> DataFrame:
    """Rows that fall on a holiday."""
    return df.join(holidays.select(F.col("holiday").alias(date)), date, "left_semi")
