"""Calendar helpers: Monday weeks, seasons, month windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def to_monday(c: Column | str) -> Column:
    """Monday of the week as a date; text that is no date is null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.date_trunc("week", c.try_cast("timestamp")).cast("date")


def season_name(month: Column) -> Column:
    return (
        F.when(month.isin(12, 1, 2), "Winter")
        .when(month.isin(3, 4, 5), "Spring")
        .when(month.isin(6, 7, 8), "Summer")
        .otherwise("Fall")
    )


def add_period_fields(df: DataFrame, week: str = "week") -> DataFrame:
    """year, month, year_month, quarter, year_quarter, season, season_year, year_season.

    Quarters read Q1 and 2024-Q1. December counts to the following year's winter.
    """
    d = F.col(week)
    return df.withColumns(
        {
            "year": F.year(d),
            "month": F.month(d),
            "year_month": F.date_format(d, "yyyy-MM"),
            "quarter": F.concat(F.lit("Q"), F.quarter(d).cast("string")),
            "year_quarter": F.concat(F.year(d).cast("string"), F.lit("-Q"), F.quarter(d).cast("string")),
            "season": season_name(F.month(d)),
            "season_year": F.year(d) + F.when(F.month(d) == 12, 1).otherwise(0),
        }
    ).withColumn("year_season", F.concat(F.col("season_year").cast("string"), F.lit("-"), F.col("season")))


def month_windows(spark: SparkSession, start: str, end: str) -> DataFrame:
    """(first_day, last_day, label) for every calendar month touched by [start, end]."""
    months = F.explode(
        F.sequence(
            F.date_trunc("month", F.lit(start).cast("timestamp")).cast("date"),
            F.lit(end).cast("date"),
            F.expr("interval 1 month"),
        )
    )
    return (
        spark.range(1)
        .select(months.alias("first_day"))
        .select(
            "first_day",
            F.last_day("first_day").alias("last_day"),
            F.date_format("first_day", "yyyy-MM").alias("label"),
        )
    )


def in_window(df: DataFrame, start: str | None = None, end: str | None = None, week: str = "week") -> DataFrame:
    """Inclusive date window, either side open; reaches the scan as a partition filter."""
    if start is not None and end is not None and start > end:
        raise ValueError("start is after end")
    if start is not None:
        df = df.filter(F.col(week) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.filter(F.col(week) <= F.lit(end).cast("date"))
    return df
