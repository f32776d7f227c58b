"""ISO weeks as columns."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthlight.functions.text import col


def week_bounds(year: int, week: int) -> tuple[dt.date, dt.date]:
    """Monday and Sunday of an ISO week; an invalid week raises ``ValueError``."""
    monday = dt.date.fromisocalendar(year, week, 1)
    return monday, monday + dt.timedelta(days=6)


def week_monday(year, week) -> Column:
    """Monday of an ISO week, null when the ISO year has no such week."""
    y, w = col(year), col(week)
    monday = F.date_add(
        F.date_trunc("week", F.make_date(y, F.lit(1), F.lit(4))).cast("date"), 7 * (w - 1)
    )
    return F.when((w >= 1) & (iso_year(monday) == y), monday)


def week_sunday(year, week) -> Column:
    return F.date_add(week_monday(year, week), 6)


def monday_of(ts) -> Column:
    return F.date_trunc("week", col(ts)).cast("date")


def iso_year(ts) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), col(ts)).cast("int")


def iso_week(ts) -> Column:
    return F.extract(F.lit("WEEK"), col(ts)).cast("int")


def week_label(ts) -> Column:
    """``W3/2024``."""
    return F.format_string("W%d/%d", iso_week(ts), iso_year(ts))


def week_key(ts) -> Column:
    """``2024-W03``."""
    return F.format_string("%d-W%02d", iso_year(ts), iso_week(ts))


def week_range_label(monday) -> Column:
    """``Jan 1–7`` within one month, ``Jan 29–Feb 04`` across two."""
    start = col(monday)
    end = F.date_add(start, 6)
    return F.when(
        F.month(start) == F.month(end),
        F.concat(F.date_format(start, "MMM "), F.dayofmonth(start).cast("string"),
                 F.lit("\u2013"), F.dayofmonth(end).cast("string")),
    ).otherwise(
        F.concat(F.date_format(start, "MMM dd"), F.lit("\u2013"), F.date_format(end, "MMM dd"))
    )


def week_choice(monday) -> Column:
    """``Week 3 (Jan)``."""
    return F.format_string("Week %d (%s)", iso_week(monday), F.date_format(col(monday), "MMM"))


def parse_week(value) -> Column:
    """``Week 3 (Jan)`` or ``3`` to 3."""
    return F.regexp_extract(col(value).cast("string"), r"^\s*(?:.*?Week\s+)?(\d+)", 1).try_cast(
        "int"
    )


def week_calendar(df: DataFrame, year: str) -> DataFrame:
    """All ISO weeks of each year in ``df``: year, week, Monday, choice text."""
    weeks = df.select(year).distinct().select(
        F.col(year).alias("year"), F.explode(F.sequence(F.lit(1), F.lit(53))).alias("week")
    )
    return (
        weeks.withColumn("monday", week_monday("year", "week"))
        .filter(F.col("monday").isNotNull())
        .withColumn("choice", week_choice("monday"))
    )


def week_span(spark: SparkSession, anchor_year: int, anchor_week: int, weeks: int) -> DataFrame:
    """The anchor week and the weeks before it, oldest first: monday, offset."""
    anchor, _ = week_bounds(anchor_year, anchor_week)
    return spark.range(weeks).select(
        F.date_sub(F.lit(anchor), (F.col("id") * 7).cast("int")).alias("monday"),
        F.col("id").cast("int").alias("week_offset"),
    )
