"""Adjusted day-of-week calendar.

Weekends and observed holidays form one pseudo weekday (1); Monday to Friday
are 2 to 6. The calendar has one row per day of the run, so its size is set by
the configured dates and never by the data.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardcast.config import ForecastConfig
from wardcast.functions.dates import forecast_day, within


def generated_days(spark: SparkSession, start: date, stop: date, holidays: tuple[date, ...]) -> DataFrame:
    """Days ``start`` to ``stop`` inclusive with workday and holiday flags."""
    observed = F.col("day_date").isin(*holidays) if holidays else F.lit(False)
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(stop))).alias("day_date"))
    return days.select(
        "day_date",
        F.dayofweek("day_date").between(2, 6).cast("int").alias("workday"),
        observed.cast("int").alias("holiday"),
    )


def adjusted_calendar(days: DataFrame, cfg: ForecastConfig) -> DataFrame:
    """Days of the run with their adjusted day of week."""
    free = (F.col("workday") == 0) | ((F.col("workday") == 1) & (F.col("holiday") == 1))
    return days.where(F.col("day_date").between(F.lit(cfg.hist_start), F.lit(cfg.long_end))).select(
        "day_date", F.when(free, 1).otherwise(F.dayofweek("day_date")).alias("dow_adjusted")
    )


def lookback_days(calendar: DataFrame, cfg: ForecastConfig) -> DataFrame:
    """How many days of each adjusted weekday the lookback window holds."""
    return (
        calendar.where(within(F.col("day_date"), cfg.lookback_start, cfg.as_of))
        .groupBy("dow_adjusted")
        .agg(F.count("*").alias("lookback_days"))
    )


def forecast_calendar(calendar: DataFrame, cfg: ForecastConfig) -> DataFrame:
    """Calendar with day numbers and the lookback count of each weekday.

    Weekdays that the window never saw have no average and drop out.
    """
    return calendar.join(lookback_days(calendar, cfg), "dow_adjusted").select(
        "day_date",
        "dow_adjusted",
        "lookback_days",
        forecast_day(cfg.as_of, F.col("day_date")).alias("day_num"),
    )
