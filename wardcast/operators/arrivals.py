"""Arrivals predicted from the lookback average."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardcast.config import ForecastConfig
from wardcast.functions.dates import within


def predict_arrivals_dow(
    population: DataFrame,
    arrival_ts: str,
    keys: Sequence[str],
    calendar: DataFrame,
    cfg: ForecastConfig,
    weight: str | None = None,
) -> DataFrame:
    """Average arrivals per adjusted weekday over the lookback window, per key.

    The divisor is the number of such days in the window, with or without
    arrivals. The window is a filter on the arrival time itself, so it reaches
    the scan; arrivals are counted per day before they meet the calendar.
    """
    counted = F.sum(weight) if weight else F.count("*")
    per_day = (
        population.where(within(F.col(arrival_ts), cfg.lookback_start, cfg.as_of))
        .groupBy(*keys, F.to_date(arrival_ts).alias("day_date"))
        .agg(counted.alias("_n"))
    )
    return (
        per_day.join(calendar.select("day_date", "dow_adjusted", "lookback_days"), "day_date")
        .groupBy(*keys, "dow_adjusted")
        .agg(
            (F.sum("_n").cast("double") / F.max("lookback_days").cast("double")).alias("expected"),
        )
    )


def predict_arrivals_daily(
    by_dow: DataFrame, calendar: DataFrame, horizon: int | Column
) -> DataFrame:
    """The weekday averages laid out over the coming days 1..horizon."""
    limit = horizon if isinstance(horizon, Column) else F.lit(horizon)
    days = calendar.where(F.col("day_num") >= 1).select("dow_adjusted", F.col("day_num").alias("arr_day"))
    return by_dow.join(days, "dow_adjusted").where(F.col("arr_day") <= limit)
