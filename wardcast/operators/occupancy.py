"""Spreading arrivals over the days they stay, and rolling the forecast up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardcast.config import ForecastConfig
from wardcast.functions.dates import forecast_date


def _with_curve(arrivals: DataFrame, curves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Arrivals with the array of their type's curve. Without keys there is one curve, or none."""
    if not keys:
        return arrivals.withColumn("_curve", curves.select("probabilities").scalar()).where("_curve is not null")
    return arrivals.join(curves.select(*keys, F.col("probabilities").alias("_curve")), list(keys))


def spread_occupancy(
    arrivals: DataFrame,
    curves: DataFrame,
    keys: Sequence[str],
    horizon: int | str,
    cfg: ForecastConfig,
) -> DataFrame:
    """Expected heads in bed per arrival group and later day, up to the horizon.

    Arrivals meet their type's curve, an array as of
    :func:`wardcast.operators.survival.curve_arrays`, in one join; the days come out last, as the
    places of the part of the array that is left before the horizon. NULL keys match nothing.
    ``horizon`` may name a column of ``arrivals``.
    """
    limit = F.col(horizon) if isinstance(horizon, str) else F.lit(horizon)
    met = _with_curve(arrivals.where(F.col("arr_day") <= limit), curves, keys)
    left = F.slice("_curve", F.lit(1), (limit - F.col("arr_day") + 1).cast("int"))
    day_num = F.col("arr_day") + F.col("post_arr_day")
    return (
        met.select(*arrivals.columns, F.posexplode(left).alias("post_arr_day", "_probability"))
        .withColumn("days_out", day_num)
        .withColumn("day_date", forecast_date(cfg.as_of, day_num))
        .withColumn("occupancy", F.col("_probability") * F.col("expected"))
        .drop("_probability")
    )


def daily_occupancy(
    arrivals: DataFrame,
    curves: DataFrame,
    keys: Sequence[str],
    horizon: int | str,
    by: Sequence[str] = (),
) -> DataFrame:
    """Expected heads in bed per type and day: arrivals convolved with the curve.

    The sum of :func:`spread_occupancy` over the arrivals of a type, without making its rows:
    arrivals of a type become one array by day, and heads on day d are the sum of arrivals on
    day a times the chance to stay d - a days. ``by`` names further columns to keep apart.
    Days begin with the type's first arrival.
    """
    limit = F.col(horizon) if isinstance(horizon, str) else F.lit(horizon)
    extra = [horizon] if isinstance(horizon, str) else []
    group = [*keys, *by, *extra]
    per_day = arrivals.where(F.col("arr_day") <= limit).groupBy(*group, "arr_day").agg(F.sum("expected").alias("_n"))
    points = F.array_sort(F.collect_list(F.struct("arr_day", "_n")))
    listed = per_day.groupBy(*group).agg(points.alias("_arrivals")).where(F.size("_arrivals") > 0)
    met = _with_curve(listed, curves, keys)
    first = F.get("_arrivals", F.lit(0))["arr_day"]

    def heads(day: Column) -> Column:
        def add(total: Column, one: Column) -> Column:
            stayed = (day - one["arr_day"]).cast("int")
            return total + F.when(stayed >= 0, F.coalesce(F.get("_curve", stayed), F.lit(0.0)) * one["_n"]).otherwise(0.0)

        return F.struct(day.alias("days_out"), F.aggregate("_arrivals", F.lit(0.0), add).alias("occupancy"))

    return met.select(*group, F.inline(F.transform(F.sequence(first, limit), heads))).drop(*extra)


def rollup(
    forecast: DataFrame, streams: Sequence[str] | None = None, statuses: Sequence[str] | None = None
) -> DataFrame:
    """Daily occupancy per patient type, with streams or statuses switched off."""
    kept = forecast
    if streams is not None:
        kept = kept.where(F.col("Pt_Type").isin(*streams))
    if statuses is not None:
        kept = kept.where(F.col("prediction_status").isin(*statuses))
    return kept.groupBy("day_date", "Pt_Type").agg(F.sum("Est_Occupancy").alias("occupancy"))
