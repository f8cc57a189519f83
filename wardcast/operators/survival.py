"""Empirical survival curves and what they say about patients already in bed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def curve_arrays(
    stays: DataFrame,
    keys: Sequence[str],
    horizon: int | str,
    weight: str | None = None,
) -> DataFrame:
    """One row per key: how many stays, and on each day 0..horizon how many are still in bed.

    ``numerators`` and ``probabilities`` hold day n at place n. A stay counts on day ``n``
    when its ``los`` exceeds ``n``; a stay without a length counts in the denominator only,
    and NULL is a key value like others.

    The stays are first counted per key and length, with every length past the
    horizon in one bucket, so what leaves the map side is at most horizon + 2
    rows per key however large the group. A fold over those few counts lays down the curve:
    each bucket fills the days since the previous one.

    ``horizon`` may name a column that is constant within a key.
    """
    limit = F.col(horizon) if isinstance(horizon, str) else F.lit(horizon)
    extra = [horizon] if isinstance(horizon, str) else []
    group = [*keys, *extra]
    bucket = F.greatest(F.least(F.coalesce("los", F.lit(0)), limit + 1), F.lit(0)).cast("int")
    counted = F.sum(weight) if weight else F.count("*")
    histogram = stays.groupBy(*group, bucket.alias("_bucket")).agg(counted.alias("_n"))
    return curves_of(histogram, group, limit)


def curves_of(histogram: DataFrame, group: Sequence[str], limit: Column) -> DataFrame:
    """The curves of counted stays: ``_n`` stays of length ``_bucket`` per group, no length
    twice, those past the limit at limit + 1."""
    counts = F.array_sort(F.collect_list(F.struct("_bucket", "_n")))
    counted = histogram.groupBy(*group).agg(F.sum("_n").alias("denominator"), counts.alias("_counts"))
    start = F.struct(
        F.lit(0).alias("day"), F.col("denominator").alias("left"), F.array().cast("array<bigint>").alias("curve")
    )

    def fill(so_far: Column, next_: Column) -> Column:
        days = F.array_repeat(so_far["left"], next_["_bucket"] - so_far["day"])
        return F.struct(
            next_["_bucket"].alias("day"),
            (so_far["left"] - next_["_n"]).alias("left"),
            F.concat(so_far["curve"], days).alias("curve"),
        )

    def finish(so_far: Column) -> Column:
        return F.concat(so_far["curve"], F.array_repeat(so_far["left"], limit + 1 - so_far["day"]))

    total = F.col("denominator").cast("double")
    return (
        counted.where(F.col("denominator").isNotNull())
        .withColumn("numerators", F.aggregate("_counts", start, fill, finish))
        .withColumn("probabilities", F.transform("numerators", lambda n: n.cast("double") / total))
        .drop("_counts")
    )


def by_day(curves: DataFrame) -> DataFrame:
    """Curves laid out with one row per day."""
    keys = [c for c in curves.columns if c not in ("denominator", "numerators", "probabilities")]
    return curves.select(*keys, "denominator", F.posexplode("numerators").alias("day_num", "numerator")).select(
        *keys,
        "day_num",
        "denominator",
        "numerator",
        (F.col("numerator").cast("double") / F.col("denominator").cast("double")).alias("probability"),
    )


def from_days(days: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Curves kept by day (``day_num`` from 0 without gaps, ``probability``) as arrays."""
    points = F.array_sort(F.collect_list(F.struct("day_num", "probability")))
    return days.groupBy(*keys).agg(F.transform(points, lambda x: x["probability"]).alias("probabilities"))


def survival_curve(
    stays: DataFrame,
    keys: Sequence[str],
    horizon: int | str,
    weight: str | None = None,
) -> DataFrame:
    """Share of stays still in bed on each day 0..horizon, per key: :func:`curve_arrays`
    with a row per day."""
    return by_day(curve_arrays(stays, keys, horizon, weight))


def conditional_occupancy(
    current: DataFrame, curves: DataFrame, match: str, horizon: int, curve_days: int
) -> DataFrame:
    """Expected presence of current inpatients for each day 0..horizon from now.

    After m days in bed the chance to stay n more is P(m + n) / P(m), two places of one
    array; where P(m) is 0 nothing is known and the patient is assumed to stay. ``curves``
    are arrays as of :func:`curve_arrays`, so the patients meet them in one join by type and
    days are made after it. Curves may be kept per finer group than ``match``; a value found
    in several groups yields every pairing.

    Patients beyond the end of the curves are assumed to stay, and patients whose type has
    no curve drop out.
    """
    stayed = F.col("days_into_admission")
    shared = curves.groupBy(match).agg(F.collect_list("probabilities").alias("_curves"))
    so_far, ahead = F.get("_so_far", stayed), F.sequence(F.lit(0), F.least(F.lit(horizon), F.lit(curve_days) - stayed))

    def chance(days: Column) -> Column:
        known = F.get("_later", stayed + days) / so_far
        return F.struct(days.alias("days_out"), F.when(so_far > 0, known).otherwise(F.lit(1.0)).alias("probability"))

    known = (
        current.where(stayed <= curve_days)
        .join(shared, match)
        .withColumn("_so_far", F.explode("_curves"))
        .withColumn("_later", F.explode("_curves"))
        .select(*current.columns, F.inline(F.transform(ahead, chance)))
    )
    beyond = (
        current.where(stayed > curve_days)
        .withColumn("days_out", F.explode(F.sequence(F.lit(0), F.lit(horizon))))
        .withColumn("probability", F.lit(1.0))
    )
    return known.unionByName(beyond)
