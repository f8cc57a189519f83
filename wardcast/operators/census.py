"""Historical midnight census."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardcast.config import ForecastConfig
from wardcast.functions.dates import midnights, within
from wardcast.functions.keys import Split
from wardcast.plans.staging import Lazy
from wardcast.sources.tables import SourceTables


def census_moves(tables: SourceTables, days: DataFrame, first: date, last: date, cfg: ForecastConfig) -> DataFrame:
    """Census movements of own departments on the given days, ``first`` to ``last`` with both.

    The date range is stated on the stored time as well as on the day, so row
    groups and date partitions outside of it are never read.
    """
    codes = cfg.codes
    moved = F.col("effective_ts")
    stop = last + timedelta(days=1)
    units = (
        tables["department"]
        .where(F.col("service_area") == codes.service_area)
        .select("department_id", "department_name")
    )
    return (
        tables["movement"]
        .where(F.col("event_type_c") == codes.census_event)
        .where(F.col("event_subtype_c") != codes.census_event_cancelled)
        .where(within(moved, first, stop))
        .withColumn("day_date", F.to_date(moved))
        .join(days.where(within(F.col("day_date"), first, stop)).select("day_date"), "day_date")
        .join(units, "department_id")
        .select("csn", F.col("day_date").alias("census_date"), "department_name", moved.alias("census_ts"))
    )


def tagged_census(moves: DataFrame, tags: DataFrame, stage=Lazy(), weight: str | None = None) -> DataFrame:
    """Census movements joined to the tagged encounter they belong to. ``weight`` names the column
    that counts equal movements.

    The tags hold an encounter about once, so an encounter with very many movements only skews
    the movement side. Tags in buckets leave adaptive execution nothing to split, so if
    ``stage`` stores results such encounters are split here.
    """
    split = Split.of(moves, "csn", stage, "heavy_movements")
    copies = F.col("copies") * F.col(weight) if weight else F.col("copies")
    return split.many(moves).join(split.one(tags), split.on).select(
        "csn",
        "census_date",
        midnights(F.to_date("admit_ts"), F.col("census_date")).alias("days_into_admission"),
        "service_group",
        "service_name",
        "Pt_Type",
        "Primary_Procedure",
        "sub_type",
        "severity_level",
        "department_name",
        "census_ts",
        copies.alias("copies"),
    )


def midnight_census(
    tables: SourceTables, days: DataFrame, tags: DataFrame, cfg: ForecastConfig, stage=Lazy()
) -> DataFrame:
    """The census of the whole history, one row for each movement and label set.

    Movements are stored if ``stage`` does so: they are counted and joined, which would make them twice.
    """
    last = cfg.last_census_day - timedelta(days=1)
    moves = stage("moves", census_moves(tables, days, cfg.usable_start, last, cfg))
    return tagged_census(moves, tags, stage)
