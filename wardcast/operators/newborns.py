"""Newborn cohort and the newborns to expect per delivery."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardcast.config import ForecastConfig
from wardcast.functions.dates import open_or_since
from wardcast.functions.text import label
from wardcast.operators.obstetrics import NORMAL

NOT_BORN_HERE = "Not birth encounter"


def mothers_by_day(deliveries: DataFrame) -> DataFrame:
    """Deliveries a newborn admitted on ``near_day`` can belong to, counted.

    A birth counts for its own day and the day on either side, which turns the
    one-day tolerance into an equality on patient and day: the keys the rows are
    counted by, map side first, and then joined on. A patient has one status.
    """
    near = F.explode(F.array(*[F.date_add(F.to_date("birth_ts"), n) for n in (-1, 0, 1)]))
    return (
        deliveries.where(F.col("birth_ts").isNotNull())
        .select("pat_id", "csn", "ob_status", near.alias("near_day"))
        .groupBy("pat_id", "near_day")
        .agg(
            F.count("*").alias("copies"),
            F.min("csn").alias("mother_csn"),
            F.max("ob_status").alias("ob_status"),
        )
    )


def newborn_cohort(
    encs: DataFrame, patient: DataFrame, deliveries: DataFrame, cfg: ForecastConfig
) -> DataFrame:
    """Newborn-unit encounters with the status of the mother's delivery.

    One row per encounter; ``copies`` is the number of deliveries it matches
    (1 when none), ``mother_csn`` the first of them.
    """
    mothers = mothers_by_day(deliveries).select(
        F.col("pat_id").alias("mother_pat_id"),
        F.col("near_day").alias("admit_day"),
        "ob_status",
        "copies",
        "mother_csn",
    )
    return (
        encs.where(F.col("department_name").isin(*cfg.codes.newborn_departments))
        .where(F.col("disch_ts").isNull() | (F.col("admit_ts") >= F.lit(cfg.usable_start)))
        .select("csn", "pat_id", "department_name", "admit_ts", "disch_ts", "los")
        .join(patient, "pat_id", "left")
        .withColumn("admit_day", F.to_date("admit_ts"))
        .join(mothers, ["mother_pat_id", "admit_day"], "left")
        .select(
            "csn",
            "pat_id",
            "department_name",
            "admit_ts",
            "disch_ts",
            "los",
            F.coalesce("ob_status", F.lit(NOT_BORN_HERE)).alias("newborn_status"),
            F.coalesce("copies", F.lit(1)).alias("copies"),
            "mother_csn",
        )
    )


def yield_ratio(deliveries: DataFrame, newborns: DataFrame) -> DataFrame:
    """Newborns per delivery, by status.

    A newborn takes its mother's status, so two small counts replace the join of
    newborns to mothers; both inputs hold an encounter once.
    """
    mothers = deliveries.groupBy("ob_status").agg(F.count("csn").alias("mothers"))
    babies = newborns.groupBy(F.col("newborn_status").alias("ob_status")).agg(F.count("csn").alias("babies"))
    n_babies = F.coalesce("babies", F.lit(0))
    return mothers.join(babies, "ob_status", "left").select(
        "ob_status",
        n_babies.alias("babies"),
        "mothers",
        (n_babies.cast("double") / F.col("mothers").cast("double")).alias("babies_per_delivery"),
    )


def yield_by_location(newborns: DataFrame, ratio: DataFrame, cfg: ForecastConfig) -> DataFrame:
    """Newborns per delivery, by status and unit; other statuses are predicted instead."""
    known = ratio.where(F.col("ob_status").isin(cfg.codes.high_risk_marker, NORMAL))
    babies = newborns.groupBy("department_name", F.col("newborn_status").alias("ob_status")).agg(
        F.count("csn").alias("babies")
    )
    return babies.join(known.select("ob_status", "mothers"), "ob_status").select(
        "department_name",
        "ob_status",
        (F.col("babies").cast("double") / F.col("mothers").cast("double")).alias("babies_per_delivery"),
    )


def derived_newborns(expected: DataFrame, by_location: DataFrame, cfg: ForecastConfig) -> DataFrame:
    """Newborn arrivals that follow from the expected deliveries."""
    return expected.join(by_location, "ob_status").select(
        (F.col("expected").cast("double") * F.col("babies_per_delivery")).alias("expected"),
        "ob_status",
        "arr_day",
        "department_name",
        label(
            f"Neonate_{cfg.site}_",
            F.col("ob_status"),
            "_",
            F.col("department_name"),
            "_DAY_",
            F.col("arr_day"),
        ).alias("cat_id"),
    )
