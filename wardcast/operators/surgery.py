"""Surgical encounters and the surgery schedule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardcast.config import ForecastConfig
from wardcast.functions.dates import forecast_day, within
from wardcast.functions.keys import KeySet
from wardcast.functions.text import label
from wardcast.plans.staging import Lazy
from wardcast.sources.tables import SourceTables


def earliest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Rows of rank 1 per key, ties included, NULLs first.

    Spark keeps only rank-1 rows per key on the map side already, so a key that
    owns much of the data is cut down before it is shuffled.
    """
    by = W.partitionBy(key).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    return df.withColumn("_rank", F.rank().over(by)).where(F.col("_rank") == 1).drop("_rank")


def _operating_locations(tables: SourceTables, cfg: ForecastConfig) -> DataFrame:
    codes = cfg.codes
    return (
        tables["location"]
        .where(F.col("service_area") == codes.service_area)
        .where(F.col("location_name").isin(*codes.operating_locations))
        .select("location_id", F.col("location_name").alias("surgical_location"))
    )


def _procedures(tables: SourceTables) -> DataFrame:
    return tables["procedure"].withColumnRenamed("procedure_name", "primary_procedure")


def _booked(tables: SourceTables, contacts: DataFrame | None) -> DataFrame:
    """When contacts were entered, of the given rows if they are stored."""
    contacts = tables["contact"] if contacts is None else contacts
    return contacts.select(F.col("csn").alias("contact_csn"), "entry_ts")


def performed_surgeries(
    tables: SourceTables, cfg: ForecastConfig, stage=Lazy(), contacts: DataFrame | None = None
) -> DataFrame:
    """Performed surgeries that were booked before the patient was admitted.

    Log, detail and link share the log id. The encounter is joined before the
    booking contact: ranking per encounter then needs a shuffle of its own, and
    the rows of an encounter with very many surgeries are cut down ahead of it. Where results are
    stored, the performed logs reduce details and links, and the surgeries they make reduce encounters and
    contacts, before any of those is shuffled.
    """
    codes = cfg.codes
    performed = tables["surgery_status"].where(F.col("status_name").isin(*codes.performed_status))
    admitted = (
        tables["encounter"]
        .where(F.col("admit_conf_c").isin(*codes.confirmed_admission))
        .where(F.col("patient_stat_c").isin(*codes.admitted_or_discharged))
        .select("csn", "admit_ts")
    )
    booked = _booked(tables, contacts)
    links = tables["admission_link"].withColumnRenamed("case_id", "log_id")
    details = tables["surgery_log_detail"]
    logs = (
        tables["surgery_log"]
        .where(F.col("not_performed_c").isNull())
        .where(F.col("surgery_ts") >= F.lit(cfg.hist_start))
        .join(performed, "status_c")
        .join(_operating_locations(tables, cfg), "location_id")
        .select("log_id", "surgery_ts", "surgical_location")
    )
    if stage.stores:
        logs = stage("performed_logs", logs)
        wanted = KeySet.of(logs, "log_id", True, lambda blocks: stage("log_filter", blocks))
        details, links = wanted.reduce(details, "log_id"), wanted.reduce(links, "log_id")
    surgeries = (
        logs.join(details, "log_id")
        .join(links, "log_id")
        .withColumn("csn", F.coalesce("admission_csn", "contact_csn"))
        .drop("admission_csn")
    )
    if stage.stores:
        surgeries = stage("performed_surgeries", surgeries)
        admitted = KeySet.of(surgeries, "csn", stored=True).reduce(admitted, "csn")
        booked = KeySet.of(surgeries, "contact_csn", stored=True).reduce(booked, "contact_csn")
    return (
        surgeries.join(_procedures(tables), "procedure_id")
        .join(admitted, "csn")
        .join(booked, "contact_csn")
        .where(F.col("entry_ts") < F.col("admit_ts"))
        .select("csn", "surgery_ts", "entry_ts", "log_id", "primary_procedure", "surgical_location")
    )


def first_procedure(performed: DataFrame) -> DataFrame:
    """First booked surgery of each encounter; equal rows are counted in ``copies``."""
    first = earliest(performed, "csn", "surgery_ts", "entry_ts", "log_id")
    return first.groupBy("csn", "primary_procedure", "surgical_location").agg(F.count("*").alias("copies"))


def surgical_cohort(
    first: DataFrame, encs: DataFrame, deliveries: DataFrame, newborns: DataFrame
) -> DataFrame:
    """First surgeries outside the delivery and newborn cohorts.

    Surgeries whose encounter is not an inpatient stay are kept with an empty
    encounter and a stay of zero days.
    """
    stays = encs.select("csn", F.col("csn").alias("encounter_csn"), "admit_ts", "disch_ts", "los")
    earlier = deliveries.select("csn").union(newborns.select("csn"))
    return (
        first.join(stays, "csn", "left")
        .join(earlier.withColumnRenamed("csn", "encounter_csn"), "encounter_csn", "left_anti")
        .withColumn("los", F.coalesce("los", F.lit(0)))
        .select(
            "csn", "encounter_csn", "admit_ts", "disch_ts", "los",
            "primary_procedure", "surgical_location", "copies",
        )
    )


def scheduled_cases(
    tables: SourceTables,
    current: DataFrame,
    due: DataFrame,
    cfg: ForecastConfig,
    stage=Lazy(),
    contacts: DataFrame | None = None,
) -> DataFrame:
    """First case on the surgery schedule of each patient not yet admitted.

    The first case is taken over all cases since the start of the history, so an
    old case that was never linked to an admission hides later ones, unless
    ``rank_future_only`` is set. Where results are stored, the open cases reduce procedures and links, and
    with their links contacts and encounters, before any of those is shuffled.
    """
    codes = cfg.codes
    primary = (
        tables["case_procedure"].where(F.col("line") == 1).select("case_id", "procedure_id")
    )
    booked = _booked(tables, contacts)
    admitted = tables["encounter"].select("csn", F.col("admit_ts").alias("case_admit_ts"))
    excluded = current.select("pat_id").union(due.select("pat_id")).distinct()
    first_day = cfg.as_of if cfg.rank_future_only else cfg.hist_start
    links = tables["admission_link"]
    cases = (
        tables["surgery_case"]
        .where(F.col("surgery_ts").between(F.lit(first_day), F.lit(cfg.short_end)))
        .where(F.col("sched_status_c").isin(*codes.open_schedule_status))
        .where(F.col("pat_class_c") != codes.outpatient_class)
        .join(_operating_locations(tables, cfg), "location_id")
        .join(excluded, "pat_id", "left_anti")
    )
    if stage.stores:
        cases = stage("open_cases", cases.select("case_id", "pat_id", "log_id", "surgery_ts", "surgical_location"))
        wanted = KeySet.of(cases, "case_id", True, lambda blocks: stage("case_filter", blocks))
        primary, links = wanted.reduce(primary, "case_id"), wanted.reduce(links, "case_id")
    cases = (
        cases.join(primary, "case_id")
        .join(links, "case_id", "left")
        .join(_procedures(tables), "procedure_id")
        .withColumn("csn", F.coalesce("admission_csn", "contact_csn"))
    )
    if stage.stores:
        cases = stage("linked_cases", cases)
        booked = KeySet.of(cases, "contact_csn", stored=True).reduce(booked, "contact_csn")
        admitted = KeySet.of(cases, "csn", stored=True).reduce(admitted, "csn")
    cases = (
        cases.join(booked, "contact_csn", "left")
        .join(admitted, "csn", "left")
        .where(F.col("case_admit_ts").isNull() | (F.col("case_admit_ts") >= F.lit(cfg.as_of)))
    )
    return earliest(cases, "pat_id", "surgery_ts", "entry_ts", "log_id").select(
        "pat_id", "case_id", "primary_procedure", "surgical_location", "surgery_ts"
    )


def scheduled_arrivals(cases: DataFrame, cfg: ForecastConfig) -> DataFrame:
    """Expected surgical admissions per procedure, location and surgery time."""
    upcoming = F.col("surgery_ts").between(F.lit(cfg.as_of), F.lit(cfg.short_end))
    return (
        cases.where(upcoming)
        .groupBy("primary_procedure", "surgical_location", "surgery_ts")
        .agg(F.count("*").cast("double").alias("expected"))
        .withColumn("arr_day", forecast_day(cfg.as_of, F.col("surgery_ts")))
        .withColumn(
            "cat_id",
            label(
                "Periop_Expected_Admits_",
                F.col("surgical_location"),
                "_",
                F.col("primary_procedure"),
                "_day_",
                F.col("arr_day"),
            ),
        )
    )


def scale_schedule(arrivals: DataFrame, factors: DataFrame, keys: list[str]) -> DataFrame:
    """Multiply scheduled arrivals by a factor for cancellations and late additions.

    Types without a factor keep their schedule.
    """
    factor = F.coalesce("factor", F.lit(1.0))
    return (
        arrivals.join(factors.select(*keys, "factor"), keys, "left")
        .withColumn("expected", F.col("expected") * factor)
        .drop("factor")
    )
