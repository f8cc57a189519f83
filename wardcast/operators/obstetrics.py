"""Prenatal contacts, patient status, deliveries and expected deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardcast.config import ForecastConfig
from wardcast.functions.dates import forecast_day
from wardcast.functions.keys import KeySet, Split
from wardcast.functions.text import label
from wardcast.plans.staging import Lazy
from wardcast.sources.tables import SourceTables

NORMAL = "Normal"


def prior_contacts(tables: SourceTables, cfg: ForecastConfig, stage=Lazy()) -> DataFrame:
    """Kept prenatal contacts with the due date and risk flag they carry.

    Due dates are collapsed per contact before they meet the contacts, so every
    join adds columns to a contact and none multiplies it. What is known of an episode is
    one row before the links meet it, in one join. If ``stage`` stores results, the kept contacts
    reduce the links and those the episodes before any of them is shuffled, and an episode with very
    many links is split.
    """
    codes = cfg.codes
    own_departments = tables["department"].where(F.col("service_area") == codes.service_area)
    high_risk = F.when(F.col("provider_name").contains(codes.high_risk_marker), codes.high_risk_marker)
    kept = (
        tables["contact"]
        .where(F.col("appt_status_c").isin(*codes.kept_appointment))
        .where(F.col("contact_ts").between(F.lit(cfg.hist_start), F.lit(cfg.as_of)))
        .join(own_departments, "department_id", "left_semi")
        .join(tables["appt_status"], "appt_status_c")
        .join(tables["provider"], "provider_id")
        .select("csn", "contact_ts", "pat_id", "appt_status", high_risk.alias("high_risk"))
    )
    due, episodes, links = tables["due_date"], tables["episode"], tables["episode_link"]
    if stage.stores:
        kept = stage("kept_contacts", kept)
        links = stage("kept_links", KeySet.of(kept, "csn", stored=True).reduce(links, "csn"))
        linked = KeySet.of(links, "episode_id", True, lambda blocks: stage("episode_filter", blocks))
        due, episodes = linked.reduce(due, "episode_id"), linked.reduce(episodes, "episode_id")
    due = (
        due.where(F.col("is_working") == codes.working_due_date)
        .groupBy("episode_id")
        .agg(F.max("due_user_ts").alias("due_user_ts"), F.max("due_system_ts").alias("due_system_ts"))
        .join(episodes, "episode_id", "left_semi")
    )
    split = Split.of(links, "episode_id", stage, "heavy_episodes")
    due_by_contact = (
        split.many(links)
        .join(split.one(due), split.on)
        .groupBy("csn")
        .agg(F.max("due_user_ts").alias("due_user_ts"), F.max("due_system_ts").alias("due_system_ts"))
    )
    return kept.join(due_by_contact, "csn").select(
        "csn",
        "contact_ts",
        "pat_id",
        F.coalesce("due_user_ts", "due_system_ts").alias("due_ts"),
        "appt_status",
        F.lit(codes.working_due_date).alias("is_working"),
        "high_risk",
    )


def patient_status(contacts: DataFrame, cfg: ForecastConfig) -> DataFrame:
    """Risk status and the due date of the latest contact, per patient.

    The latest contact is found inside the aggregate, so the contacts are not
    joined to themselves. Among contacts at the same time the latest due date wins.
    """
    latest = F.max(F.struct("contact_ts", "due_ts"))
    any_high_risk = F.max(F.col("high_risk").isNotNull())
    return contacts.groupBy("pat_id").agg(
        F.when(any_high_risk, cfg.codes.high_risk_marker).otherwise(NORMAL).alias("ob_status"),
        latest["contact_ts"].alias("last_contact_ts"),
        latest["due_ts"].alias("due_ts"),
    )


def delivery_cohort(
    encs: DataFrame,
    delivery: DataFrame,
    delivery_type: DataFrame,
    status: DataFrame,
    cfg: ForecastConfig,
) -> DataFrame:
    """Encounters with a delivery, and patients in labour now, with risk status."""
    typed = F.col("delivery_type").isNotNull()
    births = (
        delivery.join(delivery_type, "method_c", "left")
        .groupBy("csn")
        .agg(
            F.max("birth_ts").alias("any_birth_ts"),
            F.max(F.when(typed, F.col("birth_ts"))).alias("typed_birth_ts"),
            F.max("delivery_type").alias("delivery_type"),
        )
    )
    in_labour = (F.col("department_name") == cfg.codes.labour_department) & F.col("disch_ts").isNull()
    return (
        encs.where(F.col("admit_ts") >= F.lit(cfg.ob_start))
        .select("csn", "pat_id", "department_name", "admit_ts", "disch_ts", "los")
        .join(births, "csn", "left")
        .where(typed | in_labour)
        .join(status.select("pat_id", "ob_status"), "pat_id", "left")
        .select(
            "csn",
            "admit_ts",
            "disch_ts",
            "los",
            "pat_id",
            F.when(in_labour, F.col("any_birth_ts")).otherwise(F.col("typed_birth_ts")).alias("birth_ts"),
            "delivery_type",
            F.coalesce("ob_status", F.lit(cfg.no_prenatal_status)).alias("ob_status"),
        )
    )


def expected_due(
    status: DataFrame, deliveries: DataFrame, current: DataFrame, cfg: ForecastConfig
) -> DataFrame:
    """Patients due within the long horizon who neither delivered lately nor are in bed.

    The reporting day is a constant, so "delivered within a gestation before it"
    is a plain filter on the deliveries and one anti-join excludes both groups.
    """
    age = F.datediff(F.lit(cfg.as_of), "birth_ts")
    delivered = deliveries.where(age.between(0, cfg.gestation_days)).select("pat_id")
    excluded = delivered.union(current.select("pat_id")).distinct()
    return (
        status.where(F.col("due_ts").between(F.lit(cfg.as_of), F.lit(cfg.long_end)))
        .join(excluded, "pat_id", "left_anti")
        .select("pat_id", "due_ts", "ob_status")
    )


def expected_deliveries(due: DataFrame, cfg: ForecastConfig) -> DataFrame:
    """Expected delivery admissions per status and due time.

    ``due`` holds a patient at most once, so a plain count is the distinct count.
    """
    when = F.to_date("due_ts") if cfg.truncate_due else F.col("due_ts")
    return (
        due.groupBy("ob_status", when.alias("due_ts"))
        .agg(F.count("pat_id").alias("expected"))
        .select(
            "ob_status",
            "expected",
            forecast_day(cfg.as_of, F.col("due_ts")).alias("arr_day"),
        )
        .withColumn(
            "cat_id", label("OB_Expected_Admits_", F.col("ob_status"), "_day_", F.col("arr_day"))
        )
    )
