"""Service catalogue, inpatient encounters and the patients in bed on ``as_of``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardcast.config import ForecastConfig
from wardcast.functions.dates import midnights, open_or_since
from wardcast.functions.text import has_service_code, service_group
from wardcast.plans.staging import Lazy
from wardcast.sources.tables import SourceTables


def service_groups(service_code: DataFrame) -> DataFrame:
    """Services whose abbreviation carries a unit code, with the text before it."""
    return service_code.where(has_service_code(F.col("service_abbr"))).select(
        "service_c",
        "service_name",
        "service_abbr",
        service_group(F.col("service_abbr")).alias("service_group"),
    )


def encounters(tables: SourceTables, cfg: ForecastConfig, stage=Lazy()) -> DataFrame:
    """Confirmed inpatient encounters that ended within the history or are open.

    Every filter is on the encounter scan itself; department, unit group and
    service are lookups, joined in whichever way their measured size allows. The units are a join
    themselves, whose size Spark overestimates; stored, they are known to be small from the start, so that
    the encounters are not shuffled for them.
    """
    codes = cfg.codes
    inpatient = tables["unit_group"].where(F.col("unit_group_name").isNotNull()).select("unit_group_c")
    units = stage(
        "units", tables["department"].join(inpatient, "unit_group_c").select("department_id", "department_name")
    )
    services = service_groups(tables["service_code"]).select("service_c", "service_name", "service_group")
    return (
        tables["encounter"]
        .where(F.col("service_area") == codes.service_area)
        .where(F.col("admit_conf_c").isin(*codes.confirmed_admission))
        .where(F.col("patient_stat_c").isin(*codes.admitted_or_discharged))
        .where(open_or_since(F.col("disch_ts"), cfg.hist_start))
        .join(units, "department_id")
        .join(services, "service_c", "left")
        .select(
            "csn",
            "pat_id",
            "service_group",
            "service_name",
            "admit_ts",
            "disch_ts",
            midnights(F.col("admit_ts"), F.col("disch_ts")).alias("los"),
            "ed_departure_ts",
            "acuity_c",
            "pat_class_c",
            "account_id",
            "service_c",
            "department_name",
        )
    )


def in_bed(encs: DataFrame, cfg: ForecastConfig) -> DataFrame:
    """Encounters in bed at the start of ``as_of``, with whole days already stayed."""
    present = (F.col("admit_ts") < F.lit(cfg.as_of)) & open_or_since(F.col("disch_ts"), cfg.as_of)
    admit_date = F.to_date("admit_ts")
    return (
        encs.where(present)
        .withColumn("admit_date", admit_date)
        .withColumn("days_into_admission", midnights(admit_date, F.lit(cfg.as_of)) - 1)
    )


def current_inpatients(encs: DataFrame, cfg: ForecastConfig) -> DataFrame:
    """Who is in bed at the start of ``as_of``."""
    return in_bed(encs, cfg).select(
        "csn", "account_id", "pat_id", "admit_date", "days_into_admission", "service_group", "service_name"
    )
