"""One row per encounter with everything known about how the patient arrived.

Cohorts exclude each other, so instead of joining every cohort against all
earlier ones, each encounter collects its evidence once and the cohorts become
filters on that row. All joins here are on the encounter id: the encounters are
shuffled once, and each kind of evidence holds an encounter at most once (equal
rows are counted, and the lists hold only distinct type labels).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardcast.config import ForecastConfig
from wardcast.functions.dates import open_or_since, within
from wardcast.operators.obstetrics import NORMAL

# Fixed values of the forecast table.
OB = "OB"
NEWBORN = "Neonate"
SURGICAL = "Surgical Admit"
TRANSFER = "Direct Admit (External Transfer)"
EMERGENCY = "ED"
OTHER = "Other"
NOT_APPLICABLE = "N/A"
ED_TRANSFER = "ED-to-ED Transfer"
ED_NO_TRANSFER = "Not a transfer"

TYPE_KEYS = ["Pt_Type", "Primary_Procedure", "sub_type", "severity_level"]


def encounter_profile(
    encs: DataFrame,
    deliveries: DataFrame,
    newborns: DataFrame,
    first_surgeries: DataFrame,
    transfers: DataFrame,
    emergencies: DataFrame,
    acuity: DataFrame,
    cfg: ForecastConfig,
) -> DataFrame:
    """Encounters with their cohort evidence, earlier cohorts taking precedence."""
    ob = deliveries.select("csn", "ob_status", "birth_ts", "delivery_type")
    neo = newborns.select("csn", "newborn_status", F.col("copies").alias("newborn_copies"), "mother_csn")
    surgeries = first_surgeries.groupBy("csn").agg(
        F.collect_list(F.struct("primary_procedure", "surgical_location", "copies")).alias("surgeries")
    )
    kind = F.struct("request_type", "transfer_type", "copies")
    is_direct = F.col("direct_admit") == 1
    requests = transfers.groupBy("csn").agg(
        F.collect_list(F.when(is_direct, kind)).alias("direct_transfers"),
        F.collect_list(F.when(~is_direct, kind)).alias("other_transfers"),
        F.sum(F.when(~is_direct, F.col("copies"))).alias("forwarded"),
    )

    born = F.col("ob_status").isNotNull() | F.col("newborn_status").isNotNull()
    operated = ~born & F.col("surgeries").isNotNull()
    requested = F.col("direct_transfers").isNotNull()
    transferred = ~born & ~operated & requested
    from_ed = (
        ~born
        & ~operated
        & F.col("ed_events").isNotNull()
        & (~requested | F.col("forwarded").isNotNull())
    )
    # An encounter's emergency rows: its events, once per forwarding transfer if there are any.
    ed_rows = F.col("ed_events") * F.coalesce("forwarded", F.lit(1))
    residual = ~born & ~operated & ~transferred & ~from_ed & open_or_since(F.col("disch_ts"), cfg.usable_start)

    return (
        encs.join(ob, "csn", "left")
        .join(neo, "csn", "left")
        .join(surgeries, "csn", "left")
        .join(requests, "csn", "left")
        .join(emergencies, "csn", "left")
        .join(acuity, "acuity_c", "left")
        .select(
            *encs.columns,
            "ob_status",
            "birth_ts",
            "delivery_type",
            "newborn_status",
            "newborn_copies",
            "mother_csn",
            F.when(operated, F.col("surgeries")).alias("surgeries"),
            F.when(transferred, F.col("direct_transfers")).alias("direct_transfers"),
            F.when(transferred, F.col("other_transfers")).alias("other_transfers"),
            F.when(from_ed, ed_rows).alias("ed_copies"),
            F.when(
                from_ed, F.when(requested, ED_TRANSFER).otherwise(ED_NO_TRANSFER)
            ).alias("ed_transfer"),
            F.when(from_ed, F.col("acuity_level")).alias("acuity_level"),
            residual.alias("is_other"),
        )
    )


def _membership(
    pt_type: str,
    procedure,
    sub_type,
    severity,
    copies,
    arrival_ts: Column,
    in_curve: Column,
    is_predicted: Column,
    horizon: int,
) -> Column:
    def text(c):
        return (F.lit(c) if isinstance(c, str) else c).cast("string")

    return F.struct(
        F.lit(pt_type).alias("Pt_Type"),
        text(procedure).alias("Primary_Procedure"),
        text(sub_type).alias("sub_type"),
        text(severity).alias("severity_level"),
        copies.cast("long").alias("copies"),
        arrival_ts.alias("arrival_ts"),
        in_curve.alias("in_curve"),
        is_predicted.alias("is_predicted"),
        F.lit(horizon).alias("horizon"),
    )


def recent_arrivals(profile: DataFrame, cfg: ForecastConfig) -> DataFrame:
    """Encounters that any stream can count in the lookback window.

    A superset chosen on stored columns, so that the scan skips older data.
    """
    admitted = within(F.col("admit_ts"), cfg.lookback_start, cfg.as_of)
    left_ed = within(F.col("ed_departure_ts"), cfg.lookback_start, cfg.as_of)
    return profile.where(admitted | left_ed)


def memberships(profile: DataFrame, cfg: ForecastConfig) -> DataFrame:
    """Cohort rows: one per encounter and patient type it belongs to.

    ``in_curve`` marks the discharges the survival curve of that type is built
    from, ``is_predicted`` the types whose arrivals come from the lookback
    average. All streams come out of a single pass over the profile.
    """
    na = NOT_APPLICABLE
    admit = F.col("admit_ts")
    discharged = F.col("disch_ts").isNotNull()
    in_history = (
        discharged & (F.col("disch_ts") >= F.lit(cfg.usable_start)) & (F.col("disch_ts") < F.lit(cfg.as_of))
    )
    yes, no, one = F.lit(True), F.lit(False), F.lit(1)
    ob, neo = F.col("ob_status"), F.col("newborn_status")
    short = cfg.horizon

    single = F.array(
        F.when(
            ob.isNotNull(),
            _membership(
                OB, na, ob, na, one, admit, in_history, ob == cfg.no_prenatal_status, cfg.horizon_long
            ),
        ),
        F.when(
            neo.isNotNull(),
            _membership(
                NEWBORN, na, neo, F.col("department_name"), F.col("newborn_copies"), admit, in_history,
                ~neo.isin(cfg.codes.high_risk_marker, NORMAL), short,
            ),
        ),
        F.when(
            F.col("ed_copies").isNotNull(),
            _membership(
                EMERGENCY, na, F.col("ed_transfer"), F.col("acuity_level"), F.col("ed_copies"),
                F.col("ed_departure_ts"), discharged, yes, short,
            ),
        ),
        F.when(F.col("is_other"), _membership(OTHER, na, na, na, one, admit, discharged, yes, short)),
    )
    surgeries = F.transform(
        "surgeries",
        lambda s: _membership(
            SURGICAL, s["primary_procedure"], s["surgical_location"], na, s["copies"], admit, discharged, no, short
        ),
    )
    transfers = F.transform(
        "direct_transfers",
        lambda t: _membership(
            TRANSFER, na, t["request_type"], t["transfer_type"], t["copies"], admit, discharged, yes, short
        ),
    )
    none = F.slice(single, 1, 0)
    present = F.concat(single, F.coalesce(surgeries, none), F.coalesce(transfers, none))
    out = profile.select("csn", "los", "disch_ts", F.explode(F.array_compact(present)).alias("m")).select(
        "csn", "los", "disch_ts", "m.*"
    )
    return out.withColumn("copies", F.lit(1).cast("long")) if cfg.dedupe else out


def tag_source(profile: DataFrame, direct_only: bool, dedupe: bool = False) -> DataFrame:
    """Arrival source and labels of every encounter, by fixed precedence.

    With ``direct_only`` only direct admissions count as transfers. An encounter
    that several rows of a cohort describe comes out once per distinct label set,
    with the number of equal rows in ``copies``; with ``dedupe`` it comes out once, with
    the first of its label sets in the order of their values.
    """
    requests = F.col("direct_transfers") if direct_only else F.concat("direct_transfers", "other_transfers")
    one = F.lit(1).cast("long")
    chosen = (lambda labels: F.slice(F.sort_array(labels), 1, 1)) if dedupe else (lambda labels: labels)
    source = (
        F.when(F.col("ob_status").isNotNull(), OB)
        .when(F.col("newborn_status").isNotNull(), NEWBORN)
        .when(F.col("ed_copies").isNotNull(), EMERGENCY)
        .when(F.col("t").isNotNull(), TRANSFER)
        .when(F.col("s").isNotNull(), SURGICAL)
        .otherwise(OTHER)
    )
    copies = (
        F.coalesce("newborn_copies", one)
        * F.coalesce("ed_copies", one)
        * F.coalesce(F.col("t.copies"), one)
        * F.coalesce(F.col("s.copies"), one)
    )
    newborn_unit = F.when(F.col("newborn_status").isNotNull(), F.col("department_name"))
    return (
        profile.withColumn("t", F.explode_outer(chosen(requests)))
        .withColumn("s", F.explode_outer(chosen(F.col("surgeries"))))
        .select(
            "csn",
            "pat_id",
            "account_id",
            "admit_ts",
            "disch_ts",
            "service_group",
            "service_name",
            source.alias("Pt_Type"),
            F.coalesce(F.col("s.primary_procedure"), F.lit(NOT_APPLICABLE)).alias("Primary_Procedure"),
            F.coalesce(
                "ob_status", "newborn_status", "ed_transfer", F.col("t.request_type"), F.lit(NOT_APPLICABLE)
            ).alias("sub_type"),
            F.coalesce(
                newborn_unit, F.col("acuity_level"), F.col("t.transfer_type"), F.lit(NOT_APPLICABLE)
            ).alias("severity_level"),
            (one if dedupe else copies).alias("copies"),
        )
    )


def arrival_order(profile: DataFrame) -> DataFrame:
    """Cohort of each encounter when built in order, each excluding the earlier ones.

    The order differs from the tagging precedence: surgery and transfer are
    settled before the emergency department.
    """
    cohort = (
        F.when(F.col("ob_status").isNotNull(), OB)
        .when(F.col("newborn_status").isNotNull(), NEWBORN)
        .when(F.col("surgeries").isNotNull(), SURGICAL)
        .when(F.col("direct_transfers").isNotNull(), TRANSFER)
        .when(F.col("ed_copies").isNotNull(), EMERGENCY)
        .when(F.col("is_other"), OTHER)
    )
    return profile.select("csn", "admit_ts", "disch_ts", "los", cohort.alias("cohort"))
