"""The whole forecast: source tables in, one occupancy table out."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardcast.config import ForecastConfig
from wardcast.functions.dates import forecast_date
from wardcast.functions.rows import repeat_rows
from wardcast.functions.text import label
from wardcast.operators import (
    arrivals,
    calendar,
    census,
    emergency,
    encounters,
    newborns,
    obstetrics,
    occupancy,
    profile,
    surgery,
    survival,
    transfers,
)
from wardcast.operators.profile import (
    EMERGENCY,
    NEWBORN,
    NOT_APPLICABLE,
    OB,
    OTHER,
    SURGICAL,
    TRANSFER,
    TYPE_KEYS,
)
from wardcast.plans.history import CensusHistory, StayHistory
from wardcast.plans.staging import Lazy, Tables
from wardcast.sources.tables import SourceTables

# Fixed values of the forecast table.
CURRENT = "Currently Admitted Patients"
PREDICTED = "Predicted Admissions"
EXPECTED = "Expected Admissions"
HISTORY = "Historical Census"

OUTPUT_COLUMNS = [
    "Uniq_ID",
    "Days_Out",
    "day_date",
    "Est_Occupancy",
    "Pt_Type",
    "arrival_day",
    "post_arr_day",
    "prediction_status",
    "Primary_Procedure",
    "sub_type",
    "severity_level",
]


class Forecast:
    """One forecast run. Each property is a DataFrame; only staged ones run early.

    ``stage`` receives the results that several parts read: by default they are
    written to the shared folder, those with a row per encounter in buckets by it; with :class:`~wardcast.plans.staging.Lazy`
    everything stays one query plan.

    ``census`` and ``stays`` are what earlier runs left; with them only days that are new are read
    from the movements, and counted for the curves of services.
    """

    def __init__(
        self,
        tables: SourceTables,
        cfg: ForecastConfig,
        stage=None,
        census: CensusHistory | None = None,
        stays: StayHistory | None = None,
    ):
        self.tables = tables
        self.cfg = cfg
        self.census_history = census
        self.stay_history = stays
        self.stage = stage if stage is not None else Tables(tables.spark)

    # -- days ------------------------------------------------------------

    @cached_property
    def days(self) -> DataFrame:
        """The calendar table if the source has one, else generated days."""
        if self.tables.has("calendar"):
            return self.tables["calendar"]
        cfg = self.cfg
        return calendar.generated_days(self.tables.spark, cfg.hist_start, cfg.long_end, cfg.holidays)

    @cached_property
    def calendar(self) -> DataFrame:
        return calendar.forecast_calendar(calendar.adjusted_calendar(self.days, self.cfg), self.cfg)

    # -- who arrived, and how ---------------------------------------------

    @cached_property
    def encounters(self) -> DataFrame:
        return self.stage("encounters", encounters.encounters(self.tables, self.cfg, self.stage), by="csn")

    @cached_property
    def patient_status(self) -> DataFrame:
        contacts = obstetrics.prior_contacts(self.tables, self.cfg, self.stage)
        return self.stage("patient_status", obstetrics.patient_status(contacts, self.cfg))

    @cached_property
    def deliveries(self) -> DataFrame:
        t = self.tables
        cohort = obstetrics.delivery_cohort(
            self.encounters, t["delivery"], t["delivery_type"], self.patient_status, self.cfg
        )
        return self.stage("deliveries", cohort)

    @cached_property
    def newborns(self) -> DataFrame:
        return newborns.newborn_cohort(self.encounters, self.tables["patient"], self.deliveries, self.cfg)

    @cached_property
    def bookings(self) -> DataFrame:
        """When each contact was entered. What needs surgeries and the schedule makes it first, so that
        both read what is stored."""
        return self.stage("bookings", self.tables["contact"].select("csn", "entry_ts"))

    def _contacts(self) -> DataFrame:
        return self.bookings if "bookings" in self.__dict__ else self.tables["contact"]

    @cached_property
    def first_surgeries(self) -> DataFrame:
        performed = surgery.performed_surgeries(self.tables, self.cfg, self.stage, self._contacts())
        return surgery.first_procedure(performed)

    @cached_property
    def transfers(self) -> DataFrame:
        return transfers.transfer_admissions(
            transfers.transfer_requests(self.tables, self.cfg, self.stage),
            transfers.transfer_destinations(self.tables, self.cfg, self.stage),
        )

    @cached_property
    def profile(self) -> DataFrame:
        return self.stage(
            "profile",
            profile.encounter_profile(
                self.encounters,
                self.deliveries,
                self.newborns,
                self.first_surgeries,
                self.transfers,
                emergency.emergency_admissions(self.tables, self.cfg, self.stage),
                emergency.acuity_labels(self.tables["acuity"]),
                self.cfg,
            ),
            by="csn",
        )

    @cached_property
    def members(self) -> DataFrame:
        return profile.memberships(self.profile, self.cfg)

    @cached_property
    def recent_members(self) -> DataFrame:
        """Cohort rows of the predicted streams that the lookback window can count."""
        recent = profile.recent_arrivals(self.profile, self.cfg)
        return profile.memberships(recent, self.cfg).where("is_predicted")

    @cached_property
    def current(self) -> DataFrame:
        return encounters.current_inpatients(self.encounters, self.cfg)

    # -- how long they stay -------------------------------------------------

    @cached_property
    def curves(self) -> DataFrame:
        """Survival curves of all patient types as arrays, each up to its own horizon."""
        keys = [*TYPE_KEYS, "horizon"]
        discharged = self.profile.where(F.col("disch_ts").isNotNull())
        rows = profile.memberships(discharged, self.cfg).where("in_curve").select(*keys, "los", "copies")
        if self.cfg.include_non_admitted:
            rows = rows.unionByName(self._never_admitted())
        return survival.curve_arrays(rows, TYPE_KEYS, "horizon", weight="copies")

    def _never_admitted(self) -> DataFrame:
        """Performed surgeries without an inpatient stay, as stays of zero days."""
        return self.first_surgeries.join(self.profile.select("csn"), "csn", "left_anti").select(
            F.lit(SURGICAL).alias("Pt_Type"),
            F.col("primary_procedure").alias("Primary_Procedure"),
            F.col("surgical_location").alias("sub_type"),
            F.lit(NOT_APPLICABLE).alias("severity_level"),
            F.lit(self.cfg.horizon).alias("horizon"),
            F.lit(0).alias("los"),
            "copies",
        )

    @cached_property
    def service_curves(self) -> DataFrame:
        """Survival curves per service as arrays, for patients already in bed."""
        if (kept := self.stay_history) is not None:
            kept.update(self.encounters, "disch_ts", self.cfg.hist_start, self.cfg.as_of)
            return kept.curves(self.cfg.hist_start, self.cfg.as_of, self.cfg.curve_days)
        discharged = self.encounters.where(F.col("disch_ts") < F.lit(self.cfg.as_of))
        return survival.curve_arrays(discharged, ["service_group", "service_name"], self.cfg.curve_days)

    # -- who will arrive ------------------------------------------------------

    @cached_property
    def due(self) -> DataFrame:
        due = obstetrics.expected_due(self.patient_status, self.deliveries, self.current, self.cfg)
        return self.stage("due", due)

    @cached_property
    def expected_deliveries(self) -> DataFrame:
        return obstetrics.expected_deliveries(self.due, self.cfg)

    @cached_property
    def expected_newborns(self) -> DataFrame:
        born = self.profile.where(F.col("newborn_status").isNotNull())
        delivered = self.profile.where(F.col("ob_status").isNotNull())
        ratio = newborns.yield_ratio(delivered, born)
        return newborns.derived_newborns(
            self.expected_deliveries, newborns.yield_by_location(born, ratio, self.cfg), self.cfg
        )

    @cached_property
    def expected_surgeries(self) -> DataFrame:
        cases = surgery.scheduled_cases(
            self.tables, self.current, self.due, self.cfg, self.stage, self._contacts()
        )
        return surgery.scheduled_arrivals(cases, self.cfg)

    @cached_property
    def expected(self) -> DataFrame:
        """Arrivals known in advance, in the common arrival layout."""
        cfg, na = self.cfg, F.lit(NOT_APPLICABLE)

        def layout(df, pt_type, procedure, sub_type, severity, horizon):
            return df.select(
                F.lit(pt_type).alias("Pt_Type"),
                procedure.alias("Primary_Procedure"),
                sub_type.alias("sub_type"),
                severity.alias("severity_level"),
                F.lit(horizon).alias("horizon"),
                "cat_id",
                "arr_day",
                F.col("expected").cast("double").alias("expected"),
                F.lit(EXPECTED).alias("prediction_status"),
            )

        status, unit = F.col("ob_status"), F.col("department_name")
        where, what = F.col("surgical_location"), F.col("primary_procedure")
        return (
            layout(self.expected_deliveries, OB, na, status, na, cfg.horizon_long)
            .unionByName(layout(self.expected_newborns, NEWBORN, na, status, unit, cfg.horizon))
            .unionByName(layout(self.expected_surgeries, SURGICAL, what, where, na, cfg.horizon))
        )

    @cached_property
    def predicted(self) -> DataFrame:
        """Arrivals predicted from the lookback window, in the common arrival layout."""
        keys = [*TYPE_KEYS, "horizon"]
        by_dow = arrivals.predict_arrivals_dow(
            self.recent_members, "arrival_ts", keys, self.calendar, self.cfg, weight="copies"
        )
        return arrivals.predict_arrivals_daily(by_dow, self.calendar, F.col("horizon")).select(
            *keys,
            predicted_label(self.cfg).alias("cat_id"),
            "arr_day",
            "expected",
            F.lit(PREDICTED).alias("prediction_status"),
        )

    # -- the forecast -----------------------------------------------------------

    @cached_property
    def arriving_daily(self) -> DataFrame:
        """Heads per type and day by patients still to arrive, without a row per arrival group."""
        _ = self.bookings
        return occupancy.daily_occupancy(
            self.predicted.unionByName(self.expected), self.curves, TYPE_KEYS, "horizon", ["prediction_status"]
        )

    @cached_property
    def arriving_rows(self) -> DataFrame:
        """Occupancy by patients still to arrive."""
        spread = occupancy.spread_occupancy(
            self.predicted.unionByName(self.expected), self.curves, TYPE_KEYS, "horizon", self.cfg
        )
        return spread.select(
            F.col("cat_id").alias("Uniq_ID"),
            F.col("days_out").alias("Days_Out"),
            "day_date",
            F.col("occupancy").alias("Est_Occupancy"),
            "Pt_Type",
            F.col("arr_day").alias("arrival_day"),
            "post_arr_day",
            "prediction_status",
            "Primary_Procedure",
            "sub_type",
            "severity_level",
        )

    @cached_property
    def current_tagged(self) -> DataFrame:
        """Current inpatients with their arrival labels; only direct admissions
        count as transfers."""
        tags = profile.tag_source(self.profile, direct_only=True, dedupe=self.cfg.dedupe)
        return encounters.in_bed(tags, self.cfg)

    @cached_property
    def current_rows(self) -> DataFrame:
        """Occupancy by patients already in bed."""
        cfg = self.cfg
        chances = survival.conditional_occupancy(
            self.current_tagged, self.service_curves, "service_name", cfg.horizon, cfg.curve_days
        )
        stayed = F.col("days_into_admission")
        return repeat_rows(chances).select(
            F.col("csn").cast("string").alias("Uniq_ID"),
            F.col("days_out").alias("Days_Out"),
            forecast_date(cfg.as_of, F.col("days_out")).alias("day_date"),
            F.col("probability").alias("Est_Occupancy"),
            "Pt_Type",
            (-stayed).alias("arrival_day"),
            (stayed + F.col("days_out")).alias("post_arr_day"),
            F.lit(CURRENT).alias("prediction_status"),
            "Primary_Procedure",
            "sub_type",
            "severity_level",
        )

    @cached_property
    def history(self) -> DataFrame:
        tags = profile.tag_source(self.profile, direct_only=False, dedupe=self.cfg.dedupe)
        if (kept := self.census_history) is not None:
            kept.update(self.tables, self.days, self.cfg)
            return census.tagged_census(kept.moves(self.cfg), tags, self.stage, weight="weight")
        return census.midnight_census(self.tables, self.days, tags, self.cfg, self.stage)

    @cached_property
    def history_rows(self) -> DataFrame:
        """Historical midnight census, one head per row."""
        return repeat_rows(self.history).select(
            F.col("csn").cast("string").alias("Uniq_ID"),
            F.lit(None).cast("int").alias("Days_Out"),
            F.col("census_date").alias("day_date"),
            F.lit(1.0).alias("Est_Occupancy"),
            "Pt_Type",
            F.lit(None).cast("int").alias("arrival_day"),
            F.col("days_into_admission").alias("post_arr_day"),
            F.lit(HISTORY).alias("prediction_status"),
            "Primary_Procedure",
            "sub_type",
            "severity_level",
        )

    @cached_property
    def rows(self) -> DataFrame:
        """Forecast and history in the output layout."""
        _ = self.bookings
        return (
            self.current_rows.unionByName(self.arriving_rows).unionByName(self.history_rows).select(*OUTPUT_COLUMNS)
        )


def predicted_label(cfg: ForecastConfig) -> Column:
    """Arrival label of predicted streams. Fixed formats."""
    stream, day = F.col("Pt_Type"), F.col("arr_day")
    sub_type, severity = F.col("sub_type"), F.col("severity_level")
    known = F.coalesce(severity, F.lit("NULL"))
    return (
        F.when(stream == OB, label(f"OB_No_{cfg.site}_Prenatal_Care_DAY_", day))
        .when(stream == NEWBORN, label(f"Neonate_{cfg.site}_", sub_type, "_", severity, "_DAY_", day))
        .when(stream == TRANSFER, label("DIRECT_ADMIT_GRP_", known, "_DAY_", day))
        .when(stream == EMERGENCY, label("ED_ESI_", known, sub_type, "_DAY_", day))
        .when(stream == OTHER, label("OTHER_DAY_", day))
    )
