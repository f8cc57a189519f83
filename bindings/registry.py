"""Named queries: each runs operators on the test tables, next to its SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindings.oracle import AS_OF, BACK, FAR, statement
from bindings.order_tables import CONFIG, source_tables
from wardcast.functions.dates import within
from wardcast.functions.rows import repeat_rows
from wardcast.operators import (
    arrivals,
    calendar,
    encounters,
    newborns,
    obstetrics,
    occupancy,
    profile,
    surgery,
    survival,
    transfers,
)
from wardcast.operators.profile import EMERGENCY, OB, OTHER, TYPE_KEYS
from wardcast.plans.forecast import Forecast
from wardcast.plans.history import CensusHistory, StayHistory
from wardcast.plans.staging import Lazy, Tables
from wardcast.sources.sink import read_forecast, write_forecast
from wardcast.sources.tables import SourceTables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
BUILDS: dict[str, Callable[[Forecast], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    """Register a query that takes an unstaged forecast over the test tables."""

    def register(build: Callable[[Forecast], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Forecast(source_tables(spark, sf_dir), CONFIG, Lazy()))
        BUILDS[name] = build
        SQL[name] = statement(sql)
        return build

    return register


def staged_query(name: str, sql: str, by_order: bool = True):
    """Register a query that reads the whole forecast, with its results staged, and before them the orders and
    lines that the source tables are made of, unless it needs few of those (``by_order``)."""

    def run(build: Callable[[Forecast], DataFrame], spark: SparkSession, sf_dir: str) -> DataFrame:
        stage = Tables(spark)
        return build(Forecast(source_tables(spark, sf_dir, stage if by_order else Lazy()), CONFIG, stage))

    def register(build: Callable[[Forecast], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: run(build, spark, sf_dir)
        BUILDS[name] = build
        SQL[name] = statement(sql)
        return build

    return register


# -- calendar and encounters ------------------------------------------------------


@query("q01_service_groups", "SELECT service_c, service_name, service_abbr, service_group FROM services")
def _(f):
    return encounters.service_groups(f.tables["service_code"])


@query(
    "q02_adjusted_calendar",
    """SELECT c.day_date, c.dow AS dow_adjusted, count(e.csn) AS admissions
       FROM cal_days c LEFT JOIN enc e ON CAST(e.admit_ts AS DATE) = c.day_date GROUP BY c.day_date, c.dow""",
)
def _(f):
    per_day = f.encounters.groupBy(F.to_date("admit_ts").alias("day_date")).agg(F.count("*").alias("n"))
    days = calendar.adjusted_calendar(f.days, f.cfg)
    return days.join(per_day, "day_date", "left").select(
        "day_date", "dow_adjusted", F.coalesce("n", F.lit(0)).alias("admissions")
    )


@query(
    "q02b_stored_calendar",
    f"""SELECT c.day_date, c.dow AS dow_adjusted, b.n_days AS lookback_days,
               CAST(date_diff('day', {AS_OF}, c.day_date) + 1 AS INTEGER) AS day_num
        FROM kept_days c JOIN (
            SELECT dow, count(*) AS n_days FROM kept_days WHERE day_date >= {BACK} AND day_date < {AS_OF} GROUP BY dow) b
          ON b.dow = c.dow""",
)
def _(f):
    # A calendar table with flags of its own, made of the days on which somebody was admitted.
    days = f.tables["encounter"].groupBy(F.to_date("admit_ts").alias("day_date")).agg(
        F.when(F.count("*") % 5 == 0, 0).otherwise(1).alias("workday"),
        F.when(F.min("csn") % 7 == 0, 1).otherwise(0).alias("holiday"),
    )
    tables = SourceTables(f.tables.spark, lambda name: days if name == "calendar" else f.tables[name])
    return Forecast(tables, f.cfg, Lazy()).calendar


@query(
    "q03_lookback_days",
    f"""SELECT c.dow AS dow_adjusted, b.n_days AS lookback_days, count(*) AS admissions
        FROM enc e JOIN cal_days c ON c.day_date = CAST(e.admit_ts AS DATE) JOIN cal_back b ON b.dow = c.dow
        WHERE e.admit_ts >= {BACK} AND e.admit_ts < {AS_OF} GROUP BY c.dow, b.n_days""",
)
def _(f):
    admitted = f.encounters.where(within(F.col("admit_ts"), f.cfg.lookback_start, f.cfg.as_of))
    per_day = admitted.groupBy(F.to_date("admit_ts").alias("day_date")).agg(F.count("*").alias("n"))
    return (
        per_day.join(f.calendar, "day_date")
        .groupBy("dow_adjusted", "lookback_days")
        .agg(F.sum("n").alias("admissions"))
    )


@query(
    "q04_encounters",
    """SELECT csn, pat_id, service_group, service_name, admit_ts, disch_ts, los, ed_departure_ts, acuity_c, department_name
       FROM enc""",
)
def _(f):
    return f.encounters.drop("pat_class_c", "account_id", "service_c")


@query(
    "q05_current_inpatients",
    "SELECT csn, account_id, pat_id, admit_date, days_into_admission, service_group, service_name FROM cur",
)
def _(f):
    return f.current


# -- deliveries and newborns ----------------------------------------------------------


@query(
    "q06_prior_contacts",
    "SELECT csn, contact_ts, pat_id, due_ts, appt_status, is_working, high_risk FROM visits",
)
def _(f):
    return obstetrics.prior_contacts(f.tables, f.cfg)


@query("q07_patient_status", "SELECT pat_id, ob_status, last_contact_ts, due_ts FROM care")
def _(f):
    return f.patient_status


@query(
    "q08_delivery_cohort",
    "SELECT csn, admit_ts, disch_ts, los, pat_id, birth_ts, delivery_type, ob_status FROM ob",
)
def _(f):
    return f.deliveries


@query("q12_expected_due", "SELECT pat_id, due_ts, ob_status FROM due")
def _(f):
    return f.due


@query("q13_expected_deliveries", "SELECT ob_status, expected, arr_day, cat_id FROM due_arr")
def _(f):
    return f.expected_deliveries


@query(
    "q18_newborn_cohort",
    """SELECT csn, pat_id, department_name, admit_ts, disch_ts, los, newborn_status, count(*) AS copies,
              min(mother_csn) AS mother_csn
       FROM neo GROUP BY csn, pat_id, department_name, admit_ts, disch_ts, los, newborn_status""",
)
def _(f):
    return f.newborns


@query("q19_yield_ratio", "SELECT ob_status, babies, mothers, babies_per_delivery FROM ratio")
def _(f):
    return newborns.yield_ratio(f.deliveries, f.newborns)


@query("q20_yield_by_location", "SELECT department_name, ob_status, babies_per_delivery FROM by_unit")
def _(f):
    return newborns.yield_by_location(f.newborns, newborns.yield_ratio(f.deliveries, f.newborns), f.cfg)


@query("q21_derived_newborns", "SELECT expected, ob_status, arr_day, department_name, cat_id FROM neo_arr")
def _(f):
    by_unit = newborns.yield_by_location(f.newborns, newborns.yield_ratio(f.deliveries, f.newborns), f.cfg)
    return newborns.derived_newborns(f.expected_deliveries, by_unit, f.cfg)


# -- surgery ---------------------------------------------------------------------


@query(
    "q22_first_procedure",
    """SELECT csn, primary_procedure, surgical_location, count(*) AS copies
       FROM ops WHERE place = 1 GROUP BY csn, primary_procedure, surgical_location""",
)
def _(f):
    return f.first_surgeries


@query(
    "q22b_surgical_cohort",
    """SELECT csn, encounter_csn, admit_ts, disch_ts, los, primary_procedure, surgical_location, count(*) AS copies
       FROM surg GROUP BY csn, encounter_csn, admit_ts, disch_ts, los, primary_procedure, surgical_location""",
)
def _(f):
    return surgery.surgical_cohort(f.first_surgeries, f.encounters, f.deliveries, f.newborns)


@query(
    "q23_scheduled_cases",
    "SELECT pat_id, case_id, primary_procedure, surgical_location, surgery_ts FROM cases",
)
def _(f):
    return surgery.scheduled_cases(f.tables, f.current, f.due, f.cfg)


@query(
    "q24_scheduled_arrivals",
    "SELECT primary_procedure, surgical_location, surgery_ts, expected, arr_day, cat_id FROM case_arr",
)
def _(f):
    return f.expected_surgeries


@query(
    "q35_scale_schedule",
    """, factors AS (
           SELECT location_name AS surgical_location,
                  CAST(count(CASE WHEN not_performed_c IS NULL THEN 1 END) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS factor
           FROM s_surgery_log g JOIN s_location l ON l.location_id = g.location_id WHERE location_name <> 'ASIA'
           GROUP BY location_name)
       SELECT a.primary_procedure, a.surgical_location, a.surgery_ts, a.expected * coalesce(f.factor, 1.0) AS expected,
              a.arr_day, a.cat_id
       FROM case_arr a LEFT JOIN factors f ON f.surgical_location = a.surgical_location""",
)
def _(f):
    # Share of past surgeries that took place, per location; one location has no factor.
    performed = F.count(F.when(F.col("not_performed_c").isNull(), 1)).cast("double")
    factors = (
        f.tables["surgery_log"]
        .join(f.tables["location"], "location_id")
        .where(F.col("location_name") != "ASIA")
        .groupBy(F.col("location_name").alias("surgical_location"))
        .agg((performed / F.count("*").cast("double")).alias("factor"))
    )
    return surgery.scale_schedule(f.expected_surgeries, factors, ["surgical_location"])


# -- external transfers ------------------------------------------------------------


@query(
    "q25_transfer_requests",
    """SELECT request_id, request_ts, request_type, transfer_type, request_status, intake_csn, direct_admit
       FROM asks""",
)
def _(f):
    return repeat_rows(transfers.transfer_requests(f.tables, f.cfg))


@query(
    "q26_latest_status",
    "SELECT comm_id, line, status_c, update_utc_ts, previous_status_c FROM final_status",
)
def _(f):
    return transfers.latest_status(f.tables["status_history"])


@query(
    "q27_transfer_destinations",
    """SELECT request_id, destination_id, line, status_update_ts, destination_csn, request_status_c,
              destination_status_c, previous_status_c, reason_c, admit_conf_c, patient_stat_c, admit_conf, patient_stat
       FROM places WHERE place = 1""",
)
def _(f):
    return repeat_rows(transfers.transfer_destinations(f.tables, f.cfg))


# -- survival curves ---------------------------------------------------------------


@query("q09_survival_one_key", "SELECT ob_status, day_num, denominator, numerator, probability FROM ob_curve")
def _(f):
    history = within(F.col("disch_ts"), f.cfg.usable_start, f.cfg.as_of)
    return survival.survival_curve(f.deliveries.where(history), ["ob_status"], f.cfg.horizon_long)


def _stream(f, pt_type):
    return f.members.where(F.col("Pt_Type") == pt_type)


@staged_query(
    "q10_survival_two_keys",
    "SELECT ed_transfer, acuity_level, day_num, denominator, numerator, probability FROM ed_curve",
)
def _(f):
    stays = _stream(f, EMERGENCY).where("in_curve").select(
        F.col("sub_type").alias("ed_transfer"), F.col("severity_level").alias("acuity_level"), "los", "copies"
    )
    return survival.survival_curve(stays, ["ed_transfer", "acuity_level"], f.cfg.horizon, weight="copies")


@staged_query("q11_survival_global", "SELECT day_num, denominator, numerator, probability FROM other_curve")
def _(f):
    return survival.survival_curve(_stream(f, OTHER).where("in_curve"), [], f.cfg.horizon, weight="copies")


_ALL_CURVES = " UNION ALL ".join(
    f"""SELECT '{pt}' AS "Pt_Type", {proc} AS "Primary_Procedure", {sub} AS sub_type, {sev} AS severity_level,
               day_num, denominator, numerator, probability FROM {part}"""
    for pt, proc, sub, sev, part in [
        ("OB", "'N/A'", "ob_status", "'N/A'", "ob_curve"),
        ("Neonate", "'N/A'", "newborn_status", "department_name", "neo_curve"),
        ("Surgical Admit", "primary_procedure", "surgical_location", "'N/A'", "surg_curve"),
        ("Direct Admit (External Transfer)", "'N/A'", "request_type", "transfer_type", "da_curve"),
        ("ED", "'N/A'", "ed_transfer", "acuity_level", "ed_curve"),
        ("Other", "'N/A'", "'N/A'", "'N/A'", "other_curve"),
    ]
)


@staged_query("q11b_survival_all_streams", _ALL_CURVES)
def _(f):
    return survival.by_day(f.curves).drop("horizon")


@query(
    "q11c_survival_services",
    "SELECT service_group, service_name, day_num, denominator, numerator, probability FROM svc_curve",
)
def _(f):
    return survival.by_day(f.service_curves)


# -- predicted and expected occupancy -----------------------------------------------


def _all_predicted(suffix: str, columns: str) -> str:
    streams = [
        ("OB", "'No Local Prenatal Care'", "'N/A'", "ob"),
        ("Neonate", "newborn_status", "department_name", "neo"),
        ("Direct Admit (External Transfer)", "request_type", "transfer_type", "da"),
        ("ED", "ed_transfer", "acuity_level", "ed"),
        ("Other", "'N/A'", "'N/A'", "other"),
    ]
    return " UNION ALL ".join(
        f"""SELECT '{pt}' AS "Pt_Type", 'N/A' AS "Primary_Procedure", {sub} AS sub_type, {sev} AS severity_level, {columns}
            FROM {part}_{suffix}"""
        for pt, sub, sev, part in streams
    )


@staged_query("q15_predicted_arrivals_dow", _all_predicted("dow", "dow AS dow_adjusted, expected"))
def _(f):
    return arrivals.predict_arrivals_dow(
        f.recent_members, "arrival_ts", TYPE_KEYS, f.calendar, f.cfg, weight="copies"
    )


@staged_query("q16_predicted_arrivals_daily", _all_predicted("daily", "arr_day, expected, cat_id"))
def _(f):
    return f.predicted.drop("horizon", "prediction_status")


@query(
    "q14_spread_expected",
    "SELECT ob_status, cat_id, arr_day, post_arr_day, days_out, day_date, occupancy FROM ob_exp_spread",
)
def _(f):
    history = within(F.col("disch_ts"), f.cfg.usable_start, f.cfg.as_of)
    curve = survival.curve_arrays(f.deliveries.where(history), ["ob_status"], f.cfg.horizon_long)
    spread = occupancy.spread_occupancy(f.expected_deliveries, curve, ["ob_status"], f.cfg.horizon_long, f.cfg)
    return spread.drop("expected")


@staged_query(
    "q17_spread_predicted",
    "SELECT cat_id, arr_day, post_arr_day, days_out, day_date, occupancy FROM other_spread",
)
def _(f):
    stream = _stream(f, OTHER)
    curve = survival.curve_arrays(stream.where("in_curve"), [], f.cfg.horizon, weight="copies")
    by_dow = arrivals.predict_arrivals_dow(stream, "arrival_ts", [], f.calendar, f.cfg, weight="copies")
    daily = arrivals.predict_arrivals_daily(by_dow, f.calendar, f.cfg.horizon).withColumn(
        "cat_id", F.concat(F.lit("OTHER_DAY_"), F.col("arr_day").cast("string"))
    )
    spread = occupancy.spread_occupancy(daily, curve, [], f.cfg.horizon, f.cfg)
    return spread.drop("expected", "dow_adjusted")


# -- arrival source, patients in bed, history --------------------------------------------


_TAG_COLUMNS = """csn, pat_id, service_group, service_name, pt_type AS "Pt_Type",
       primary_procedure AS "Primary_Procedure", sub_type, severity_level"""


@staged_query("q28_source_tags", f"SELECT {_TAG_COLUMNS} FROM tags")
def _(f):
    return repeat_rows(profile.tag_source(f.profile, direct_only=False)).drop("account_id", "admit_ts", "disch_ts")


@staged_query("q28b_source_tags_direct_only", f"SELECT {_TAG_COLUMNS} FROM tags_direct")
def _(f):
    return repeat_rows(profile.tag_source(f.profile, direct_only=True)).drop("account_id", "admit_ts", "disch_ts")


@staged_query(
    "q29_exclusive_cohorts",
    """SELECT e.csn, e.admit_ts, e.disch_ts, e.los,
              CASE WHEN e.csn IN (SELECT csn FROM ob) THEN 'OB' WHEN e.csn IN (SELECT csn FROM neo) THEN 'Neonate'
                   WHEN EXISTS (SELECT 1 FROM surg WHERE surg.csn = e.csn) THEN 'Surgical Admit'
                   WHEN e.csn IN (SELECT csn FROM xfer) THEN 'Direct Admit (External Transfer)'
                   WHEN e.csn IN (SELECT csn FROM ed) THEN 'ED' WHEN e.csn IN (SELECT csn FROM other) THEN 'Other' END AS cohort
       FROM enc e""",
)
def _(f):
    return profile.arrival_order(f.profile)


@staged_query(
    "q29b_cohort_rows",
    """SELECT csn, pt_type AS "Pt_Type", sub_type, severity_level, count(*) AS copies FROM (
           SELECT csn, 'OB' AS pt_type, ob_status AS sub_type, 'N/A' AS severity_level FROM ob
           UNION ALL SELECT csn, 'Neonate', newborn_status, department_name FROM neo
           UNION ALL SELECT csn, 'Surgical Admit', surgical_location, 'N/A' FROM surg WHERE encounter_csn IS NOT NULL
           UNION ALL SELECT csn, 'Direct Admit (External Transfer)', request_type, transfer_type FROM xfer_direct
           UNION ALL SELECT csn, 'ED', ed_transfer, acuity_level FROM ed
           UNION ALL SELECT csn, 'Other', 'N/A', 'N/A' FROM other) GROUP BY csn, pt_type, sub_type, severity_level""",
)
def _(f):
    return f.members.groupBy("csn", "Pt_Type", "sub_type", "severity_level").agg(F.sum("copies").alias("copies"))


_CUR_DAYS = """SELECT csn, days_into_admission, days_out, CAST(probability AS DOUBLE) AS probability, pt_type AS "Pt_Type",
       sub_type, severity_level FROM cur_days"""


def _current_days(f):
    chances = survival.conditional_occupancy(
        f.current_tagged, f.service_curves, "service_name", f.cfg.horizon, f.cfg.curve_days
    )
    return repeat_rows(chances).select(
        "csn", "days_into_admission", "days_out", "probability", "Pt_Type", "sub_type", "severity_level"
    )


@staged_query("q30_conditional_survival", f"{_CUR_DAYS} WHERE days_into_admission <= {FAR}")
def _(f):
    return _current_days(f).where(F.col("days_into_admission") <= f.cfg.curve_days)


@staged_query("q31_long_stays", f"{_CUR_DAYS} WHERE days_into_admission > {FAR}")
def _(f):
    return _current_days(f).where(F.col("days_into_admission") > f.cfg.curve_days)


@staged_query(
    "q32_midnight_census",
    """SELECT csn, census_date, days_into_admission, service_group, service_name, pt_type AS "Pt_Type",
              primary_procedure AS "Primary_Procedure", sub_type, severity_level, department_name, census_ts FROM hist""",
)
def _(f):
    return repeat_rows(f.history)


# -- the whole forecast -----------------------------------------------------------------


@staged_query("q33_forecast", "SELECT * FROM everything")
def _(f):
    return f.rows


@staged_query(
    "q34_daily_rollup",
    """SELECT day_date, "Pt_Type", round(sum("Est_Occupancy"), 6) AS occupancy FROM everything
       WHERE "Pt_Type" IN ('OB', 'ED', 'Other')
         AND prediction_status IN ('Currently Admitted Patients', 'Predicted Admissions', 'Expected Admissions')
       GROUP BY day_date, "Pt_Type" """,
)
def _(f):
    daily = occupancy.rollup(
        f.rows,
        streams=[OB, EMERGENCY, OTHER],
        statuses=["Currently Admitted Patients", "Predicted Admissions", "Expected Admissions"],
    )
    return daily.withColumn("occupancy", F.round("occupancy", 6))


@staged_query(
    "q36_daily_arrivals_in_bed",
    """SELECT "Pt_Type", "Primary_Procedure", sub_type, severity_level, prediction_status, "Days_Out" AS days_out,
              round(sum("Est_Occupancy"), 6) AS occupancy FROM everything
       WHERE prediction_status IN ('Predicted Admissions', 'Expected Admissions')
       GROUP BY "Pt_Type", "Primary_Procedure", sub_type, severity_level, prediction_status, "Days_Out" """,
)
def _(f):
    return f.arriving_daily.withColumn("occupancy", F.round("occupancy", 6))


# -- what is kept from run to run ---------------------------------------------------------


def _earlier(f, days: int) -> Forecast:
    """The run of some days before."""
    return Forecast(f.tables, replace(f.cfg, as_of=f.cfg.as_of - timedelta(days=days)), Lazy())


@staged_query("q37_published_forecast", "SELECT * FROM everything")
def _(f):
    path = f"{f.stage.root}/published"
    write_forecast(f.rows, path, f.cfg.as_of)
    return read_forecast(f.tables.spark, path)


@staged_query(
    "q38_census_by_day",
    """SELECT csn, census_date, days_into_admission, service_group, service_name, pt_type AS "Pt_Type",
              primary_procedure AS "Primary_Procedure", sub_type, severity_level, department_name, census_ts FROM hist""",
)
def _(f):
    # Two runs before this one, and days that this one makes again.
    kept = CensusHistory(f.tables.spark, f"{f.stage.root}/census", refresh=3)
    for days in (400, 20):
        before = _earlier(f, days)
        kept.update(before.tables, before.days, before.cfg)
    now = Forecast(f.tables, f.cfg, Lazy(), census=kept)
    now.profile = f.profile
    return repeat_rows(now.history)


@staged_query(
    "q39_service_curves_by_day",
    "SELECT service_group, service_name, day_num, denominator, numerator, probability FROM svc_curve",
    by_order=False,
)
def _(f):
    kept = StayHistory(f.tables.spark, f"{f.stage.root}/stays", ["service_group", "service_name"], f.cfg.curve_days)
    start = f.cfg.hist_start
    # The run of a month ago, over a history that began earlier: this one adds days and takes days away.
    for first, last in ((start - timedelta(days=90), f.cfg.as_of - timedelta(days=30)), (start, f.cfg.as_of)):
        kept.update(f.encounters, "disch_ts", first, last)
        curves = kept.curves(first, last, f.cfg.curve_days)
    return survival.by_day(curves)
