from dataclasses import replace
from datetime import date

import pytest
from pyspark.sql import functions as F

from tests.fixtures import AS_OF, CFG, encounter, rows, sources, ts
from wardcast.functions.rows import repeat_rows
from wardcast.operators import encounters, newborns, obstetrics, profile, surgery, transfers
from wardcast.operators.survival import by_day
from wardcast.plans.forecast import Forecast
from wardcast.plans.staging import Lazy


def forecast(spark, cfg=CFG, **tables):
    return Forecast(sources(spark, **tables), cfg, Lazy())


# -- services and encounters --------------------------------------------------------


def test_service_group_text(spark):
    codes = ["MED A101", "MED SURG A12", "MED SURG  A123 B456", " A999", "x B123", "PED B100 A200", "ped a100"]
    df = spark.createDataFrame([(i, "n", c) for i, c in enumerate(codes)], "service_c int, service_name string, service_abbr string")
    got = {r.service_abbr: r.service_group for r in encounters.service_groups(df).collect()}
    assert got == {"MED A101": "MED", "MED SURG  A123 B456": "MED SURG", " A999": "", "PED B100 A200": "PED"}


def test_encounter_filters(spark):
    f = forecast(
        spark,
        encounter=[
            encounter(1, "a", "2021-04-01 10:00", "2021-04-01 23:00"),
            encounter(2, "a", "2021-04-01 23:59", "2021-04-02 00:01"),
            encounter(3, "a", "2017-12-01", "2017-12-31 23:59"),  # ended before the history
            encounter(4, "a", "2017-12-01", "2018-01-01"),  # ended on its first day
            encounter(5, "a", "2016-01-01", None, service_c=2),  # open, service without a unit code
            encounter(6, "a", "2021-04-01", None, service_area=20),
            encounter(7, "a", "2021-04-01", None, admit_conf_c=None),
            encounter(8, "a", "2021-04-01", None, patient_stat_c=1),
            encounter(9, "a", "2021-04-01", None, department_id=4),  # unit group without a name
        ],
    )
    assert rows(f.encounters, "csn", "los", "service_group") == [
        (1, 0, "MED"), (2, 1, "MED"), (4, 31, "MED"), (5, None, None),
    ]


def test_current_inpatients(spark):
    f = forecast(
        spark,
        encounter=[
            encounter(1, "a", "2021-05-02 23:59"),  # yesterday: 0 days in
            encounter(2, "a", "2021-05-03 00:00"),  # today: not yet
            encounter(3, "a", "2021-04-01", "2021-05-03 00:00"),  # leaves today: still counted
            encounter(4, "a", "2021-04-01", "2021-05-02 23:59"),
            encounter(5, "a", "2020-05-02"),
            encounter(6, "a", "2020-05-01"),
        ],
    )
    assert rows(f.current, "csn", "days_into_admission") == [(1, 0), (3, 31), (5, 365), (6, 366)]


# -- deliveries ------------------------------------------------------------------------


def contact(csn, pat_id, when, **more):
    return {
        "csn": csn, "pat_id": pat_id, "contact_ts": ts(when), "appt_status_c": 2, "department_id": 4,
        "provider_id": "p1", "entry_ts": ts(when),
    } | more


def prenatal(spark, contacts, due, cfg=CFG, **more):
    """Contacts with their episode equal to the contact id."""
    return forecast(
        spark,
        cfg,
        contact=contacts,
        episode=[{"episode_id": c["csn"]} for c in contacts],
        episode_link=[{"csn": c["csn"], "episode_id": c["csn"]} for c in contacts],
        due_date=[
            {"episode_id": e, "due_user_ts": u and ts(u), "due_system_ts": s and ts(s), "is_working": w} for e, u, s, w in due
        ],
        **more,
    )


def test_latest_contact_sets_the_due_date(spark):
    f = prenatal(
        spark,
        [
            contact(1, "a", "2021-01-01", provider_id="p2"),
            contact(2, "a", "2021-02-01"),
            contact(3, "a", "2021-02-01"),
            contact(4, "b", "2021-02-01"),
            contact(5, "b", "2021-05-03 00:00"),  # as-of midnight counts
            contact(6, "b", "2021-05-03 00:01"),
            contact(7, "c", "2021-02-01", appt_status_c=3),
            contact(8, "c", "2021-02-01", department_id=5),
        ],
        [
            (1, "2021-07-01", None, "Y"), (2, "2021-06-01", "2021-09-01", "Y"), (3, None, "2021-06-15", "Y"),
            (4, "2021-06-01", None, "Y"), (5, None, None, "Y"), (5, "2021-08-01", None, "N"), (6, "2021-06-01", None, "Y"),
            (7, "2021-06-01", None, "Y"), (8, "2021-06-01", None, "Y"),
        ],
    )
    # a: risk from any contact, due date from the latest, ties to the later date.
    # b: the latest contact has no working date at all.
    assert rows(f.patient_status, "pat_id", "ob_status", "due_ts") == [
        ("a", "HROB", ts("2021-06-15")), ("b", "Normal", None),
    ]


def test_due_window_and_recent_deliveries(spark):
    pats = {
        "today": "2021-05-03", "last": "2021-08-30", "late": "2021-08-30 00:01", "past": "2021-05-02 23:59",
        "gave300": "2021-06-01", "gave301": "2021-06-01", "inbed": "2021-06-01", "nobirth": "2021-06-01",
    }
    f = prenatal(
        spark,
        [contact(i, p, "2021-02-01") for i, p in enumerate(pats)],
        [(i, d, None, "Y") for i, d in enumerate(pats.values())],
        encounter=[
            encounter(101, "gave300", "2020-07-07", "2020-07-09"),
            encounter(102, "gave301", "2020-07-06", "2020-07-08"),
            encounter(103, "inbed", "2021-05-01"),
            encounter(104, "nobirth", "2021-04-01", "2021-04-03"),
        ],
        delivery=[
            {"csn": 101, "birth_ts": ts("2020-07-07 05:00"), "method_c": 1},
            {"csn": 102, "birth_ts": ts("2020-07-06 05:00"), "method_c": 1},
            {"csn": 104, "birth_ts": None, "method_c": 1},  # no birth time: excludes nobody
        ],
    )
    assert [r[0] for r in rows(f.due, "pat_id")] == ["gave301", "last", "nobirth", "today"]
    got = rows(f.expected_deliveries, "arr_day", "expected", "cat_id")
    assert got == [
        (1, 1, "OB_Expected_Admits_Normal_day_1"),
        (30, 2, "OB_Expected_Admits_Normal_day_30"),
        (120, 1, "OB_Expected_Admits_Normal_day_120"),
    ]


def test_due_times_group_apart_unless_truncated(spark):
    contacts = [contact(1, "a", "2021-02-01"), contact(2, "b", "2021-02-01")]
    due = [(1, "2021-06-01 06:00", None, "Y"), (2, "2021-06-01 18:00", None, "Y")]
    assert rows(prenatal(spark, contacts, due).expected_deliveries, "arr_day", "expected") == [(30, 1), (30, 1)]
    by_day = prenatal(spark, contacts, due, replace(CFG, truncate_due=True))
    assert rows(by_day.expected_deliveries, "arr_day", "expected") == [(30, 2)]


def test_delivery_cohort(spark):
    f = forecast(
        spark,
        encounter=[
            encounter(1, "a", "2020-01-01", "2020-01-03"),  # typed and untyped rows
            encounter(2, "a", "2020-02-01", "2020-02-03"),  # untyped only
            encounter(3, "a", "2021-05-01", department_id=2),  # in labour now
            encounter(4, "a", "2021-05-01", "2021-05-02", department_id=2),
            encounter(5, "a", "2018-10-27", "2018-10-30"),  # before contacts can be complete
            encounter(6, "a", "2018-10-28", "2018-10-30"),
        ],
        delivery=[
            {"csn": 1, "birth_ts": ts("2020-01-01 05:00"), "method_c": 1},
            {"csn": 1, "birth_ts": ts("2020-01-02 05:00"), "method_c": 9},
            {"csn": 2, "birth_ts": ts("2020-02-01 05:00"), "method_c": 9},
            {"csn": 3, "birth_ts": ts("2021-05-02 05:00"), "method_c": 9},
            {"csn": 5, "birth_ts": ts("2018-10-27 05:00"), "method_c": 1},
            {"csn": 6, "birth_ts": None, "method_c": 1},
        ],
    )
    status = "No Local Prenatal Care"
    assert rows(f.deliveries, "csn", "birth_ts", "delivery_type", "ob_status") == [
        (1, ts("2020-01-01 05:00"), "Vaginal", status),
        (3, ts("2021-05-02 05:00"), None, status),
        (6, None, "Vaginal", status),
    ]


def test_newborns_match_within_a_day(spark):
    shifts = {"2020-03-08": False, "2020-03-09": True, "2020-03-10": True, "2020-03-11": True, "2020-03-12": False}
    f = forecast(
        spark,
        encounter=[
            encounter(1, "mum", "2020-03-10", "2020-03-12"),
            encounter(2, "twice", "2020-03-10", "2020-03-12"),
            encounter(3, "twice", "2020-03-11", "2020-03-12"),
            *[encounter(10 + i, f"b{i}", f"{d} 23:00", "2020-03-20", department_id=3) for i, d in enumerate(shifts)],
            encounter(20, "b20", "2020-03-11", "2020-03-20", department_id=3),
            encounter(21, "b21", "2018-12-31", "2019-01-05", department_id=3),  # too early in the history
            encounter(22, "b22", "2018-12-31", None, department_id=3),  # but still here
        ],
        patient=[*[{"pat_id": f"b{i}", "mother_pat_id": "mum"} for i in range(5)], {"pat_id": "b20", "mother_pat_id": "twice"}],
        delivery=[
            {"csn": 1, "birth_ts": ts("2020-03-10 12:00"), "method_c": 1},
            {"csn": 2, "birth_ts": ts("2020-03-10 12:00"), "method_c": 1},
            {"csn": 3, "birth_ts": ts("2020-03-11 12:00"), "method_c": 1},
        ],
    )
    born = "No Local Prenatal Care"
    want = [(10 + i, born if hit else "Not birth encounter", 1) for i, hit in enumerate(shifts.values())]
    assert rows(f.newborns, "csn", "newborn_status", "copies") == [
        *want, (20, born, 2), (22, "Not birth encounter", 1),
    ]
    ratio = newborns.yield_ratio(f.deliveries, f.newborns)
    assert rows(ratio, "ob_status", "babies", "mothers") == [(born, 4, 3)]
    # Only the prenatal statuses yield expected newborns.
    assert rows(newborns.yield_by_location(f.newborns, ratio, CFG)) == []


def test_yield_per_unit(spark):
    deliveries = spark.createDataFrame([(1, "HROB"), (2, "HROB"), (3, "Normal")], "csn long, ob_status string")
    babies = spark.createDataFrame(
        [(11, "HROB", "NIC1"), (12, "HROB", "NIC1"), (13, "HROB", "NNSY"), (14, "Not birth encounter", "NIC1")],
        "csn long, newborn_status string, department_name string",
    )
    ratio = newborns.yield_ratio(deliveries, babies)
    assert rows(ratio) == [("HROB", 3, 2, 1.5), ("Normal", 0, 1, 0.0)]
    by_unit = newborns.yield_by_location(babies, ratio, CFG)
    assert rows(by_unit) == [("NIC1", "HROB", 1.0), ("NNSY", "HROB", 0.5)]
    expected = spark.createDataFrame([("HROB", 2, 5)], "ob_status string, expected long, arr_day int")
    assert rows(newborns.derived_newborns(expected, by_unit, CFG), "expected", "cat_id") == [
        (1.0, "Neonate_Local_HROB_NNSY_DAY_5"), (2.0, "Neonate_Local_HROB_NIC1_DAY_5"),
    ]


# -- surgery ---------------------------------------------------------------------------


def operation(log_id, csn, when, procedure_id="k", contact_csn=None, **more):
    return {
        "surgery_log": {"log_id": log_id, "status_c": 1, "location_id": 1, "surgery_ts": ts(when)} | more,
        "surgery_log_detail": {"log_id": log_id, "procedure_id": procedure_id},
        "admission_link": {"case_id": log_id, "admission_csn": csn if contact_csn else None, "contact_csn": contact_csn or csn},
    }


def operations(*ops):
    return {name: [o[name] for o in ops] for name in ("surgery_log", "surgery_log_detail", "admission_link")}


def test_first_surgery_keeps_ties_and_skips_later_bookings(spark):
    tables = operations(
        operation("A", 1, "2020-01-02"),
        operation("B", 1, "2020-01-01", "h"),
        operation("C", 2, "2020-01-01", status_c=2),  # not performed
        operation("D", 2, "2020-01-03", location_id=2),  # elsewhere
        operation("E", 3, "2020-01-01"),  # booked after admission
        operation("F", 4, "2020-01-01", contact_csn=90),  # through the admission link
        operation("G", 5, "2020-01-01", not_performed_c=1),
        operation("H", 6, "2020-01-01", status_c=None),  # no status row
    )
    tables["admission_link"].append(tables["admission_link"][1])  # the same link twice
    f = forecast(
        spark,
        encounter=[encounter(n, f"p{n}", "2020-01-01 12:00", "2020-01-05") for n in range(1, 7)],
        contact=[contact(n, f"p{n}", "2019-12-01") for n in (1, 2, 4, 5, 6, 90)] + [contact(3, "p3", "2020-01-02")],
        **tables,
    )
    assert rows(f.first_surgeries) == [(1, "HIP", "MAIN OR", 2), (4, "KNEE", "MAIN OR", 1)]


def test_surgical_cohort_keeps_cases_without_a_stay(spark):
    first = spark.createDataFrame(
        [(1, "KNEE", "MAIN OR", 1), (2, "KNEE", "MAIN OR", 1), (3, "HIP", "MAIN OR", 1)],
        "csn long, primary_procedure string, surgical_location string, copies long",
    )
    f = forecast(spark, encounter=[encounter(1, "a", "2020-01-01", "2020-01-05"), encounter(2, "b", "2020-01-01", "2020-01-02")])
    ob = spark.createDataFrame([(2,)], "csn long")
    got = surgery.surgical_cohort(first, f.encounters, ob, ob.where("false"))
    assert rows(got, "csn", "encounter_csn", "los") == [(1, 1, 4), (3, None, 0)]


def case(case_id, pat_id, when, **more):
    return {
        "case_id": case_id, "pat_id": pat_id, "log_id": case_id, "location_id": 1, "surgery_ts": ts(when),
        "sched_status_c": 1, "pat_class_c": 1,
    } | more


def test_schedule(spark):
    cases = [
        case("a1", "a", "2021-05-10 08:00"),
        case("a2", "a", "2021-05-11 08:00"),  # not the first
        case("b1", "b", "2019-05-10 08:00"),  # old and never linked: hides the next one
        case("b2", "b", "2021-05-10 08:00"),
        case("c1", "c", "2021-05-10 08:00"),  # in bed already
        case("d1", "d", "2021-06-02 00:00"),  # last midnight of the horizon
        case("e1", "e", "2021-06-02 00:01"),
        case("f1", "f", "2021-05-10 08:00", pat_class_c=9),
        case("g1", "g", "2021-05-10 08:00", pat_class_c=None),
        case("h1", "h", "2021-05-10 08:00", sched_status_c=2),
        case("i1", "i", "2019-05-10 08:00"),  # linked to a past admission: hides nothing
        case("i2", "i", "2021-05-10 08:00"),
        case("j1", "j", "2021-05-10 08:00"),  # without a first procedure
    ]
    tables = {
        "surgery_case": cases,
        "case_procedure": [
            *[{"case_id": c["case_id"], "line": 1, "procedure_id": "k"} for c in cases if c["pat_id"] != "j"],
            {"case_id": "j1", "line": 2, "procedure_id": "k"},
        ],
        "admission_link": [{"case_id": "i1", "admission_csn": None, "contact_csn": 9}],
        "contact": [contact(9, "i", "2019-05-01")],
        "encounter": [encounter(9, "i", "2019-05-10", "2019-05-12"), encounter(8, "c", "2021-05-01")],
    }
    f = forecast(spark, **tables)
    assert rows(f.expected_surgeries, "arr_day", "expected", "cat_id") == [
        (8, 2.0, "Periop_Expected_Admits_MAIN OR_KNEE_day_8"), (31, 1.0, "Periop_Expected_Admits_MAIN OR_KNEE_day_31"),
    ]
    future = forecast(spark, replace(CFG, rank_future_only=True), **tables)
    assert rows(future.expected_surgeries, "arr_day", "expected") == [(8, 3.0), (31, 1.0)]


# -- transfers ---------------------------------------------------------------------------


def transfer_tables(destinations, topic="100002", status=4, region=1391, origin=16):
    """One request ``r`` with destinations of (id, csn, status, [history])."""
    return {
        "request": [{"comm_id": "r", "entry_ts": ts("2020-01-01"), "topic_c": topic, "origin_c": origin}],
        "request_detail": [
            {"comm_id": "r", "status_c": status, "transfer_type_c": 1, "region_id": region},
            *[{"comm_id": d, "status_c": s} for d, _, s, _ in destinations],
        ],
        "attachment": [
            *[{"comm_id": "r", "attachment_c": 21, "target_comm_id": d} for d, *_ in destinations],
            *[{"comm_id": d, "attachment_c": 20, "csn": c} for d, cs, _, _ in destinations for c in cs],
        ],
        "status_history": [
            {"comm_id": d, "line": line, "status_c": s, "update_utc_ts": ts(at)}
            for d, _, _, lines in destinations for line, s, at in lines
        ],
    }


def test_latest_status_needs_gap_free_lines(spark):
    history = [("a", 1, 5), ("a", 2, 4), ("a", 3, 2), ("b", 1, 7), ("b", 3, 8), ("c", 1, 9)]
    f = forecast(
        spark,
        status_history=[{"comm_id": c, "line": n, "status_c": s, "update_utc_ts": ts(f"2020-01-0{n}")} for c, n, s in history],
    )
    got = transfers.latest_status(f.tables["status_history"])
    assert rows(got, "comm_id", "line", "status_c", "previous_status_c") == [
        ("a", 3, 2, 4), ("b", 3, 8, None), ("c", 1, 9, None),
    ]


def test_destination_order(spark):
    destinations = [
        ("d1", [1], 2, [(1, 2, "2020-07-01 12:00"), (2, 2, "2020-07-02 12:00")]),
        ("d2", [2], 4, [(1, 2, "2020-07-01 12:00"), (2, 2, "2020-07-03 12:00")]),
        ("d3", [3], 4, [(1, 2, "2020-07-01 12:00"), (2, 2, "2020-07-09 12:00")]),
        ("d4", [4], 5, [(1, 2, "2020-07-01 12:00"), (2, 2, "2020-07-10 12:00")]),  # not accepted
    ]
    f = forecast(
        spark,
        encounter=[
            encounter(1, "a", "2020-07-03", "2020-07-05"),
            encounter(2, "b", "2020-07-03", None),  # admitted ranks with discharged
            encounter(3, "c", "2020-07-03", None, patient_stat_c=1),  # newer, but neither
        ],
        **transfer_tables(destinations),
    )
    got = transfers.transfer_destinations(f.tables, CFG)
    # 12:00 UTC is 07:00 in the middle of the American summer.
    assert rows(got, "destination_id", "destination_csn", "status_update_ts", "copies") == [("d2", 2, ts("2020-07-03 07:00"), 1)]


def test_destination_without_encounter_comes_first(spark):
    f = forecast(
        spark,
        encounter=[encounter(1, "a", "2020-07-03", "2020-07-05")],
        **transfer_tables([("d1", [1], 2, []), ("d2", [], 2, [])]),
    )
    got = transfers.transfer_destinations(f.tables, CFG)
    assert rows(got, "destination_id", "destination_csn") == [("d2", -1)]


@pytest.mark.parametrize(
    ("status", "region", "destination", "history", "kept"),
    [
        (4, 1391, 2, [(1, 5, "2020-01-01"), (2, 5, "2020-01-02")], True),  # accepted
        (4, 1391, 5, [(1, 5, "2020-01-01"), (2, 5, "2020-01-02")], False),
        (6, 1391, 5, [(1, 4, "2020-01-01"), (2, 6, "2020-01-02")], True),  # cancelled after being accepted
        (6, 1391, 2, [(1, 5, "2020-01-01"), (2, 6, "2020-01-02")], False),
        (4, 1391, 5, [(1, 5, "2020-01-01")], True),  # nothing before the last line
        (4, None, 5, [(1, 5, "2020-01-01")], False),
        (None, None, 2, [(1, 5, "2020-01-01"), (2, 5, "2020-01-02")], False),  # unknown status is not "other than cancelled"
    ],
)
def test_destination_states(spark, status, region, destination, history, kept):
    f = forecast(spark, **transfer_tables([("d", [1], destination, history)], status=status, region=region))
    assert transfers.transfer_destinations(f.tables, CFG).count() == int(kept)
    other_centre = transfer_tables([("d", [1], destination, history)], status=status, region=region, origin=15)
    assert transfers.transfer_destinations(forecast(spark, **other_centre).tables, CFG).count() == 0


def test_equal_transfer_rows_are_counted(spark):
    tables = transfer_tables([("d", [1, 1, 1], 2, [])])
    tables["attachment"] += [{"comm_id": "r", "attachment_c": 22, "csn": 5}] * 2
    f = forecast(spark, encounter=[encounter(1, "a", "2020-07-03", "2020-07-05")], **tables)
    assert rows(f.transfers) == [(1, "Direct Admit", "Urgent", 1, 6)]
    assert repeat_rows(transfers.transfer_requests(f.tables, CFG)).count() == 2


# -- cohorts and tags ----------------------------------------------------------------------


def ed_tables(*events):
    """Events of (id, csn, status)."""
    return {
        "ed_event": [
            {"event_id": e, "department_id": "10410001", "status_c": s, "event_type": "65"} for e, _, s in events
        ],
        "ed_event_link": [{"event_id": e, "csn": c} for e, c, _ in events],
    }


def arrived(spark, topic, **more):
    """Encounter 1 came by transfer; 2 has neither; both may have ED events."""
    return forecast(
        spark,
        encounter=[
            encounter(1, "a", "2020-07-03", "2020-07-05", acuity_c=3),
            encounter(2, "b", "2020-07-03", "2020-07-05"),
            encounter(3, "c", "2018-07-03", "2018-07-05"),  # old: in no cohort
        ],
        **transfer_tables([("d", [1], 2, [])], topic=topic),
        **more,
    )


def member_rows(f):
    return rows(f.members, "csn", "Pt_Type", "sub_type", "severity_level", "copies")


def test_direct_admission_outranks_ed(spark):
    f = arrived(spark, "100002", **ed_tables((1, 1, None), (2, 2, 1), (3, 2, 2)))
    assert member_rows(f) == [
        (1, "Direct Admit (External Transfer)", "Direct Admit", "Urgent", 1), (2, "ED", "Not a transfer", None, 1),
    ]


def test_dedupe_keeps_one_label_set(spark):
    one = arrived(spark, "100002", **ed_tables((3, 1, None))).profile.where("csn = 1")
    untyped = F.transform("direct_transfers", lambda t: t.withField("transfer_type", F.lit(None).cast("string")))
    two = one.withColumn("direct_transfers", F.concat("direct_transfers", untyped))
    assert profile.tag_source(two, direct_only=True).count() == 2
    assert rows(profile.tag_source(two, direct_only=True, dedupe=True), "csn", "copies") == [(1, 1)]


def test_forwarded_transfer_joins_ed_once_per_event(spark):
    f = arrived(spark, "100001", **ed_tables((1, 1, None), (2, 1, 1)))
    assert member_rows(f) == [(1, "ED", "ED-to-ED Transfer", "3: Urgent", 2), (2, "Other", "N/A", "N/A", 1)]
    assert member_rows(Forecast(f.tables, replace(CFG, dedupe=True), Lazy()))[0][-1] == 1
    tags = profile.tag_source(f.profile, direct_only=False)
    assert rows(tags, "csn", "Pt_Type", "sub_type", "severity_level", "copies") == [
        (1, "ED", "ED-to-ED Transfer", "3: Urgent", 2), (2, "Other", "N/A", "N/A", 1), (3, "Other", "N/A", "N/A", 1),
    ]
    # In building order the transfer cohort is settled before the emergency one.
    assert rows(profile.arrival_order(f.profile), "csn", "cohort")[0] == (1, "Direct Admit (External Transfer)")


def test_transfer_that_was_neither_direct_nor_seen_in_ed(spark):
    f = arrived(spark, "100001")
    assert member_rows(f) == [(2, "Other", "N/A", "N/A", 1)]  # in no stream at all
    by_history = rows(profile.tag_source(f.profile, direct_only=False), "csn", "Pt_Type", "sub_type")
    assert by_history[0] == (1, "Direct Admit (External Transfer)", "ED to ED")
    by_current = rows(profile.tag_source(f.profile, direct_only=True), "csn", "Pt_Type", "sub_type")
    assert by_current[0] == (1, "Other", "N/A")


def test_delivery_outranks_every_other_arrival(spark):
    ops = operations(operation("A", 1, "2020-07-04"))
    tables = transfer_tables([("d", [1], 2, [])]) | ed_tables((1, 1, None))
    f = forecast(
        spark,
        encounter=[encounter(1, "a", "2020-07-03", "2020-07-05", department_id=3)],
        delivery=[{"csn": 1, "birth_ts": ts("2020-07-04"), "method_c": 1}],
        contact=[contact(1, "a", "2020-06-01")],
        **tables,
        **ops,
    )
    # A delivery in a newborn unit is both; surgery, transfer and ED are not.
    assert [r[1] for r in member_rows(f)] == ["Neonate", "OB"]
    assert rows(profile.tag_source(f.profile, False), "Pt_Type", "sub_type", "severity_level") == [
        ("OB", "No Local Prenatal Care", "NIC1"),
    ]


def test_surgery_outranks_transfer_and_ed(spark):
    f = forecast(
        spark,
        encounter=[encounter(1, "a", "2020-07-03", "2020-07-05")],
        contact=[contact(1, "a", "2020-06-01")],
        **operations(operation("A", 1, "2020-07-04")),
        **transfer_tables([("d", [1], 2, [])]),
        **ed_tables((1, 1, None)),
    )
    assert member_rows(f) == [(1, "Surgical Admit", "MAIN OR", "N/A", 1)]


def test_every_encounter_is_tagged_exactly_once(spark):
    f = arrived(spark, "100002", **ed_tables((1, 1, None), (2, 2, 1)))
    tags = profile.tag_source(f.profile, direct_only=True)
    assert tags.count() == f.encounters.count() == tags.select("csn").distinct().count()


# -- history and the whole forecast ---------------------------------------------------------


def test_midnight_census(spark):
    def move(csn, when, kind=6, subtype=1, department_id=1):
        return {"csn": csn, "effective_ts": ts(when), "department_id": department_id, "event_type_c": kind, "event_subtype_c": subtype}

    f = forecast(
        spark,
        encounter=[encounter(1, "a", "2021-04-28 10:00")],
        movement=[
            move(1, "2021-04-29 23:59"),
            move(1, "2021-05-01 23:59"),  # last day of history
            move(1, "2021-05-02 23:59"),  # already a current patient
            move(1, "2018-12-31 23:59"),
            move(1, "2021-04-30 23:59", kind=5),
            move(1, "2021-04-30 23:59", subtype=2),
            move(1, "2021-04-30 23:59", subtype=None),
            move(1, "2021-04-30 23:59", department_id=5),
            move(2, "2021-04-30 23:59"),
        ],
    )
    assert rows(f.history, "census_date", "days_into_admission") == [(date(2021, 4, 29), 1), (date(2021, 5, 1), 3)]
    got = f.history_rows.first()
    assert (got.Uniq_ID, got.Days_Out, got.Est_Occupancy, got.arrival_day, got.Pt_Type) == ("1", None, 1.0, None, "Other")


def test_non_admitted_surgeries_lower_the_curve_on_request(spark):
    tables = operations(operation("A", 1, "2020-07-04"), operation("B", 2, "2020-07-04"))
    tables |= {
        "encounter": [
            encounter(1, "a", "2020-07-03", "2020-07-05"),
            encounter(2, "b", "2020-07-03", "2020-07-05", department_id=4),  # not an inpatient unit
        ],
        "contact": [contact(1, "a", "2020-06-01"), contact(2, "b", "2020-06-01")],
    }
    first_day = F.col("day_num") == 0
    assert rows(by_day(forecast(spark, **tables).curves).where(first_day), "denominator", "numerator") == [(1, 1)]
    all_cases = forecast(spark, replace(CFG, include_non_admitted=True), **tables)
    assert rows(by_day(all_cases.curves).where(first_day), "denominator", "numerator") == [(2, 1)]


def test_small_forecast_by_hand(spark):
    f = forecast(
        spark,
        encounter=[
            encounter(1, "a", "2021-04-26", "2021-04-28"),  # Monday in the window, two days
            encounter(2, "b", "2021-04-05", "2021-04-06"),  # Monday in the window, one day
            encounter(3, "c", "2021-05-02"),  # in bed since yesterday
        ],
    )
    got = f.rows
    other = got.where("prediction_status = 'Predicted Admissions'")
    # Mondays in the window: 5, 12, 19, 26 April -> 2 arrivals over 4 days; Sunday adds 1 over 8.
    assert rows(other.where("Days_Out = 8 and arrival_day = 8"), "Uniq_ID", "Est_Occupancy") == [("OTHER_DAY_8", 0.5)]
    assert rows(other.where("Days_Out = 9 and arrival_day = 8"), "Est_Occupancy") == [(0.25,)]
    assert rows(other.where("Days_Out = 7 and arrival_day = 7"), "Est_Occupancy") == [(1 / 8,)]
    here = got.where("prediction_status = 'Currently Admitted Patients'")
    days = rows(here, "Days_Out", "day_date", "Est_Occupancy", "arrival_day", "post_arr_day")
    assert days[:3] == [
        (0, date(2021, 5, 2), 1.0, 0, 0), (1, AS_OF, 0.5, 0, 1), (2, date(2021, 5, 4), 0.0, 0, 2),
    ]
    assert len(days) == 31


def test_no_rows_at_all(spark):
    assert forecast(spark).rows.count() == 0


def test_patient_status_is_one_row_per_patient(spark):
    contacts = spark.createDataFrame(
        [("a", ts("2020-01-01"), None, None), ("a", ts("2020-01-02"), ts("2020-05-01"), "HROB")],
        "pat_id string, contact_ts timestamp_ntz, due_ts timestamp_ntz, high_risk string",
    )
    assert rows(obstetrics.patient_status(contacts, CFG), "pat_id", "ob_status") == [("a", "HROB")]
