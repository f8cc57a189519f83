"""Hand-made source tables."""

from datetime import date, datetime

import pyarrow as pa

from wardcast.config import ForecastConfig
from wardcast.sources.layout import SOURCES
from wardcast.sources.tables import SourceTables

AS_OF = date(2021, 5, 3)  # a Monday
CFG = ForecastConfig(as_of=AS_OF, hist_start=date(2018, 1, 1))

_TYPES = {
    "bigint": pa.int64(),
    "int": pa.int32(),
    "string": pa.string(),
    "date": pa.date32(),
    "timestamp": pa.timestamp("us"),
}


def ts(text):
    return datetime.fromisoformat(text)


def frame(spark, name, rows):
    """A source table with the given columns filled in and NULL elsewhere."""
    columns = SOURCES[name].columns
    unknown = {c for r in rows for c in r} - set(columns)
    assert not unknown, unknown
    schema = pa.schema([(c, _TYPES[t]) for c, (_, t) in columns.items()])
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=schema))


# Lookups most cases need; a case may replace any of them.
LOOKUPS = {
    "department": [
        {"department_id": 1, "department_name": "WARD", "unit_group_c": 1, "service_area": 10},
        {"department_id": 2, "department_name": "LDR", "unit_group_c": 1, "service_area": 10},
        {"department_id": 3, "department_name": "NIC1", "unit_group_c": 1, "service_area": 10},
        {"department_id": 4, "department_name": "CLINIC", "unit_group_c": 2, "service_area": 10},
        {"department_id": 5, "department_name": "AWAY", "unit_group_c": 1, "service_area": 20},
    ],
    "unit_group": [
        {"unit_group_c": 1, "unit_group_name": "Inpatient"},
        {"unit_group_c": 2, "unit_group_name": None},
    ],
    "service_code": [
        {"service_c": 1, "service_name": "Medicine", "service_abbr": "MED A101"},
        {"service_c": 2, "service_name": "Old", "service_abbr": "OLD B101"},
    ],
    "appt_status": [{"appt_status_c": 2, "appt_status": "Completed"}, {"appt_status_c": 6, "appt_status": "Arrived"}],
    "provider": [
        {"provider_id": "p1", "provider_name": "DOE, JO"},
        {"provider_id": "p2", "provider_name": "CLINIC HROB 3"},
    ],
    "delivery_type": [{"method_c": 1, "delivery_type": "Vaginal"}],
    "procedure": [{"procedure_id": "k", "procedure_name": "KNEE"}, {"procedure_id": "h", "procedure_name": "HIP"}],
    "location": [
        {"location_id": 1, "location_name": "MAIN OR", "service_area": 10},
        {"location_id": 2, "location_name": "ELSEWHERE", "service_area": 10},
    ],
    "surgery_status": [{"status_c": 1, "status_name": "Complete"}, {"status_c": 2, "status_name": "Voided"}],
    "request_status": [{"status_c": 4, "status_name": "Completed"}],
    "topic": [{"topic_c": "100002", "request_type": "Direct Admit"}, {"topic_c": "100001", "request_type": "ED to ED"}],
    "transfer_type": [{"transfer_type_c": 1, "transfer_type": "Urgent"}],
    "conf_status": [{"admit_conf_c": 1, "admit_conf": "Confirmed"}],
    "patient_status": [{"patient_stat_c": 2, "patient_stat": "Admission"}],
    "acuity": [{"acuity_c": 3, "acuity_name": "Urgent"}],
}


def encounter(csn, pat_id, admit, disch=None, **more):
    row = {
        "csn": csn,
        "pat_id": pat_id,
        "admit_ts": ts(admit),
        "disch_ts": ts(disch) if disch else None,
        "service_c": 1,
        "department_id": 1,
        "service_area": 10,
        "admit_conf_c": 1,
        "patient_stat_c": 3 if disch else 2,
        "account_id": csn,
        "pat_class_c": 1,
    }
    return row | more


def sources(spark, **tables):
    """All source tables; those not given are empty or the common lookups.
    Without a ``calendar`` the days are generated."""
    given = LOOKUPS | tables
    frames = {
        name: frame(spark, name, given.get(name, [])) for name in SOURCES if name != "calendar" or name in tables
    }
    return SourceTables.from_frames(spark, frames)


def rows(df, *columns):
    """Sorted tuples of a DataFrame, NULLs first."""
    picked = df.select(*columns) if columns else df
    key = lambda r: tuple((v is not None, v) for v in r)
    return sorted((tuple(r) for r in picked.collect()), key=key)
