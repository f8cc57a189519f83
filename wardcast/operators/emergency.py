"""Emergency department admissions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardcast.config import ForecastConfig
from wardcast.functions.keys import KeySet
from wardcast.functions.text import label
from wardcast.plans.staging import Lazy
from wardcast.sources.tables import SourceTables


def emergency_admissions(tables: SourceTables, cfg: ForecastConfig, stage=Lazy()) -> DataFrame:
    """Number of valid admission events per encounter.

    Event codes are stored as text or numbers depending on the source; the
    literals are text, as the input layout says. A status of NULL is valid. Where results are
    stored, the valid events reduce the links before any of these is shuffled.
    """
    codes = cfg.codes
    status = F.col("status_c")
    events = (
        tables["ed_event"]
        .where(F.col("department_id") == codes.emergency_department)
        .where(F.col("event_type") == codes.emergency_admit_event)
        .where((status != codes.emergency_event_voided) | status.isNull())
        .select("event_id")
    )
    links = tables["ed_event_link"]
    if stage.stores:
        events = stage("emergency_events", events)
        links = KeySet.of(events, "event_id", stored=True).reduce(links, "event_id")
    return (
        links.join(events, "event_id")
        .groupBy("csn")
        .agg(F.count("*").alias("ed_events"))
    )


def acuity_labels(acuity: DataFrame) -> DataFrame:
    """``code: name`` text of each acuity level."""
    return acuity.select(
        "acuity_c", label(F.col("acuity_c"), ": ", F.col("acuity_name")).alias("acuity_level")
    )
