"""What is reduced before it is shuffled where results are stored, against the unstored plans."""

import pytest
from pyspark.sql import functions as F

from bindings.order_tables import CONFIG, source_tables
from tests.fixtures import rows
from wardcast.functions import keys
from wardcast.functions.keys import KeySet
from wardcast.operators import emergency, encounters, obstetrics, surgery, transfers
from wardcast.plans.forecast import Forecast
from wardcast.plans.staging import Lazy, Tables

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def stage(spark, tmp_path):
    with Tables(spark, str(tmp_path)) as stage:
        yield stage


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_filter_goes_below_the_groups(spark, monkeypatch):
    monkeypatch.setattr(keys, "MOST_KEYS", 5)
    wide = spark.range(5_000).select((F.col("id") % 1000).alias("k"), (F.col("id") % 7).alias("v"))
    grouped = wide.groupBy("k").agg(F.max("v").alias("v"))
    known = KeySet.of(spark.range(0, 1000, 10).withColumnRenamed("id", "k"), "k", True)
    reduced = known.reduce(grouped, "k")
    lines = _plan(reduced).splitlines()
    assert next(i for i, x in enumerate(lines) if "Aggregate" in x) < next(i for i, x in enumerate(lines) if "LeftSemi" in x)
    got = {r["k"]: r["v"] for r in reduced.collect()}
    assert set(range(0, 1000, 10)) <= set(got) and len(got) < 250
    assert got == {r["k"]: r["v"] for r in grouped.collect() if r["k"] in got}


def test_keys_of_another_type_are_joined(spark, monkeypatch):
    monkeypatch.setattr(keys, "MOST_KEYS", 5)
    known = KeySet.of(spark.range(50).select(F.col("id").cast("int").alias("k")), "k", True)
    assert known.reduce(spark.range(100).withColumnRenamed("id", "k"), "k").count() == 50


def test_keys_are_counted_and_filtered_once(spark, monkeypatch):
    monkeypatch.setattr(keys, "MOST_KEYS", 5)
    kept = []
    facts = spark.range(9_000).select((F.col("id") % 300).alias("k"))
    known = KeySet.of(facts, "k", True, lambda blocks: kept.append(blocks) or blocks)
    assert 300 <= known.number < 400 and kept == [known.blocks]
    assert {r["k"] for r in known.reduce(spark.range(1000).withColumnRenamed("id", "k"), "k").collect()} >= set(range(300))
    assert KeySet.of(facts.limit(5), "k", True, kept.append).blocks is None


@pytest.mark.parametrize("few", [0, 10**6])
def test_reduced_evidence_is_the_evidence(spark, stage, monkeypatch, few):
    monkeypatch.setattr(keys, "MOST_KEYS", few)
    t = source_tables(spark, DATA)
    for build in (
        surgery.performed_surgeries,
        emergency.emergency_admissions,
        obstetrics.prior_contacts,
        transfers.transfer_requests,
        transfers.transfer_destinations,
        encounters.encounters,
    ):
        want = build(t, CONFIG)
        assert rows(build(t, CONFIG, stage), *want.columns) == rows(want) and want.count() > 20


def test_reduced_schedule_is_the_schedule(spark, stage):
    f = Forecast(source_tables(spark, DATA), CONFIG, Lazy())
    want = surgery.scheduled_cases(f.tables, f.current, f.due, CONFIG)
    got = surgery.scheduled_cases(f.tables, f.current, f.due, CONFIG, stage)
    assert rows(got) == rows(want) and want.count() > 3


def test_links_and_contacts_are_reduced_where_results_are_stored(spark, stage):
    t = source_tables(spark, DATA)
    assert _plan(surgery.performed_surgeries(t, CONFIG, stage)).count("LeftSemi") >= 3
    lines = _plan(emergency.emergency_admissions(t, CONFIG, stage)).splitlines()
    semi = next(i for i, x in enumerate(lines) if "LeftSemi" in x)
    # Ahead of the links' own groups: those come from repeated lines.
    assert sum("Aggregate" in x for x in lines[:semi]) == 2


def test_movements_are_made_once(spark, stage):
    f = Forecast(source_tables(spark, DATA), CONFIG, stage)
    scans = [p for p in f.history.inputFiles() if "/moves/" in p]
    assert scans and not any("lineitem" in p for p in f.history.inputFiles())


def test_bookings_are_made_once_for_surgeries_and_schedule(spark, stage):
    f = Forecast(source_tables(spark, DATA), CONFIG, stage)
    _ = f.bookings
    for df in (f.first_surgeries, f.expected_surgeries):
        assert any("/bookings/" in p for p in df.inputFiles())
    alone = Forecast(source_tables(spark, DATA), CONFIG, Lazy())
    assert rows(f.expected_surgeries) == rows(alone.expected_surgeries)
    assert rows(f.first_surgeries) == rows(alone.first_surgeries)
