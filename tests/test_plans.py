"""What the physical plans must and must not contain."""

import pytest

from bindings.order_tables import CONFIG, source_tables
from tests.fixtures import CFG, sources
from wardcast.operators import surgery, transfers
from wardcast.plans.forecast import Forecast
from wardcast.plans.staging import Lazy, Tables
from wardcast.sources.layout import SOURCES
from wardcast.sources.tables import SourceTables

DATA = "/root/testdata/sf0.001"


def plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "2000")
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """The bound source tables as files, so that scans show their filters."""
    root = str(tmp_path_factory.mktemp("stored"))
    given = source_tables(spark, DATA)
    for name, source in SOURCES.items():
        if name == "calendar":  # days are generated
            continue
        given[name].toDF(*[source.columns[c][0] for c in given[name].columns]).write.parquet(f"{root}/{source.physical}.parquet")
    return SourceTables.from_parquet(spark, root)


def test_encounter_filters_reach_the_scan(stored):
    text = plan(Forecast(stored, CONFIG, Lazy()).encounters)
    scan = next(line for line in text.splitlines() if "HOSP_ADMSN_TIME" in line and "FileScan" in line)
    for pushed in ("EqualTo(ADT_SERV_AREA_ID,10)", "EqualTo(ADMIT_CONF_STAT_C,1)", "In(ADT_PATIENT_STAT_C, [2,3])"):
        assert pushed in scan
    assert "GreaterThanOrEqual(HOSP_DISCH_TIME" in scan


def test_census_dates_reach_the_scan(stored):
    text = plan(Forecast(stored, CONFIG, Lazy()).history)
    scan = next(line for line in text.splitlines() if "EFFECTIVE_TIME" in line and "FileScan" in line)
    assert "GreaterThanOrEqual(EFFECTIVE_TIME" in scan and "LessThan(EFFECTIVE_TIME" in scan


def test_forecast_reads_only_the_part_of_the_profile_it_needs(spark, stored):
    f = Forecast(stored, CONFIG, Tables(spark))

    def scans(df):
        return [line for line in plan(df).splitlines() if "FileScan" in line and "/profile]" in line]

    assert any("GreaterThanOrEqual(admit_ts" in s and "LessThan(ed_departure_ts" in s for s in scans(f.predicted))
    assert all("IsNotNull(disch_ts)" in s for s in scans(f.curves))
    assert any("LessThan(admit_ts" in s for s in scans(f.current_tagged))


def test_columns_are_pruned(stored):
    text = plan(transfers.latest_status(stored["status_history"]))
    assert "ReadSchema: struct<COMM_ID:bigint,LINE:int,REQUEST_STATUS_C:int,STATUS_UPDATE_UTC_DTTM" in text


def test_ranking_prunes_before_the_shuffle(stored):
    for df in (
        surgery.first_procedure(surgery.performed_surgeries(stored, CONFIG)),
        transfers.latest_status(stored["status_history"]),
        transfers.transfer_destinations(stored, CONFIG),
    ):
        assert "Partial" in "".join(line for line in plan(df).splitlines() if "WindowGroupLimit" in line)


def _above(lines, at):
    """The operators that line ``at`` of a plan feeds, nearest first."""
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    least = depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) < least:
            least = depth(line)
            yield line


def test_destinations_reduce_encounters_and_histories_first(spark, stored, tmp_path):
    with Tables(spark, str(tmp_path)) as stage:
        text = plan(transfers.transfer_destinations(stored, CONFIG, stage))
    # Counted and few: a broadcast on the scan's side of each exchange, before anything is ranked.
    for column, ids in (("ADMIT_CONF_STAT_C", "attached"), ("STATUS_UPDATE_UTC_DTTM", "targets")):
        lines = text.splitlines()
        scan = next(i for i, line in enumerate(lines) if "FileScan" in line and column in line)
        first = next(line for line in _above(lines, scan) if "Join" in line or "Exchange" in line)
        assert "BroadcastHashJoin" in first and "LeftSemi" in first
        assert any(f"/{ids}]" in line for line in lines)
    unstaged = plan(transfers.transfer_destinations(stored, CONFIG))
    assert unstaged.count("LeftSemi") >= 3


def test_bucketed_results_are_not_shuffled_again(spark, stored, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with Tables(spark, str(tmp_path)) as stage:
            f = Forecast(stored, CONFIG, stage)
            for df, name in ((f.history, "profile"), (f.profile.join(f.profile.select("csn"), "csn", "left_semi"), "profile")):
                lines = plan(df).splitlines()
                at = max(i for i, line in enumerate(lines) if "FileScan" in line and f"/{name}]" in line)
                assert "Bucketed: true" in lines[at]
                assert "SortMergeJoin" in next(line for line in _above(lines, at) if "Join" in line or "Exchange" in line)
            assert f.history.count() > 0
            assert len(stage._bucketed) == 2
        assert not [t for t in spark.catalog.listTables() if stage._id in t.name] and not list(tmp_path.iterdir())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_products_and_no_python_rows(spark, stored):
    f = Forecast(stored, CONFIG, Tables(spark))
    for df in (f.rows, f.profile, f.due, f.expected_surgeries):
        text = plan(df)
        for word in ("CartesianProduct", "NestedLoop", "EvalPython", "MapInPandas"):
            assert word not in text


def test_encounters_are_shuffled_once_for_all_evidence(spark, stored):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        f = Forecast(stored, CONFIG, Lazy())
        staged = Tables(spark)
        f.encounters = staged("encounters", f.encounters, by="csn")
        f.deliveries = staged("deliveries", f.deliveries)
        text = plan(f.profile)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    whole = [line for line in text.splitlines() if "FileScan" in line and "ed_departure_ts" in line]
    assert len(whole) == 1
    # The only other movement of the wide rows is the acuity lookup, a broadcast by default.
    assert text.count("SortMergeJoin [csn") >= 5


def test_default_config_needs_no_data(spark):
    assert Forecast(sources(spark), CFG, Lazy()).profile.count() == 0
