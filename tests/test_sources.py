import os
import subprocess
import sys
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tests.fixtures import CFG, encounter, frame, rows, sources
from wardcast.functions.dates import utc_to_local
from wardcast.plans import staging
from wardcast.plans.forecast import OUTPUT_COLUMNS, Forecast
from wardcast.plans.staging import Lazy, Tables
from wardcast.sources.layout import SOURCES
from wardcast.sources.sink import read_forecast, tidy, write_forecast
from wardcast.sources.tables import SourceTables, to_logical


def physical(df, name):
    return df.toDF(*[SOURCES[name].columns[c][0] for c in df.columns])


def test_layout_is_consistent():
    names = [s.physical for s in SOURCES.values()]
    assert len(set(names)) == len(names) == 35
    for source in SOURCES.values():
        assert {t for _, t in source.columns.values()} <= {"bigint", "int", "string", "date", "timestamp"}


def test_parquet_and_catalog_round_trip(spark, tmp_path):
    given = sources(spark, encounter=[encounter(1, "a", "2021-04-26", "2021-04-28"), encounter(3, "c", "2021-05-02")])
    calendar_rows = [{"day_date": date(2021, 4, 1), "workday": 1, "holiday": 0}]
    for name in SOURCES:
        df = frame(spark, name, calendar_rows) if name == "calendar" else given[name]
        physical(df, name).write.parquet(f"{tmp_path}/{SOURCES[name].physical}.parquet")
        spark.read.parquet(f"{tmp_path}/{SOURCES[name].physical}.parquet").createOrReplaceTempView(f"w_{SOURCES[name].physical}")
    from_files = SourceTables.from_parquet(spark, str(tmp_path))
    from_names = SourceTables.from_catalog(spark, "none", {n: f"w_{s.physical}" for n, s in SOURCES.items()})
    for tables in (from_files, from_names):
        assert rows(Forecast(tables, CFG, Lazy()).encounters, "csn") == [(1,), (3,)]
        assert tables.has("calendar") and tables["calendar"].columns == ["day_date", "workday", "holiday"]


def test_codes_are_cast_only_where_they_differ(spark):
    df = spark.sql("SELECT 7L AS EVENT_ID, 10410001 AS EVENT_DEPT_ID, '1' AS event_status_c, 65 AS EVENT_TYPE")
    got = to_logical("ed_event", df)
    assert got.dtypes == [("event_id", "bigint"), ("department_id", "string"), ("status_c", "int"), ("event_type", "string")]
    assert rows(got) == [(7, "10410001", 1, "65")]


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="EVENT_ID"):
        to_logical("ed_event", spark.sql("SELECT 1 AS x"))
    with pytest.raises(ValueError, match="event_id"):
        SourceTables.from_frames(spark, {"ed_event": spark.sql("SELECT 1 AS status_c")})["ed_event"]


def test_forecast_is_written_by_status(spark, tmp_path):
    f = Forecast(sources(spark, encounter=[encounter(3, "c", "2019-05-02")]), CFG, Lazy())
    write_forecast(f.rows, str(tmp_path / "out"), CFG.as_of)
    back = read_forecast(spark, str(tmp_path / "out"))
    assert back.columns == OUTPUT_COLUMNS and back.dtypes == f.rows.dtypes and back.count() == 31
    only = back.where("prediction_status = 'Historical Census'")
    assert "PartitionFilters: [isnotnull(prediction_status" in only._jdf.queryExecution().executedPlan().toString()


def published(spark, rows_):
    return spark.createDataFrame(rows_, "n int, prediction_status string")


def test_a_run_that_fails_leaves_the_one_before(spark, tmp_path):
    path = str(tmp_path)
    with pytest.raises(LookupError):
        read_forecast(spark, path)
    write_forecast(published(spark, [(1, "a"), (2, "b")]), path, CFG.as_of)
    # One partition is written and another raises.
    bad = published(spark, [(i, "a") for i in range(8)]).repartition(8, "n").withColumn("n", F.expr("IF(n = 5, raise_error('no'), n)"))
    with pytest.raises(Exception, match="no"):
        write_forecast(bad, path, CFG.as_of)
    assert rows(read_forecast(spark, path)) == [(1, "a"), (2, "b")]
    assert len(list((tmp_path / "runs").iterdir())) == 1
    # What a driver that is killed would leave: a run without its marker.
    published(spark, [(9, "z")]).write.partitionBy("prediction_status").parquet(f"{path}/runs/half")
    (tmp_path / "published" / "_2021-05-03.1.half").write_text("x")
    assert rows(read_forecast(spark, path)) == [(1, "a"), (2, "b")]


def test_runs_replace_those_of_their_day(spark, tmp_path):
    path, earlier = str(tmp_path), CFG.as_of - timedelta(days=1)
    reader = write_forecast(published(spark, [(1, "a")]), path, CFG.as_of) and read_forecast(spark, path)
    write_forecast(published(spark, [(2, "a")]), path, CFG.as_of)
    write_forecast(published(spark, [(3, "a")]), path, earlier)
    write_forecast(published(spark, []), path, earlier)
    assert rows(reader) == [(1, "a")]  # who reads the run before goes on reading it
    assert rows(read_forecast(spark, path)) == [(2, "a")]
    assert rows(read_forecast(spark, path, earlier)) == []
    published(spark, [(9, "z")]).write.parquet(f"{path}/runs/half")
    tidy(spark, path)
    assert len(list((tmp_path / "runs").iterdir())) == 2
    assert rows(read_forecast(spark, path)) == [(2, "a")] and rows(read_forecast(spark, path, earlier)) == []


def test_output_types(spark):
    f = Forecast(sources(spark), CFG, Lazy())
    assert f.rows.dtypes == [
        ("Uniq_ID", "string"), ("Days_Out", "int"), ("day_date", "date"), ("Est_Occupancy", "double"),
        ("Pt_Type", "string"), ("arrival_day", "int"), ("post_arr_day", "int"), ("prediction_status", "string"),
        ("Primary_Procedure", "string"), ("sub_type", "string"), ("severity_level", "string"),
    ]


class Session:
    """Just enough of a session to ask for its folder."""

    def __init__(self, master, folder=None):
        self.sparkContext = type("Context", (), {"master": master})()
        self.settings = {"spark.checkpoint.dir": folder} if folder else {}
        self.conf = self

    def get(self, key, default):
        return self.settings.get(key, default)

    def set(self, key, value):
        self.settings[key] = value


def test_shared_folder_comes_from_the_session():
    assert staging.shared_folder(Session("spark://host:7077", "hdfs://name/shared/")) == "hdfs://name/shared"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging.shared_folder(Session("yarn"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging.shared_folder(Session("local[2]"))
    assert staging.shared_folder(Session("local[2]"), "/given/") == "/given"


PLAIN = """
import sys
from pyspark.sql import SparkSession
from tests.fixtures import CFG, encounter, sources
from wardcast.plans.forecast import Forecast
from wardcast.plans.staging import Tables
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
spark.conf.set("spark.sql.shuffle.partitions", "1")
tables = sources(spark, encounter=[encounter(3, "c", "2021-05-02")])
try:
    Forecast(tables, CFG)
except ValueError as error:
    print("refused:", error)
with Tables(spark, sys.argv[1]) as stage:
    print("rows:", Forecast(tables, CFG, stage).profile.count())
"""


def test_plain_session_needs_a_folder_and_leaves_none(tmp_path):
    (tmp_path / "conf").mkdir()
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path / "conf"), "PYTHONPATH": os.getcwd()}
    (tmp_path / "stage").mkdir()
    out = subprocess.run(
        [sys.executable, "-c", PLAIN, str(tmp_path / "stage")], env=env, capture_output=True, text=True, timeout=300
    )
    assert "refused:" in out.stdout and "rows: 1" in out.stdout, out.stderr[-2000:]
    assert not list((tmp_path / "stage").iterdir())


@pytest.mark.parametrize("zone", ["UTC", "America/Chicago", "America/New_York"])
def test_utc_to_local_under_any_session_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        want = ["2021-03-14 01:59:00", "2021-03-14 03:00:00", "2021-11-07 01:30:00", "2021-11-07 01:30:00", "2021-07-01 12:00:00"]
        times = ["2021-03-14 07:59:00", "2021-03-14 08:00:00", "2021-11-07 06:30:00", "2021-11-07 07:30:00", "2021-07-01 17:00:00"]
        for kind, suffix in (("timestamp", "Z"), ("timestamp_ntz", "")):
            df = spark.createDataFrame([(t + suffix,) for t in times], "t string").selectExpr(f"CAST(t AS {kind}) AS t")
            got = df.select(utc_to_local(df.t, "America/Chicago").cast("string").alias("x"))
            assert [r.x for r in got.collect()] == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_sources_without_a_calendar(spark, tmp_path):
    encounter_df = physical(sources(spark, encounter=[encounter(1, "a", "2021-04-26")])["encounter"], "encounter")
    encounter_df.write.parquet(f"{tmp_path}/{SOURCES['encounter'].physical}.parquet")
    for tables in (SourceTables.from_parquet(spark, str(tmp_path)), SourceTables.from_catalog(spark, "default")):
        assert not tables.has("calendar")
        days = Forecast(tables, CFG, Lazy()).days
        assert days.agg({"day_date": "max"}).first()[0] == CFG.long_end
    spark.range(1).write.parquet(f"{tmp_path}/{SOURCES['calendar'].physical}.parquet")
    with pytest.raises(ValueError, match="lacks"):
        SourceTables.from_parquet(spark, str(tmp_path)).has("calendar")


def test_staged_and_lazy_agree(spark):
    tables = sources(spark, encounter=[encounter(1, "a", "2021-04-26", "2021-04-28"), encounter(3, "c", "2021-05-02")])
    staged = Forecast(tables, CFG, Tables(spark)).rows
    assert rows(staged) == rows(Forecast(tables, CFG, Lazy()).rows)
