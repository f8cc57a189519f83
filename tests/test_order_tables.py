"""The source tables over orders and lines that are stored by order, against those over the files."""

from datetime import datetime

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from bindings import registry
from bindings.order_tables import BASE, BY_ORDER, SOURCE_SQL, source_tables
from tests.fixtures import rows
from wardcast.plans.staging import Tables

DATA = "/root/testdata/sf0.001"
TEXTS = [name for name, text in SOURCE_SQL.items() if "{orders}" in text or "{lineitem}" in text]


@pytest.fixture
def stage(spark, tmp_path):
    with Tables(spark, str(tmp_path / "kept")) as stage:
        yield stage


@pytest.fixture
def odd(tmp_path):
    """Orders without lines, lines without orders, keys that are null or repeated, and rows that come twice."""
    at = tmp_path / "odd"
    at.mkdir()
    for name in set(BASE) - set(BY_ORDER):
        pq.write_table(pq.read_table(f"{DATA}/{name}.parquet"), at / f"{name}.parquet")
    day = datetime(2001, 3, 1)
    orders = [(k, c, s, p, day, "1-URGENT") for k, c, s, p in [
        (1, 1, "F", 5e4), (2, 2, "O", 4.4e5), (2, 3, "P", 1.2e5), (2, 3, "P", 1.2e5), (None, 4, "O", None), (9, None, None, 1e5),
    ]]
    lines = [(k, 5, 6, n, 12.0, 1.0, d, 0.02, f, s, day) for k, n, d, f, s in [
        (1, 1, 0.1, "A", "F"), (1, 1, 0.1, "A", "F"), (1, 7, 0.0, "R", "O"), (2, 2, 0.1, "A", "O"), (2, None, None, None, None),
        (None, 1, 0.1, "A", "F"), (None, 1, 0.1, "A", "F"), (7, 1, 0.1, "N", "O"),
    ]]
    for name, given in (("orders", orders), ("lineitem", lines)):
        schema = pq.read_schema(f"{DATA}/{name}.parquet").remove_metadata()
        columns = [pa.array(c, t) for c, t in zip(zip(*given), schema.types)]
        pq.write_table(pa.table(columns, schema=schema), at / f"{name}.parquet")
    return str(at)


@pytest.mark.parametrize("at", ["odd", DATA])
def test_stored_orders_and_lines_make_the_same_tables(spark, stage, at, request):
    at = request.getfixturevalue("odd") if at == "odd" else at
    plain, stored = source_tables(spark, at), source_tables(spark, at, stage)
    for name in TEXTS:
        assert stored[name].dtypes == plain[name].dtypes
        assert rows(stored[name]) == rows(plain[name]), name


@pytest.mark.parametrize(
    "name", ["encounter", "delivery", "movement", "contact", "surgery_log", "surgery_log_detail", "ed_event", "status_history"]
)
def test_lines_are_not_shuffled_again_for_a_table(spark, stage, name):
    def shuffles(tables):
        return tables[name]._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # no order table is small
    try:
        assert shuffles(source_tables(spark, DATA)) > 0
        assert shuffles(source_tables(spark, DATA, stage)) == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rows_of_a_bucket_are_stored_in_order(spark, stage, tmp_path):
    keys = spark.range(1000).selectExpr("nullif(id * 7919 % 100, 5) * 1000 AS key", "id % 10 AS other")
    kept = stage("keys", keys, by="key")
    assert rows(kept) == rows(keys)
    for at in tmp_path.glob("kept/*/keys/*.parquet"):
        held = [-1 if k is None else k for k in pq.read_table(at)["key"].to_pylist()]
        assert held and held == sorted(held)


def test_queries_over_the_profile_read_stored_lines(spark, stage, tmp_path, monkeypatch):
    monkeypatch.setattr(registry, "Tables", lambda spark: stage)
    registry.QUERIES["q28_source_tags"](spark, DATA)
    (run,) = (tmp_path / "kept").iterdir()
    assert {p.name for p in run.glob("base_*")} == {"base_orders", "base_lineitem"}
