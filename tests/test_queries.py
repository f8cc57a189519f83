"""Every registered query against its SQL on the smallest test tables."""

from pathlib import Path

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from bindings.order_tables import CONFIG, source_tables
from bindings.registry import BUILDS
from check import compare, open_checker
from wardcast.plans.forecast import Forecast
from wardcast.plans.staging import Tables

DATA = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="test tables not present")


@pytest.fixture(scope="module")
def checker():
    return open_checker(DATA)


@pytest.fixture(scope="module")
def staged(spark):
    """One forecast for all queries; ``check.py`` runs each on its own."""
    return Forecast(source_tables(spark, DATA), CONFIG, Tables(spark))


def test_every_query_has_sql():
    assert set(BUILDS) <= set(queries()) & set(oracle_sql())


@pytest.mark.parametrize("name", list(BUILDS))
def test_query_equals_sql(staged, checker, name):
    ok, text = compare(lambda: BUILDS[name](staged), checker, name)
    assert ok, text


@pytest.mark.parametrize("name", ["q10_survival_two_keys", "q28_source_tags"])
def test_query_from_the_entry_point(spark, checker, name):
    ok, text = compare(lambda: queries()[name](spark, DATA), checker, name)
    assert ok, text


def test_entry(spark):
    assert entry(spark).limit(1).count() == 1
