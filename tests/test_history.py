"""What later runs take over from earlier ones, against full runs."""

import random
from dataclasses import replace
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.fixtures import CFG, encounter, rows, sources, ts
from wardcast.functions.rows import repeat_rows
from wardcast.operators.survival import curve_arrays
from wardcast.plans.day_store import DayStore
from wardcast.plans.forecast import Forecast
from wardcast.plans.history import CensusHistory, StayHistory
from wardcast.plans.staging import Lazy

D = date(2021, 1, 1)


def day(n):
    return D + timedelta(days=n)


def frame(spark, pairs):
    return spark.createDataFrame([(day(d), n) for d, n in pairs], "day date, n int")


def stored(store, first=0, last=100):
    return [((r["day"] - D).days, r["n"]) for r in store.get(day(first), day(last)).orderBy("day", "n").collect()]


def test_days_are_stored_once_and_replaced(spark, tmp_path):
    store = DayStore(spark, str(tmp_path), "n int")
    assert stored(store) == [] and store.missing(day(0), day(3)) == [day(0), day(1), day(2)]
    store.put(frame(spark, [(0, 1), (0, 1), (1, 2), (7, 9)]), [day(0), day(1), day(2)])
    assert stored(store) == [(0, 1), (0, 1), (1, 2)]  # the seventh was not among them, the second has none
    assert store.missing(day(0), day(4)) == [day(3)]
    assert store.missing(day(0), day(4), refresh=2) == [day(2), day(3)]
    store.put(frame(spark, [(1, 5), (2, 6)]), [day(1), day(2)])
    store.put(frame(spark, []), [day(0)])
    assert stored(store) == [(1, 5), (2, 6)] and stored(store, 2, 3) == [(2, 6)]
    store.tidy()
    assert stored(store) == [(1, 5), (2, 6)] and store.missing(day(0), day(3)) == []


def test_a_failing_run_adds_nothing(spark, tmp_path):
    store = DayStore(spark, str(tmp_path), "n int")
    store.put(frame(spark, [(0, 1)]), [day(0)])
    bad = frame(spark, [(d % 4, d) for d in range(40)]).withColumn("n", F.expr("IF(n = 30, raise_error('no'), n)"))
    with pytest.raises(Exception, match="no"):
        store.put(bad, [day(d) for d in range(4)])
    assert stored(store) == [(0, 1)] and store.missing(day(0), day(4)) == [day(1), day(2), day(3)]
    # Killed between its rows and its ledger lines: the rows do not count, and the next run adds them once.
    frame(spark, [(1, 2)]).write.partitionBy("day").parquet(f"{tmp_path}/rows/run=half")
    store.put(frame(spark, [(1, 2)]), [day(1)])
    assert stored(store) == [(0, 1), (1, 2)]
    store.tidy()
    assert not (tmp_path / "rows" / "run=half").exists() and stored(store) == [(0, 1), (1, 2)]


# -- counted stays ---------------------------------------------------------------------


def stays(spark, seed, n=400):
    r = random.Random(seed)
    made = []
    for _ in range(n):
        left = datetime(2021, 1, 1) + timedelta(days=r.randrange(60), hours=r.randrange(24)) if r.random() < 0.95 else None
        made.append((r.choice(["x", "y", None]), r.choice(["u", "v"]), r.choice([None, -1, 0, 1, 2, 7, 30, 31, 500]), left))
    return spark.createDataFrame(made, "a string, b string, los int, disch_ts timestamp_ntz")


def full(given, first, last, horizon):
    some = given.where((F.col("disch_ts") >= F.lit(first)) & (F.col("disch_ts") < F.lit(last)))
    return rows(curve_arrays(some, ["a", "b"], horizon), "a", "b", "denominator", "numerators")


def test_windows_that_move_equal_full_counts(spark, tmp_path):
    given = stays(spark, 1)
    kept = StayHistory(spark, str(tmp_path), ["a", "b"], 40)
    # Forward, wider, narrower, to days that do not overlap, and back.
    for first, last in ((0, 30), (3, 33), (3, 40), (10, 35), (50, 60), (0, 60), (0, 30), (20, 20)):
        kept.update(given, "disch_ts", day(first), day(last))
        got = rows(kept.curves(day(first), day(last), 30), "a", "b", "denominator", "numerators")
        assert got == full(given, day(first), day(last), 30), (first, last)
    assert rows(kept.curves(day(0), day(60), 40), "a", "b", "denominator", "numerators") == full(given, day(0), day(60), 40)
    with pytest.raises(ValueError, match="40"):
        kept.curves(day(0), day(30), 41)
    with pytest.raises(LookupError, match="2021-03-02"):
        kept.curves(day(0), day(61), 30)


def test_a_moved_window_reads_only_days_gained_and_lost(spark, tmp_path, monkeypatch):
    given = stays(spark, 2)
    kept = StayHistory(spark, str(tmp_path), ["a", "b"], 40)
    kept.update(given, "disch_ts", day(0), day(50))
    kept.window(day(0), day(40))
    read = []
    get = kept.store.get
    monkeypatch.setattr(kept.store, "get", lambda a, b: read.append(((a - D).days, (b - D).days)) or get(a, b))
    kept.window(day(2), day(43))
    assert sorted(read) == [(0, 2), (40, 43)]
    read.clear()
    kept.window(day(2), day(43))
    assert read == []


def test_days_counted_again_make_windows_anew(spark, tmp_path):
    early, late = stays(spark, 3, 200), stays(spark, 4, 300)
    kept = StayHistory(spark, str(tmp_path), ["a", "b"], 40)
    kept.update(early, "disch_ts", day(0), day(30))
    kept.window(day(0), day(30))
    both = early.unionByName(late)
    assert kept.update(both, "disch_ts", day(0), day(30), refresh=30) == [day(n) for n in range(30)]
    assert rows(kept.curves(day(0), day(30), 30), "a", "b", "denominator", "numerators") == full(both, day(0), day(30), 30)


# -- census ----------------------------------------------------------------------------------


def hospital(spark, until, seed=5):
    """Encounters with movements each midnight, as the source shows them on a day."""
    r = random.Random(seed)
    encounters, moves = [], []
    for csn in range(60):
        start = date(2021, 4, 1) + timedelta(days=r.randrange(30))
        length = r.randrange(12)
        left = start + timedelta(days=length)
        encounters.append(encounter(csn, f"p{csn}", f"{start} 10:00", f"{left} 11:00" if left < until else None))
        for n in range(length + 1):
            when = start + timedelta(days=n)
            row = {"csn": csn, "effective_ts": ts(f"{when} 23:59"), "department_id": r.choice([1, 2, 5]), "event_type_c": 6, "event_subtype_c": 1}
            moves += [row] * r.choice([1, 1, 2]) * (when < until)
    return sources(spark, encounter=[e for e in encounters if e["admit_ts"].date() < until], movement=moves)


def test_census_by_day_equals_the_full_run(spark, tmp_path):
    kept = CensusHistory(spark, str(tmp_path), refresh=2)
    made = []
    for as_of in (date(2021, 4, 10), date(2021, 4, 11), date(2021, 4, 20), date(2021, 4, 20), date(2021, 5, 3)):
        cfg = replace(CFG, as_of=as_of)
        tables = hospital(spark, as_of)
        full_run = Forecast(tables, cfg, Lazy())
        by_day = Forecast(tables, cfg, Lazy(), census=kept)
        made.append(len(kept.store.missing(cfg.usable_start, cfg.last_census_day, 2)))
        want = rows(repeat_rows(full_run.history))
        assert rows(repeat_rows(by_day.history).select(*full_run.history.drop("copies").columns)) == want and want
    # The first run made the whole history, the others what was new and the last two days.
    assert made[0] > 800 and made[1:] == [2, 9, 2, 13]


def test_forecast_takes_curves_from_counted_days(spark, tmp_path):
    tables = hospital(spark, CFG.as_of)
    kept = StayHistory(spark, str(tmp_path), ["service_group", "service_name"], CFG.curve_days)
    for as_of in (date(2021, 4, 20), CFG.as_of):
        cfg = replace(CFG, as_of=as_of)
        got = Forecast(tables, cfg, Lazy(), stays=kept).service_curves
        want = Forecast(tables, cfg, Lazy()).service_curves
        assert rows(got, "service_name", "denominator", "numerators") == rows(want, "service_name", "denominator", "numerators")
