from dataclasses import replace
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from tests.fixtures import AS_OF, CFG, rows
from wardcast.functions.rows import repeat_rows
from wardcast.operators import arrivals, calendar, occupancy, surgery
from wardcast.operators.survival import from_days


def full_calendar(spark, cfg=CFG):
    days = calendar.generated_days(spark, cfg.hist_start, cfg.long_end, cfg.holidays)
    return calendar.forecast_calendar(calendar.adjusted_calendar(days, cfg), cfg)


def at(days, hour=0):
    return datetime(AS_OF.year, AS_OF.month, AS_OF.day, hour) + timedelta(days=days)


def test_lookback_edges_and_divisor(spark):
    # as_of is a Monday: -28 and -7 are Mondays inside the window, 0 and -29 are outside it.
    pop = spark.createDataFrame(
        [("k", at(-28)), ("k", at(-7, 23)), ("k", at(0)), ("k", at(-29, 23)), (None, at(-6))], "k string, t timestamp_ntz"
    )
    got = rows(arrivals.predict_arrivals_dow(pop, "t", ["k"], full_calendar(spark), CFG), "k", "dow_adjusted", "expected")
    assert got == [(None, 3, 1 / 4), ("k", 2, 2 / 4)]


def test_weighted_arrivals(spark):
    pop = spark.createDataFrame([(at(-7), 3), (at(-14), 2)], "t timestamp_ntz, copies long")
    got = rows(arrivals.predict_arrivals_dow(pop, "t", [], full_calendar(spark), CFG, weight="copies"))
    assert got == [(2, 5 / 4)]


def test_daily_arrivals_start_on_day_one(spark):
    by_dow = spark.createDataFrame([(2, 1.5)], "dow_adjusted int, expected double")
    got = rows(arrivals.predict_arrivals_daily(by_dow, full_calendar(spark), 30), "arr_day", "expected")
    assert got == [(d, 1.5) for d in (1, 8, 15, 22, 29)]  # weekdays without a rate have no row


def test_spread_is_the_truncated_product(spark):
    arr = [("a", 1, 2.0), ("a", 30, 1.0), ("a", 31, 5.0), ("b", 2, 1.0), (None, 1, 9.0)]
    curve = [("a", d, 1 / (d + 1)) for d in range(31)] + [(None, d, 1.0) for d in range(31)]
    df = occupancy.spread_occupancy(
        spark.createDataFrame(arr, "k string, arr_day int, expected double"),
        from_days(spark.createDataFrame(curve, "k string, day_num int, probability double"), ["k"]),
        ["k"], 30, CFG,
    )
    want = sorted(
        (k, a, d, a + d, AS_OF + timedelta(days=a + d - 1), p * n)
        for k, a, n in arr for j, d, p in curve if k is not None and k == j and a + d <= 30
    )
    assert rows(df, "k", "arr_day", "post_arr_day", "days_out", "day_date", "occupancy") == want


def test_spread_without_keys(spark):
    df = occupancy.spread_occupancy(
        spark.createDataFrame([(29, 2.0)], "arr_day int, expected double"),
        from_days(spark.createDataFrame([(d, 0.5) for d in range(31)], "day_num int, probability double"), []),
        [], 30, CFG,
    )
    assert rows(df, "post_arr_day", "occupancy") == [(0, 1.0), (1, 1.0)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_daily_occupancy_is_the_sum_of_the_spread(spark):
    arr = [("a", "x", 1, 2.0), ("a", "x", 1, 0.5), ("a", "y", 3, 1.0), ("a", "x", 9, 4.0), ("a", "x", 31, 5.0), ("b", "x", 30, 1.0), (None, "x", 1, 9.0)]
    curve = [("a", d, 1 / (d + 1)) for d in range(31)] + [("b", d, 0.25) for d in range(31)] + [("c", d, 1.0) for d in range(31)]
    arrived = spark.createDataFrame(arr, "k string, s string, arr_day int, expected double")
    curves = from_days(spark.createDataFrame(curve, "k string, day_num int, probability double"), ["k"])
    total = F.round(F.sum("occupancy"), 9).alias("occupancy")
    want = occupancy.spread_occupancy(arrived, curves, ["k"], 30, CFG).groupBy("k", "s", "days_out").agg(total)
    got = occupancy.daily_occupancy(arrived, curves, ["k"], 30, ["s"]).withColumn("occupancy", F.round("occupancy", 9))
    assert rows(got, "k", "s", "days_out", "occupancy") == rows(want) and got.count() == 30 + 28 + 1
    by_key = occupancy.daily_occupancy(arrived.withColumn("h", F.lit(5)), curves, ["k"], "h")
    assert by_key.columns == ["k", "days_out", "occupancy"] and {r["days_out"] for r in by_key.collect()} == {1, 2, 3, 4, 5}
    one = from_days(spark.createDataFrame([(0, 1.0), (1, 0.5)], "day_num int, probability double"), [])
    assert rows(occupancy.daily_occupancy(arrived.where("k is null"), one, [], 3)) == [(1, 9.0), (2, 4.5), (3, 0.0)]
    assert rows(occupancy.daily_occupancy(arrived.limit(0), one, [], 3)) == []


def test_rollup_switches(spark):
    df = spark.createDataFrame(
        [(date(2021, 5, 3), "ED", 1.0, "p"), (date(2021, 5, 3), "ED", 0.5, "p"), (date(2021, 5, 3), "OB", 2.0, "p"),
         (date(2021, 5, 3), "ED", 7.0, "h")],
        "day_date date, Pt_Type string, Est_Occupancy double, prediction_status string",
    )
    assert rows(occupancy.rollup(df, ["ED"], ["p"])) == [(date(2021, 5, 3), "ED", 1.5)]
    assert len(rows(occupancy.rollup(df))) == 2


def test_schedule_factor(spark):
    arr = spark.createDataFrame([("KNEE", 2.0), ("HIP", 4.0)], "p string, expected double")
    factors = spark.createDataFrame([("KNEE", 0.5)], "p string, factor double")
    assert rows(surgery.scale_schedule(arr, factors, ["p"])) == [("HIP", 4.0), ("KNEE", 1.0)]


def test_repeat_rows_in_blocks(spark):
    df = spark.createDataFrame([("a", 1), ("b", 3), ("c", 140000)], "k string, copies long")
    got = {r.k: r["count"] for r in repeat_rows(df).groupBy("k").count().collect()}
    assert got == {"a": 1, "b": 3, "c": 140000}
    assert repeat_rows(df.where(F.col("k") == "b")).columns == ["k"]


def test_long_horizon_calendar(spark):
    cfg = replace(CFG, horizon_long=10)
    by_dow = spark.createDataFrame([(1, 1.0)], "dow_adjusted int, expected double")
    assert rows(arrivals.predict_arrivals_daily(by_dow, full_calendar(spark, cfg), 10), "arr_day") == [(6,), (7,)]
