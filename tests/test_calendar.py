from dataclasses import replace
from datetime import date, timedelta

from pyspark.sql import functions as F

from tests.fixtures import AS_OF, CFG, rows
from wardcast.operators import calendar


def test_weekends_and_holidays_are_one_weekday(spark):
    cfg = replace(CFG, holidays=(date(2021, 5, 31),))
    days = calendar.generated_days(spark, cfg.hist_start, cfg.long_end, cfg.holidays)
    dow = {r.day_date: r.dow_adjusted for r in calendar.adjusted_calendar(days, cfg).collect()}
    assert dow[date(2021, 5, 1)] == 1 and dow[date(2021, 5, 2)] == 1  # weekend
    assert dow[date(2021, 5, 31)] == 1  # observed holiday on a Monday
    assert [dow[date(2021, 5, 3) + timedelta(days=n)] for n in range(5)] == [2, 3, 4, 5, 6]
    assert min(dow) == cfg.hist_start and max(dow) == cfg.long_end


def test_source_calendar_flags(spark):
    days = spark.createDataFrame(
        [(date(2021, 5, 4), 0, 0), (date(2021, 5, 5), 1, 1), (date(2021, 5, 6), 1, 0), (date(2021, 5, 7), None, None)],
        "day_date date, workday int, holiday int",
    )
    # A day off is 1 even on a Tuesday; missing flags leave the plain weekday.
    assert [r[1] for r in rows(calendar.adjusted_calendar(days, CFG))] == [1, 1, 5, 6]


def test_lookback_counts_every_day_of_the_window(spark):
    days = calendar.generated_days(spark, CFG.hist_start, CFG.long_end, (date(2021, 4, 20),))
    counts = dict(rows(calendar.lookback_days(calendar.adjusted_calendar(days, CFG), CFG)))
    assert sum(counts.values()) == CFG.lookback_days
    assert counts == {1: 9, 2: 4, 3: 3, 4: 4, 5: 4, 6: 4}


def test_day_numbers(spark):
    days = calendar.generated_days(spark, CFG.hist_start, CFG.long_end, ())
    full = calendar.forecast_calendar(calendar.adjusted_calendar(days, CFG), CFG)
    num = {r.day_date: r.day_num for r in full.where(F.col("day_num") > -2).collect()}
    assert num[AS_OF] == 1 and num[AS_OF - timedelta(days=1)] == 0 and num[CFG.long_end] == 120


def test_usable_start_of_a_leap_day():
    assert replace(CFG, hist_start=date(2020, 2, 29)).usable_start == date(2021, 2, 28)
    assert CFG.usable_start == date(2019, 1, 1)
    assert CFG.ob_start == date(2018, 10, 28)
