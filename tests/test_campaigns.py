import datetime as dt

import pytest
from helpers import day

from pyspark.sql import functions as F

from tidemark.operators import campaigns as C


def config(spark, **over):
    row = {"campaign": "Test", "month": 2, "day": 14, "window": 7, "default_lift": 2.5,
           "baseline_units": 110, "keywords": ["All"], **over}
    return C.campaigns(spark, [row])


def daily(spark, pairs):
    return spark.createDataFrame([(day(d), float(y)) for d, y in pairs], "ds date, y double")


def lift(spark, pairs, **over):
    return C.observed_lift(daily(spark, pairs), config(spark, **over)).first()


def test_config_is_a_local_table(spark):
    plan = C.campaigns(spark)._jdf.queryExecution().executedPlan().toString()
    assert "LocalTableScan" in plan
    assert C.campaigns(spark).count() == 4


def test_window_edges(spark, rows):
    days = daily(spark, [("2014-02-06", 1), ("2014-02-07", 1), ("2014-02-15", 1), ("2014-02-16", 1)])
    flags = [r["is_holiday"] for r in rows(C.holiday_days(days, config(spark)), "ds")]
    assert flags == [False, True, True, False]


def test_year_boundary_needs_the_next_year(spark, rows):
    new_year = dict(month=1, day=1)
    only_old = daily(spark, [("2013-12-28", 1), ("2013-01-02", 1)])
    flags = [r["is_holiday"] for r in rows(C.holiday_days(only_old, config(spark, **new_year)), "ds")]
    assert flags == [True, False]
    both = daily(spark, [("2013-12-28", 1), ("2014-05-01", 1)])
    flags = [r["is_holiday"] for r in rows(C.holiday_days(both, config(spark, **new_year)), "ds")]
    assert flags == [True, False]


def test_lift_against_same_month(spark):
    base = [(f"2014-02-{d:02d}", 100) for d in (1, 2, 3, 20, 21)]
    row = lift(spark, base + [("2014-02-14", 188), ("2014-06-01", 9999)])
    assert (row.holiday_days, row.baseline_days) == (1, 5)
    assert row.observed_lift == pytest.approx(1.88) and row.planned_lift == pytest.approx(2.538)


def test_few_month_days_use_all_other_days(spark):
    base = [(f"2014-02-{d:02d}", 100) for d in (1, 2, 3, 20)] + [("2014-06-01", 600)]
    assert lift(spark, base + [("2014-02-14", 300)]).observed_lift == pytest.approx(300 / 200)


def test_default_and_clip(spark):
    assert lift(spark, [("2014-06-01", 5)]).observed_lift == 2.5
    assert lift(spark, [("2014-02-14", 5)]).observed_lift == 2.5
    base = [(f"2014-02-{d:02d}", 100) for d in (1, 2, 3, 20, 21)]
    assert lift(spark, base + [("2014-02-14", 900)]).observed_lift == 5.0
    assert lift(spark, base + [("2014-02-14", 10)]).observed_lift == 0.5
    assert lift(spark, []).observed_lift == 2.5


@pytest.mark.parametrize("observed,planned", [(1.88, 2.538), (1.10, 2.0), (1.01, 2.0), (1.16, 2.0), (4.9, 5.0)])
def test_planned_lift(spark, observed, planned):
    value = spark.range(1).select(C.planned_lift(F.lit(observed))).first()[0]
    assert value == pytest.approx(planned)


def peak(spark, series, last, **over):
    df = spark.createDataFrame([(day(d), float(y)) for d, y in series], "ds date, yhat double")
    return C.campaign_peak(df, config(spark, **over), F.lit(dt.date.fromisoformat(last))).first()


def test_future_peak_beats_a_higher_past_one(spark):
    row = peak(spark, [("2014-02-10", 900), ("2015-02-10", 7.9), ("2015-02-11", 7.9), ("2015-02-22", 99)], "2014-12-31")
    assert (row.peak_date, row.projected_volume, row.is_future) == (day("2015-02-10"), 7, True)


def test_peak_history_only_and_none(spark):
    row = peak(spark, [("2014-02-21", 3.5), ("2014-02-22", 9)], "2014-12-31")
    assert (row.peak_date, row.projected_volume) == (day("2014-02-21"), 3)
    row = peak(spark, [("2014-03-01", 3.5)], "2014-12-31")
    assert (row.peak_date, row.projected_volume) == (None, 0)


def test_peak_window_stays_in_its_month(spark):
    over = dict(month=10, day=31)
    row = peak(spark, [("2014-10-24", 1), ("2014-10-31", 2), ("2014-11-01", 50), ("2014-10-23", 60)], "2014-01-01", **over)
    assert row.peak_date == day("2014-10-31")


def test_negative_peak_is_truncated_towards_zero(spark):
    assert peak(spark, [("2015-02-10", -1.7)], "2014-12-31").projected_volume == -1


def test_action(spark, rows):
    peaks = spark.createDataFrame([("A", 131), ("B", 130)], "campaign string, projected_volume bigint")
    got = rows(C.campaign_action(peaks, daily(spark, [("2014-01-01", 50), ("2014-01-02", 150)])), "campaign")
    assert [(r["action_item"], r["status_color"]) for r in got] == [
        ("Increase Stock Levels", "green"), ("Run Discount Ads", "yellow")]
    assert {r["strategy"] for r in got} == {"Maximize GMV"}


def test_lift_ranges_hold_for_any_series(spark):
    import random
    rng = random.Random(7)
    start = dt.date(2012, 1, 1)
    pairs = [((start + dt.timedelta(days=i)).isoformat(), rng.choice([0.01, 1, 50, 4000])) for i in range(0, 900, 2)]
    for row in C.observed_lift(daily(spark, pairs), C.campaigns(spark)).collect():
        assert 0.5 <= row.observed_lift <= 5 and 2 <= row.planned_lift <= 5
