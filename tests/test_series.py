import datetime as dt

import numpy as np
import pytest
from helpers import day
from pyspark.sql import functions as F

from tidemark.operators import accuracy as A
from tidemark.operators import campaigns as C
from tidemark.operators import forecast as FC
from tidemark.operators import series as S
from tidemark.plans import backtest as B


def daily(spark, pairs):
    return spark.createDataFrame([(day(d), float(y)) for d, y in pairs], "ds date, y double")


def seasonal(spark, keys=("a", "b"), years=4, seed=5):
    """Trend, year, week and noise; four years from 2011."""
    rng = np.random.default_rng(seed)
    data = []
    for n, key in enumerate(keys, 1):
        for i in range(365 * years + 1):
            date = dt.date(2011, 1, 1) + dt.timedelta(days=i)
            y = n * (1000 + 0.3 * i + 200 * np.sin(2 * np.pi * i / 365.25) + 80 * (date.weekday() >= 5))
            data.append((key, date, float(round(y + n * rng.normal(0, 40), 2))))
    return spark.createDataFrame(data, "k string, ds date, y double")


def test_weeks_end_on_sunday_and_gaps_are_zero(spark, rows):
    got = rows(S.weekly_sales(daily(spark, [
        ("2014-01-05", 1),   # a Sunday closes its own week
        ("2014-01-06", 2), ("2014-01-12", 4),
        ("2014-01-20", 8),   # a Monday two weeks on
    ])), "ds")
    assert [(r["ds"].isoformat(), r["y"]) for r in got] == [
        ("2014-01-05", 1.0), ("2014-01-12", 6.0), ("2014-01-19", 0.0), ("2014-01-26", 8.0)]


def test_weekly_per_key(spark, rows):
    df = spark.createDataFrame([("a", day("2014-01-05"), 1.0), ("b", day("2014-01-01"), 2.0), ("b", day("2014-01-13"), 3.0)],
                               "k string, ds date, y double")
    got = rows(S.weekly_sales(df, ("k",)), "k", "ds")
    assert [(r["k"], r["ds"].isoformat(), r["y"]) for r in got] == [
        ("a", "2014-01-05", 1.0), ("b", "2014-01-05", 2.0), ("b", "2014-01-12", 0.0), ("b", "2014-01-19", 3.0)]


def test_calendar_and_split(spark, rows):
    df = daily(spark, [("2014-12-30", 1), ("2014-12-31", 2)])
    ahead = rows(S.future_calendar(df, horizon=3), "ds")
    assert [r["ds"].isoformat() for r in ahead] == ["2015-01-01", "2015-01-02", "2015-01-03"]
    weeks = rows(S.future_calendar(df, horizon=2, step_days=7), "ds")
    assert [r["ds"].isoformat() for r in weeks] == ["2015-01-07", "2015-01-14"]
    history, future = S.split_future(df, day("2014-12-30"))
    assert (history.count(), future.count()) == (1, 1)
    assert S.between_days(df, "2014-12-30", "2014-12-30").count() == 1


def test_closed_form_recovers_a_line(spark, rows):
    start = dt.date(2014, 1, 6)
    pairs = [((start + dt.timedelta(days=i)).isoformat(), 10 + 2 * i) for i in range(20)]
    got = rows(FC.seasonal_trend_forecast(daily(spark, pairs), horizon=3), "ds")
    assert len(got) == 23 and [r["is_future"] for r in got] == [False] * 20 + [True] * 3
    assert [round(r["yhat"], 2) for r in got] == [10 + 2 * i for i in range(23)]
    assert all(abs(r["yhat_upper"] - r["yhat_lower"]) < 0.05 for r in got)


def test_closed_form_against_numpy(spark, rows):
    df = seasonal(spark, ("a",), years=2)
    got = rows(FC.seasonal_trend_forecast(df.select("ds", "y"), horizon=10), "ds")
    data = sorted((r["ds"], r["y"]) for r in rows(df))
    dates = [r["ds"] for r in got]
    y = np.array([v for _, v in data])
    t = np.arange(len(dates))
    b, a = np.polyfit(t[:len(y)], y, 1)
    resid = y - (a + b * t[:len(y)])
    months, weekdays = np.array([d.month for d in dates]), np.array([d.weekday() for d in dates])
    me = {m: resid[months[:len(y)] == m].mean() for m in set(months)}
    resid = resid - np.array([me[m] for m in months[:len(y)]])
    we = {w: resid[weekdays[:len(y)] == w].mean() for w in set(weekdays)}
    resid = resid - np.array([we[w] for w in weekdays[:len(y)]])
    want = a + b * t + np.array([me[m] + we[w] for m, w in zip(months, weekdays)])
    np.testing.assert_allclose([r["yhat"] for r in got], want, rtol=0, atol=0.05)
    half = 1.96 * resid.std(ddof=1)
    np.testing.assert_allclose([r["yhat_upper"] - r["yhat"] for r in got], half, rtol=1e-3)


def test_one_day_series(spark, rows):
    got = rows(FC.seasonal_trend_forecast(daily(spark, [("2014-01-01", 5)]), horizon=2), "ds")
    assert [r["yhat"] for r in got] == [5.0, 5.0, 5.0]
    assert len(rows(FC.additive_forecast(daily(spark, [("2014-01-01", 5)]), horizon=2))) == 3


def test_keyed_closed_form_uses_one_shuffle(spark):
    df = seasonal(spark).repartition(3)
    plan = FC.seasonal_trend_forecast(df, ("k",))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(k") == 1


@pytest.mark.parametrize("method", ["closed_form", "additive"])
def test_backtest_beats_the_flat_mean(spark, rows, method):
    weekly = S.weekly_sales(seasonal(spark), ("k",))
    weeks = B.backtest(weekly, 2014, ("k",), method)
    for row in A.forecast_accuracy(weeks, ("k",)).collect():
        assert row.n_weeks == 52
        assert row.mape < 20 and 80 <= row.coverage <= 100
    flat = S.between_days(weekly, "2011-01-03", "2013-12-31").groupBy("k").agg(F.avg("y").alias("m"))
    errors = weeks.join(flat, "k").agg(
        F.avg(F.abs(F.col("actual") - F.col("yhat"))).alias("model"),
        F.avg(F.abs(F.col("actual") - F.col("m"))).alias("flat")).first()
    assert errors.model < errors.flat / 2


def test_additive_daily_shape(spark, rows):
    got = rows(FC.additive_forecast(seasonal(spark, ("a", "b"), years=1), ("k",), horizon=30), "k", "ds")
    assert len(got) == 2 * (366 + 30)
    weekend = [r["yhat"] for r in got if r["k"] == "a" and r["is_future"] and r["ds"].weekday() == 6]
    midweek = [r["yhat"] for r in got if r["k"] == "a" and r["is_future"] and r["ds"].weekday() == 2]
    assert np.mean(weekend) > np.mean(midweek) + 40


def test_accuracy_by_hand(spark):
    df = spark.createDataFrame(
        [(10.0, 12.0, 8.0, 12.0), (0.0, 3.0, 1.0, 5.0), (4.0, 4.0, 4.0, 4.0)],
        "actual double, yhat double, yhat_lower double, yhat_upper double")
    row = A.forecast_accuracy(df).first()
    assert (row.n_weeks, row.mae) == (3, pytest.approx(5 / 3))
    assert row.rmse == pytest.approx(((4 + 9 + 0) / 3) ** 0.5)
    assert row.mape == pytest.approx(10.0) and row.coverage == pytest.approx(200 / 3)


def test_campaign_weeks_and_the_two_week_rule(spark, rows):
    weeks = [(dt.date(2014, 1, 5) + dt.timedelta(days=7 * i)) for i in range(52)]
    df = spark.createDataFrame([(w, 1.0, 1.0, 0.0, 2.0) for w in weeks],
                               "ds date, actual double, yhat double, yhat_lower double, yhat_upper double")
    got = rows(A.campaign_accuracy(df, C.campaigns(spark), 2014), "campaign")
    assert [(r["campaign"], r["n_weeks"]) for r in got] == [
        ("Christmas", 4), ("Halloween", 3), ("Valentine's Day", 3)]


def test_last_full_year(spark):
    for last, year in [("2014-12-31", 2014), ("2014-12-30", 2013), ("2015-06-01", 2014)]:
        df = daily(spark, [("2011-01-01", 1), (last, 1)])
        assert df.select(B.last_full_year(df)).first()[0] == year


def test_profile(spark):
    sales = spark.createDataFrame(
        [(day("2014-01-05"), "a", "n", "c", "FR", 1.0), (day("2014-01-06"), "a", "n", "c", None, 1.0),
         (day("2014-01-06"), "b", "n", "c", "DE", 1.0)],
        "order_date date, sku string, name string, category string, country string, sales double")
    row = S.dataset_profile(sales).first()
    assert (row.n_rows, row.n_days, row.n_weeks, row.n_countries, row.n_skus) == (3, 2, 2, 2, 2)
