"""Backtests over many origins, and forecasts with a sparse trend."""

import datetime as dt
import math
import random

import numpy as np
import pytest

from tidemark.operators import forecast, rolling

START = dt.date(2018, 1, 7)


def refit(rows, at, horizon):
    """Line and month means of the rows up to `at`, by plain sums."""
    seen = [(d, math.floor(y * 100 + 0.5)) for d, y in rows if d <= at and y is not None and math.isfinite(y)]
    first = min(d for d, y in rows if y is not None and math.isfinite(y))
    t = [(d - first).days for d, _ in seen]
    u = [v for _, v in seen]
    n = len(seen)
    spread = n * sum(x * x for x in t) - sum(t) ** 2
    slope = (n * sum(x * v for x, v in zip(t, u)) - sum(t) * sum(u)) / spread if spread else 0.0
    level = (sum(u) - slope * sum(t)) / n
    target = at + dt.timedelta(days=7 * horizon)
    left = [v - level - slope * x for x, (d, v) in zip(t, seen) if d.month == target.month]
    effect = sum(left) / len(left) if left else 0.0
    return (level + slope * (target - first).days + effect) / 100


def made(seed, weeks=130):
    rng = random.Random(seed)
    rows = []
    for key, scale in (("a", 1.0), ("b", 1e6), ("c", 0.0)):
        for i in range(weeks):
            y = round(scale * (50 + i + 20 * math.sin(i / 8) + rng.random() * 9), 2)
            if key == "a" and i % 17 == 3:
                y = rng.choice([None, float("nan"), float("inf")])
            if not (key == "b" and i % 11 == 5):
                rows.append((key, START + dt.timedelta(days=7 * i), y))
    return rows


def test_every_origin_equals_a_fit_of_its_own(spark):
    rows = made(1)
    frame = spark.createDataFrame(rows, "k string, ds date, y double").repartition(5)
    fits = rolling.origins(frame, ("k",), least=20)
    got = rolling.rolling_forecasts(fits, (1, 9, 52)).collect()
    for r in got:
        own = [(d, y) for k, d, y in rows if k == r["k"]]
        assert r["ds"] == r["origin"] + dt.timedelta(days=7 * r["horizon"])
        assert r["yhat"] == pytest.approx(refit(own, r["origin"], r["horizon"]), rel=1e-9, abs=1e-6)
    counted = {k: sum(1 for key, _, y in rows if key == k and y is not None and math.isfinite(y)) - 19 for k in "abc"}
    assert len(got) == 3 * sum(counted.values())


def test_accuracy_of_origins_and_of_horizons(spark):
    rows = [r for r in made(2) if r[0] == "b"]
    frame = spark.createDataFrame(rows, "k string, ds date, y double").select("ds", "y")
    ahead = rolling.rolling_forecasts(rolling.origins(frame, least=60), (1, 4))
    own = [(d, y) for _, d, y in rows]
    actual = dict(own)
    by = {(r["origin"], r["horizon"]): r for r in rolling.rolling_accuracy(ahead, frame).collect()}
    assert by and all(r["n_series"] == 1 for r in by.values())
    for (origin, horizon), r in by.items():
        y = actual[origin + dt.timedelta(days=7 * horizon)]
        error = abs(y - refit(own, origin, horizon))
        assert r["mae"] == pytest.approx(error, abs=1e-3) and r["rmse"] == pytest.approx(error, abs=0.02)
        assert r["mape"] == pytest.approx(100 * error / y, rel=1e-4)
    whole = rolling.rolling_accuracy(ahead, frame, by=("horizon",)).collect()
    assert sum(r["n_series"] for r in whole) == len(by)


def test_odd_series(spark):
    empty = spark.createDataFrame([], "k string, ds date, y double")
    assert rolling.rolling_forecasts(rolling.origins(empty, ("k",)), (1,)).count() == 0
    one = spark.createDataFrame([("a", START, 5.0), ("b", START, None)], empty.schema)
    [row] = rolling.rolling_forecasts(rolling.origins(one, ("k",), least=1), (1,)).collect()
    assert (row["k"], row["yhat"]) == ("a", 5.0)


def broken(seed, every=26, weeks=208, ahead=52):
    """Weekly values whose slope is drawn anew every half year."""
    rng = np.random.default_rng(seed)
    days, slope, level, trend = 7 * np.arange(weeks + ahead), 0.0, 300.0, []
    shift = rng.integers(every)
    for i in range(weeks + ahead):
        if (i + shift) % every == 0:
            slope = rng.normal(0.0, 1.0)
        level += slope
        trend.append(level)
    y = np.array(trend) + 20 * np.sin(2 * np.pi * days / 365.25) + rng.normal(0, 3, weeks + ahead)
    return days, y, weeks


def test_intervals_hold_where_trends_break():
    sparse, ridge = [], []
    for seed in range(40):
        days, y, n = broken(seed)
        yhat, lower, upper = forecast.fit_sparse(days[:n], y[:n], days[n:], False, seed)
        assert (lower <= upper).all() and len(yhat) == len(days)
        sparse.append(((y >= lower) & (y <= upper))[n:].mean())
        yhat, half = forecast.fit_additive(days[:n], y[:n], days[n:], False)
        ridge.append((np.abs(y - yhat) <= half)[n:].mean())
    assert 0.90 <= np.mean(sparse) <= 0.97
    assert np.mean(ridge) < 0.5


def test_few_changes_are_found_where_they_are():
    days = 7 * np.arange(208)
    t = days / days.max()
    y = 100 + 40 * t + 200 * np.maximum(t - 0.5, 0) + np.random.default_rng(3).normal(0, 1, 208)
    yhat, lower, upper = forecast.fit_sparse(days, y, days[-1] + 7 * np.arange(1, 27), False, 1)
    slopes = np.diff(yhat[208:]) / 7 * days.max()
    assert slopes.mean() == pytest.approx(240, rel=0.1)
    width = (upper - lower)[208:]
    assert width[-5:].mean() > width[:5].mean()  # the future grows less sure
    assert ((y >= lower[:208]) & (y <= upper[:208])).mean() > 0.9


def test_sparse_forecasts_do_not_depend_on_partitions(spark):
    rows = []
    for key in "ab":
        days, y, n = broken(ord(key))
        rows += [(key, dt.date(1970, 1, 1) + dt.timedelta(days=int(d)), float(v)) for d, v in zip(days[:n], y[:n])]
    rows += [("one", START, 3.0), ("two", START, 1.0), ("two", START + dt.timedelta(days=7), None), ("flat", START, 0.0)]
    frame = spark.createDataFrame(rows, "k string, ds date, y double")
    fit = lambda df: sorted(map(tuple, forecast.additive_forecast(df, ("k",), 20, 7, False, "sparse", seed=5).collect()))
    one = fit(frame.coalesce(1))
    assert one == fit(frame.repartition(6)) and len(one) == 2 * 208 + 3 + 5 * 20
    assert {r[0] for r in one} == {"a", "b", "one", "two", "flat"}
    with pytest.raises(ValueError):
        forecast.additive_forecast(frame, ("k",), trend="none")
