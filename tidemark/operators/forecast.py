"""Forecasts: a closed-form seasonal trend and a fitted additive model."""

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.exact import whole

Z95 = 1.96
CENTS = 100.0
_ONE = "_series"


def _with_future(series: DataFrame, names, horizon, step_days) -> DataFrame:
    """The series followed by its future dates without values.

    The last row of a series unfolds into itself and the dates after it, so the series is
    read once and stays clustered by its keys.
    """
    last = F.max("ds").over(W.partitionBy(*names))
    step = F.expr(f"interval {step_days} days")
    dates = F.when(
        F.col("ds") == F.col("last"),
        F.sequence("ds", F.date_add("ds", step_days * horizon), step),
    ).otherwise(F.array("ds"))
    return (
        series.select(*names, "ds", "y")
        .withColumn("last", last)
        .select(*names, F.col("ds").alias("from"), "y", F.explode(dates).alias("ds"))
        .select(
            *names, "ds", (F.col("ds") > F.col("from")).alias("is_future"),
            F.when(F.col("ds") == F.col("from"), F.col("y")).alias("y"),
        )
    )


def seasonal_trend_forecast(series: DataFrame, keys: tuple[str, ...] = (), horizon: int = 365,
                            step_days: int = 1, weekday: bool = True) -> DataFrame:
    """Linear trend plus month effect plus weekday effect, in closed form.

    Effects are mean residuals, taken one after the other; the interval is 1.96 sample
    standard deviations of the last residual. One shuffle on the keys: every window below
    is clustered within it. A task holds whole series, and a series has one row per date.
    Residuals are kept in whole cents, so sums do not depend on row order.
    """
    c = F.col
    names = list(keys) or [_ONE]
    one = W.partitionBy(*names)
    source = series if keys else series.withColumn(_ONE, F.lit(0))
    rows = _with_future(source, names, horizon, step_days)
    seen = c("y").isNotNull()
    rows = rows.withColumn("whole", whole(c("y") * CENTS + 0.5)).withColumn(
        "u", c("whole").cast("double")
    ).withColumn(
        "t", F.datediff("ds", F.min(F.when(seen, c("ds"))).over(one)).cast("double")
    )
    t = F.when(seen, c("t"))

    def total(value):
        return F.sum(value).over(one)

    rows = rows.withColumns({
        "n": F.count("y").over(one).cast("double"),
        "st": total(t), "stt": total(t * t), "su": total(c("whole").cast("decimal(28,0)")).cast("double"),
        # Wider than a double's 53 bits from some hundred million lines on.
        "stu": total((t.cast("decimal(9,0)") * c("whole").cast("decimal(28,0)")).cast("decimal(38,0)")).cast("double"),
    })
    spread = c("n") * c("stt") - c("st") * c("st")
    slope = (c("n") * c("stu") - c("st") * c("su")) / F.nullif(spread, F.lit(0.0))
    rows = rows.withColumn("b", F.coalesce(slope, F.lit(0.0))).withColumn("a", (c("su") - c("b") * c("st")) / c("n"))
    rows = rows.withColumn("trend", c("a") + c("b") * c("t")).withColumn(
        "r1", F.floor(c("u") - c("trend") + 0.5)
    )

    def effect(residual, *parts):
        w = W.partitionBy(*names, *parts)
        return F.coalesce(F.sum(residual).over(w) / F.count(residual).over(w), F.lit(0.0))

    rows = rows.withColumn("month_effect", effect("r1", F.month("ds"))).withColumn(
        "r2", F.floor(c("r1") - c("month_effect") + 0.5)
    )
    rows = rows.withColumn(
        "day_effect", effect("r2", F.weekday("ds")) if weekday else F.lit(0.0)
    ).withColumn("r3", F.floor(c("r2") - c("day_effect") + 0.5))
    residual = c("r3").cast("decimal(19,0)")
    rows = rows.withColumns({
        "ss": total((residual * residual).cast("decimal(38,0)")).cast("double"),
        "s": total(c("r3")).cast("double"),
    })
    variance = (c("ss") - c("s") * c("s") / c("n")) / F.nullif(c("n") - 1.0, F.lit(0.0))
    rows = rows.withColumn("half", F.lit(Z95) * F.sqrt(F.greatest(variance, F.lit(0.0))) / CENTS)
    yhat = (c("trend") + c("month_effect") + c("day_effect")) / CENTS
    return rows.withColumn("yhat", yhat).select(
        *keys, "ds", "yhat",
        (c("yhat") - c("half")).alias("yhat_lower"),
        (c("yhat") + c("half")).alias("yhat_upper"),
        "is_future",
    )


# Additive model.
CHANGEPOINTS = 25
CHANGEPOINT_RANGE = 0.8
CHANGEPOINT_SCALE = 0.05
SEASON_SCALE = 10.0
YEARLY_ORDER = 10
WEEKLY_ORDER = 3


def _waves(days: np.ndarray, period: float, order: int) -> np.ndarray:
    angles = 2 * np.pi * np.outer(days / period, np.arange(1, order + 1))
    return np.hstack([np.sin(angles), np.cos(angles)])


def fit_additive(days: np.ndarray, y: np.ndarray, future: np.ndarray, weekly: bool):
    """Ridge fit of trend with changepoints plus Fourier seasons; ``(yhat, half width)``.

    ``days`` are day numbers of the observed ``y``; the result covers ``days`` then
    ``future``. The ridge weights follow from normal priors on slope changes (tight) and
    on season weights (loose) with the residual variance of a fit without changepoints.
    """
    start, span = days.min(), max(days.max() - days.min(), 1)
    scale = np.abs(y).max() or 1.0
    n_points = min(CHANGEPOINTS, max(int(len(days) * CHANGEPOINT_RANGE) - 1, 0))
    picks = np.linspace(0, int(len(days) * CHANGEPOINT_RANGE) - 1, n_points + 1).round().astype(int)
    breaks = (days[picks[1:]] - start) / span if n_points else np.empty(0)

    def design(d):
        t = (d - start) / span
        seasons = [_waves(d, 365.25, YEARLY_ORDER)]
        if weekly:
            seasons.append(_waves(d, 7.0, WEEKLY_ORDER))
        return np.column_stack([np.ones_like(t), t]), np.hstack(seasons), np.maximum(
            t[:, None] - breaks[None, :], 0.0)

    def solve(x, penalty):
        return np.linalg.solve(x.T @ x + np.diag(penalty), x.T @ (y / scale))

    line, seasons, bends = design(days.astype(float))
    plain = np.hstack([line, seasons])
    tiny = np.full(plain.shape[1], 1e-6)
    noise = np.mean((y / scale - plain @ solve(plain, tiny)) ** 2) + 1e-9
    penalty = np.concatenate([
        np.full(2, 1e-6),
        np.full(seasons.shape[1], noise / SEASON_SCALE**2 + 1e-6),
        np.full(len(breaks), noise / CHANGEPOINT_SCALE**2),
    ])
    full = np.hstack([plain, bends])
    weights = solve(full, penalty)
    half = Z95 * np.std(y - scale * (full @ weights), ddof=1) if len(y) > 1 else 0.0
    ahead = np.hstack(design(np.concatenate([days, future]).astype(float)))
    return scale * (ahead @ weights), half


# Sparse trend.
PATHS = 400
SWEEPS = 200
ROUNDS = 12
#: Noise of a series that a fit hits exactly.
TINY = 1e-12
#: The sparse trend may change until the last twentieth of the series.
SPARSE_RANGE = 0.95


def _shrink(gram: np.ndarray, target: np.ndarray, threshold: float, start: np.ndarray) -> np.ndarray:
    """Coordinate descent for least squares with an absolute penalty on each weight."""
    weights, gradient = start.copy(), target - gram @ start
    for _ in range(SWEEPS):
        largest = 0.0
        for j in range(len(weights)):
            if gram[j, j] <= 1e-12:
                continue
            own = gradient[j] + gram[j, j] * weights[j]
            new = np.sign(own) * max(abs(own) - threshold, 0.0) / gram[j, j]
            step = new - weights[j]
            if step:
                gradient -= step * gram[:, j]
                weights[j] = new
                largest = max(largest, abs(step))
        if largest < 1e-9:
            break
    return weights


def fit_sparse(days: np.ndarray, y: np.ndarray, future: np.ndarray, weekly: bool, seed: int):
    """Trend with few changes plus Fourier seasons; ``(yhat, lower, upper)`` over ``days`` then ``future``.

    Slope changes have a double-exponential prior, so most of them are exactly zero. Level, slope and
    seasons are projected out, which leaves the changes alone to the coordinate descent; the noise and
    the changes are found in turn. The interval holds the noise and, ahead, trends that go on changing:
    ``PATHS`` futures draw changes as often, and as large, as the fitted ones were, with a generator of
    the given seed.
    """
    start, span = days.min(), max(np.ptp(days), 1)
    scale = np.abs(y).max() or 1.0
    n_points = min(CHANGEPOINTS, max(int(len(days) * SPARSE_RANGE) - 1, 0))
    picks = np.linspace(0, int(len(days) * SPARSE_RANGE) - 1, n_points + 1).round().astype(int)
    breaks = (days[picks[1:]] - start) / span if n_points else np.empty(0)

    def smooth(d):
        t = (d - start) / span
        parts = [np.column_stack([np.ones_like(t), t])]
        if span >= 365:
            parts.append(_waves(d, 365.25, YEARLY_ORDER if len(days) > 4 * YEARLY_ORDER else 2))
        if weekly:
            parts.append(_waves(d, 7.0, WEEKLY_ORDER))
        return t, np.hstack(parts)

    t, base = smooth(days.astype(float))
    bends = np.maximum(t[:, None] - breaks[None, :], 0.0)
    values = y / scale
    loose = np.concatenate([np.full(2, 1e-8), np.full(base.shape[1] - 2, 1e-4)])
    solved = np.linalg.solve(base.T @ base + np.diag(loose), base.T @ np.column_stack([values, bends]))
    rest, rest_bends = values - base @ solved[:, 0], bends - base @ solved[:, 1:]
    gram, target = rest_bends.T @ rest_bends, rest_bends.T @ rest
    changes = np.zeros(len(breaks))
    free = max(len(y) - base.shape[1], 1)
    noise, size = max(float(rest @ rest) / free, TINY), CHANGEPOINT_SCALE
    for _ in range(ROUNDS):
        changes = _shrink(gram, target, noise / size, changes)
        left = rest - rest_bends @ changes
        before, noise = noise, max(float(left @ left) / max(free - int((changes != 0).sum()), 1), TINY)
        size = max(CHANGEPOINT_SCALE, float(np.abs(changes).mean()) if len(changes) else 0.0)
        if abs(before - noise) <= 1e-6 * noise:
            break
    # The changes found are fitted again without the penalty, which had shrunk them.
    found = np.flatnonzero(changes)
    design = np.hstack([base, bends[:, found]])
    loose = np.concatenate([loose, np.full(len(found), noise / max(size, CHANGEPOINT_SCALE) ** 2)])
    spread = np.linalg.inv(design.T @ design + np.diag(loose))
    weights = spread @ (design.T @ values)
    # Neighbours of one sign are one change that lies between the places tried.
    signed = weights[base.shape[1]:]
    apart = np.flatnonzero((np.diff(found, prepend=-2) > 1) | (np.diff(np.sign(signed), prepend=0) != 0))
    sizes = np.abs(np.add.reduceat(signed, apart)) if len(signed) else signed
    noise = max(float(((values - design @ weights) ** 2).sum()) / max(free - len(found), 1), TINY)
    ahead = np.concatenate([days, future]).astype(float)
    t_all, base_all = smooth(ahead)
    design_all = np.hstack([base_all, np.maximum(t_all[:, None] - breaks[None, found], 0.0)])
    yhat = design_all @ weights

    rng = np.random.default_rng(seed)
    off = rng.normal(0.0, np.sqrt(noise), (PATHS, len(t_all)))
    t_new = t_all[len(days):]
    # Doubt of the line and of all possible changes, those not found too: their prior variance is that of
    # the ones found, and half the usual one besides.
    every = np.hstack([base, bends])
    variance = (float((sizes**2).sum()) + CHANGEPOINT_SCALE**2) / max(len(breaks), 1)
    prior = np.concatenate([loose[:base.shape[1]], np.full(len(breaks), noise / variance)])
    root = np.linalg.cholesky(every.T @ every + np.diag(prior))
    draws = np.sqrt(noise) * np.linalg.solve(root.T, rng.standard_normal((len(prior), PATHS))).T
    every_new = np.hstack([base_all[len(days):], np.maximum(t_new[:, None] - breaks[None, :], 0.0)])
    off[:, len(days):] += draws @ every_new.T
    if len(t_new) and len(breaks):
        # A path's rate and mean size of changes are drawn as the number and sizes of those found allow,
        # with one usual change more; changes begin where none was sought any more.
        last = breaks[-1]
        rates = rng.gamma(len(sizes) + 1.0, 1.0 / last, PATHS)
        means = (sizes.sum() + CHANGEPOINT_SCALE) / rng.gamma(len(sizes) + 1.0, 1.0, PATHS)
        number = rng.poisson(rates * (t_new[-1] - last))
        for i in range(PATHS):
            at = last + (t_new[-1] - last) * rng.random(number[i])
            off[i, len(days):] += np.maximum(t_new[:, None] - at[None, :], 0.0) @ rng.laplace(0.0, means[i], number[i])
    low, high = np.quantile(off, [0.025, 0.975], axis=0)
    return scale * yhat, scale * (yhat + low), scale * (yhat + high)


def additive_forecast(series: DataFrame, keys: tuple[str, ...] = (), horizon: int = 365,
                      step_days: int = 1, weekly: bool | None = None, trend: str = "ridge",
                      seed: int = 0) -> DataFrame:
    """History and ``horizon`` steps ahead from one additive fit per key.

    Spark groups and spreads the series; a task fits one series of at most one row per
    date. ``weekly`` None switches the weekly season on for daily series of two weeks.
    ``trend`` "ridge" bends a little everywhere and has an interval of one width; "sparse" changes
    in few places, and its interval widens with trend changes drawn by ``seed`` and the key, so that
    a series gets the same one wherever it is fitted.
    """
    if trend not in ("ridge", "sparse"):
        raise ValueError(f"unknown trend {trend}")
    names = list(keys) or [_ONE]
    source = series if keys else series.withColumn(_ONE, F.lit(0))
    source = source.where("y is not null").select(*names, "ds", "y")
    schema = T.StructType(
        [source.schema[k] for k in names]
        + [T.StructField("ds", T.DateType())]
        + [T.StructField(x, T.DoubleType()) for x in ("yhat", "yhat_lower", "yhat_upper")]
        + [T.StructField("is_future", T.BooleanType())]
    )

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ds")
        dates = pd.to_datetime(pdf["ds"])
        days = ((dates - pd.Timestamp("1970-01-01")) // pd.Timedelta(days=1)).to_numpy()
        future = days.max() + step_days * np.arange(1, horizon + 1)
        use_weekly = weekly if weekly is not None else step_days < 7 and np.ptp(days) >= 14
        y = pdf["y"].to_numpy(float)
        if trend == "sparse":
            own = "\x1f".join(str(pdf[k].iloc[0]) for k in names)
            yhat, lower, upper = fit_sparse(days, y, future, use_weekly, zlib.crc32(f"{seed}\x1f{own}".encode()))
        else:
            yhat, half = fit_additive(days, y, future, use_weekly)
            lower, upper = yhat - half, yhat + half
        out = pd.DataFrame({k: [pdf[k].iloc[0]] * len(yhat) for k in names})
        out["ds"] = pd.to_datetime(np.concatenate([days, future]), unit="D").date
        return out.assign(
            yhat=yhat, yhat_lower=lower, yhat_upper=upper,
            is_future=np.arange(len(yhat)) >= len(days),
        )

    result = source.groupBy(*names).applyInPandas(fit, schema)
    return result if keys else result.drop(_ONE)


def campaign_forecast_table(daily: DataFrame, forecast: DataFrame, plan: DataFrame) -> DataFrame:
    """Observed and forecast sales with bounds for the days around each campaign's peak."""
    days = plan.where("peak_date is not null").select(
        "campaign", F.explode(F.sequence(F.date_sub("peak_date", 3), F.date_add("peak_date", 3))).alias("ds")
    )
    both = daily.select("ds", F.col("y").alias("historical_gmv")).join(
        forecast.select(
            "ds", F.col("yhat").alias("forecasted_gmv"),
            F.col("yhat_upper").alias("upper_bound"), F.col("yhat_lower").alias("lower_bound"),
        ), "ds", "full",
    )
    return days.join(both, "ds").select(
        "campaign", F.col("ds").alias("date"), "historical_gmv", "forecasted_gmv",
        "upper_bound", "lower_bound",
    )
