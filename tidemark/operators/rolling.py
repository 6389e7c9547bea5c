"""Backtests over many origins from one pass over each series.

The model of an origin is a line plus the mean residual of each calendar month, fitted to all rows up
to that origin. Both follow from sums over the rows so far, so running sums (the normal equations as
prefix sums, and their parts by month) give every origin's fit in one window over the series. Nothing
is fitted again, and an origin costs as much as a row.

Amounts are whole cents and times whole days, so the sums are exact and no result depends on the order
of the rows or on their layout.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.exact import exact_mean, exact_rms, whole

CENTS = 100.0
MONTHS = range(1, 13)
_ONE = "_series"


def _running(value: Column, over) -> Column:
    return F.sum(value.cast("decimal(38,0)")).over(over).cast("double")


def origins(series: DataFrame, keys: tuple[str, ...] = (), least: int = 104) -> DataFrame:
    """One row per origin: ``(keys, ds, n, first, level, slope, effects)``.

    ``series`` has one row per date; an origin needs ``least`` rows up to it. ``level`` and ``slope``
    are in cents and days since ``first``; ``effects`` holds the twelve months' means, null for months
    not seen. A value that is missing or not finite is left out of the sums, and its date is no origin.
    """
    c = F.col
    names = list(keys) or [_ONE]
    source = series if keys else series.withColumn(_ONE, F.lit(0))
    every = W.partitionBy(*names)
    so_far = every.orderBy("ds").rowsBetween(W.unboundedPreceding, 0)
    rows = source.select(*names, "ds", whole(c("y") * CENTS + 0.5).alias("u")).where("u is not null")
    rows = rows.withColumn("first", F.min("ds").over(every))
    rows = rows.withColumns({"t": F.datediff("ds", "first").cast("bigint"), "month": F.month("ds")})
    u, t = c("u").cast("decimal(28,0)"), c("t").cast("decimal(9,0)")
    sums = {
        "n": F.count(F.lit(1)).over(so_far).cast("double"), "st": _running(t, so_far), "stt": _running(t * t, so_far),
        "su": _running(u, so_far), "stu": _running(t * u, so_far),
    }
    for m in MONTHS:
        own = c("month") == m
        sums |= {
            f"n{m}": F.count_if(own).over(so_far).cast("double"), f"st{m}": _running(F.when(own, t), so_far),
            f"su{m}": _running(F.when(own, u), so_far),
        }
    rows = rows.select(*names, "ds", "first", *[value.alias(name) for name, value in sums.items()]).where(c("n") >= least)
    spread = c("n") * c("stt") - c("st") * c("st")
    slope = F.coalesce((c("n") * c("stu") - c("st") * c("su")) / F.nullif(spread, F.lit(0.0)), F.lit(0.0))
    rows = rows.withColumn("slope", slope).withColumn("level", (c("su") - c("slope") * c("st")) / c("n"))
    effects = [
        (c(f"su{m}") - c("level") * c(f"n{m}") - c("slope") * c(f"st{m}")) / F.nullif(f"n{m}", F.lit(0.0)) for m in MONTHS
    ]
    return rows.select(*keys, "ds", c("n").cast("bigint").alias("n"), "first", "level", "slope", F.array(*effects).alias("effects"))


def rolling_forecasts(fits: DataFrame, horizons: Sequence[int], step_days: int = 7) -> DataFrame:
    """``(keys, origin, horizon, ds, yhat)``: each origin's forecasts so many steps ahead."""
    c = F.col
    keys = [k for k in fits.columns if k not in ("ds", "n", "first", "level", "slope", "effects")]
    ahead = fits.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons]))).withColumnRenamed("ds", "origin")
    ahead = ahead.withColumn("ds", F.date_add("origin", c("horizon") * F.lit(step_days)))
    effect = F.coalesce(F.element_at("effects", F.month("ds")), F.lit(0.0))
    yhat = (c("level") + c("slope") * F.datediff("ds", "first").cast("double") + effect) / CENTS
    return ahead.select(*keys, "origin", "horizon", "ds", yhat.alias("yhat"))


def rolling_accuracy(forecasts: DataFrame, actuals: DataFrame, keys: tuple[str, ...] = (),
                     by: tuple[str, ...] = ("origin", "horizon")) -> DataFrame:
    """MAE, RMSE and MAPE (over non-zero actuals, in percent) per origin and horizon, over all series."""
    c = F.col
    both = forecasts.join(actuals.select(*keys, "ds", c("y").alias("actual")), [*keys, "ds"])
    error = c("actual") - c("yhat")
    share = F.when(c("actual") != 0, F.abs(error / F.nullif("actual", F.lit(0.0))))
    return both.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_series"), exact_mean(F.abs(error)).alias("mae"), exact_rms(error).alias("rmse"),
        (exact_mean(share, 9) * F.lit(100.0)).alias("mape"),
    )
