"""Forecast backtest: train on three years of weeks, test on the next."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import as_col
from tidemark.operators.accuracy import join_actuals
from tidemark.operators.forecast import additive_forecast, seasonal_trend_forecast
from tidemark.operators.series import between_days

TRAIN_YEARS = 3
WEEKS_AHEAD = 52


def last_full_year(daily: DataFrame) -> Column:
    """The last calendar year the series covers to its end, as a scalar subquery."""
    return daily.agg(F.year(F.date_add(F.max("ds"), 1)) - 1).scalar()


def year_range(first, last) -> tuple[Column, Column]:
    return F.make_date(as_col(first), F.lit(1), F.lit(1)), F.make_date(as_col(last), F.lit(12), F.lit(31))


def backtest(weekly: DataFrame, test_year, keys: tuple[str, ...] = (),
             method: str = "closed_form") -> DataFrame:
    """Test weeks with forecast, bounds and the actual value."""
    year = as_col(test_year)
    train = between_days(weekly, *year_range(year - TRAIN_YEARS, year - 1))
    test = between_days(weekly, *year_range(year, year))
    if method == "closed_form":
        forecast = seasonal_trend_forecast(train, keys, WEEKS_AHEAD, 7, weekday=False)
    elif method in ("additive", "sparse"):
        trend = "sparse" if method == "sparse" else "ridge"
        forecast = additive_forecast(train, keys, WEEKS_AHEAD, 7, weekly=False, trend=trend)
    else:
        raise ValueError(f"unknown method {method}")
    ahead = between_days(forecast, *year_range(year, year))
    return join_actuals(ahead, test, keys)
