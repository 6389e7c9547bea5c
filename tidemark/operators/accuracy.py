"""Forecast accuracy, overall and per campaign window."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exact import exact_mean, exact_rms
from tidemark.functions.scalars import as_col
from tidemark.operators.campaigns import in_holiday_window, per_campaign


def join_actuals(forecast: DataFrame, actuals: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Forecast rows that have an observed value, with it as ``actual``."""
    return forecast.join(
        actuals.select(*keys, "ds", F.col("y").alias("actual")), [*keys, "ds"]
    )


def forecast_accuracy(merged: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """MAE, RMSE, MAPE (over non-zero actuals) and interval coverage in percent."""
    c = F.col
    error = c("actual") - c("yhat")
    share = F.when(c("actual") != 0, F.abs(error / F.nullif("actual", F.lit(0.0))))
    inside = c("actual").between(c("yhat_lower"), c("yhat_upper"))
    return merged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_weeks"),
        exact_mean(F.abs(error)).alias("mae"),
        exact_rms(error).alias("rmse"),
        (exact_mean(share, 9) * F.lit(100.0)).alias("mape"),
        (F.count_if(inside) / F.count(F.lit(1)) * F.lit(100.0)).alias("coverage"),
    )


def campaign_accuracy(merged: DataFrame, config: DataFrame, year) -> DataFrame:
    """Accuracy over the weeks that touch a campaign's window in ``year``; campaigns with
    fewer than two such weeks are left out."""
    # A week is dated by its last day, so it overlaps the window up to six days further out.
    hit = in_holiday_window("ds", "years", F.col("window") + 6, 1 + 6)
    weeks = per_campaign(merged, config).withColumn("years", F.array(as_col(year))).where(hit)
    return forecast_accuracy(weeks, ("campaign",)).where("n_weeks >= 2")
