"""Daily and weekly series, calendars and splits."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exact import exact_sum
from tidemark.functions.scalars import as_col


def daily_sales(sales: DataFrame, keys: tuple[str, ...] = (), value="sales") -> DataFrame:
    """Total sales per day, ``(keys, ds, y)``; works on raw sales and on SKU-day rows."""
    return sales.groupBy(*keys, F.to_date("order_date").alias("ds")).agg(
        exact_sum(value).alias("y")
    )


def week_end(date="ds"):
    """The Sunday that closes the date's week; a Sunday closes its own."""
    return F.next_day(F.date_sub(as_col(date), 1), "SUN")


def weekly_sales(daily: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Weekly totals, weeks ending on Sunday; weeks without sales count 0."""
    weeks = daily.groupBy(*keys, week_end().alias("ds")).agg(exact_sum("y").alias("y"))
    span = weeks.groupBy(*keys).agg(F.min("ds").alias("lo"), F.max("ds").alias("hi"))
    calendar = span.select(
        *keys, F.explode(F.sequence("lo", "hi", F.expr("interval 7 days"))).alias("ds")
    )
    return calendar.join(weeks, [*keys, "ds"], "left").select(
        *keys, "ds", F.coalesce("y", F.lit(0.0)).alias("y")
    )


def future_calendar(series: DataFrame, keys: tuple[str, ...] = (), horizon: int = 365,
                    step_days: int = 1) -> DataFrame:
    """The dates after each series' last one: ``horizon`` steps."""
    last = series.groupBy(*keys).agg(F.max("ds").alias("last"))
    step = F.expr(f"interval {step_days} days")
    return last.where("last is not null").select(
        *keys,
        F.explode(F.sequence(
            F.date_add("last", step_days), F.date_add("last", step_days * horizon), step
        )).alias("ds"),
    )


def last_day(daily: DataFrame):
    return daily.agg(F.max("ds")).scalar()


def split_future(forecast: DataFrame, last_date) -> tuple[DataFrame, DataFrame]:
    """``(history, future)`` at the last observed day."""
    after = F.col("ds") > as_col(last_date)
    return forecast.where(~after), forecast.where(after)


def between_days(series: DataFrame, start, end) -> DataFrame:
    """Rows whose day lies in the closed range."""
    def bound(value):
        return F.lit(value).cast("date") if isinstance(value, str) else value

    return series.where(F.col("ds").between(bound(start), bound(end)))


def dataset_profile(sales: DataFrame) -> DataFrame:
    """Row count, date range, number of days, weeks, SKUs and countries.

    Distinct values are reduced per combination first; each count then sees few rows.
    """
    cells = sales.groupBy("order_date", "country").agg(F.count(F.lit(1)).alias("n"))
    skus = sales.select("sku").distinct().agg(F.count(F.lit(1))).scalar()
    return cells.agg(
        F.sum("n").alias("n_rows"),
        F.min("order_date").alias("first_date"),
        F.max("order_date").alias("last_date"),
        F.count_distinct("order_date").alias("n_days"),
        F.count_distinct(week_end("order_date")).alias("n_weeks"),
        F.count_distinct("country").alias("n_countries"),
    ).withColumn("n_skus", skus)
