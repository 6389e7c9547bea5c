"""Campaign configuration, holiday windows, lift, peak and the planned action."""

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.functions.exact import MONEY_SCALE, exact_mean, units, whole_sum
from tidemark.functions.scalars import as_col, clip

_CONFIG = pa.schema([
    ("position", pa.int32()), ("campaign", pa.string()), ("month", pa.int32()), ("day", pa.int32()), ("window", pa.int32()),
    ("default_lift", pa.float64()), ("baseline_units", pa.int64()),
    ("keywords", pa.list_(pa.string())),
])


def campaigns(spark: SparkSession, rows: list[dict] | None = None) -> DataFrame:
    """The campaign calendar as a local table, so the optimizer knows how small it is."""
    numbered = [{"position": i, **row} for i, row in enumerate(rows or fv.CAMPAIGNS, 1)]
    return spark.createDataFrame(pa.Table.from_pylist(numbered, _CONFIG))


def per_campaign(df: DataFrame, config: DataFrame) -> DataFrame:
    """Each row once per campaign, with the campaign's columns.

    Meant for calendars and daily totals: the number of rows is days x campaigns.
    """
    configs = config.agg(F.collect_list(F.struct(*config.columns))).scalar()
    return df.select("*", F.inline(configs))


def in_campaign_month(df: DataFrame, config: DataFrame, date="order_date") -> DataFrame:
    """Rows dated in a campaign's month, with the campaign's columns (equi-join on month).

    Rows that are already grouped by month bring a column ``month`` instead of a date. The
    month list is also a plain filter, which the optimizer moves below groupings and joins
    down to the scan that delivers the date.
    """
    months = config.agg(F.collect_set("month")).scalar()
    month = F.col("month") if "month" in df.columns else F.month(date)
    in_month = df.where(F.array_contains(months, month))
    return in_month.withColumn("month", month).join(config, "month")


def years_of(days: DataFrame, date="ds") -> Column:
    """The calendar years present in a series, as one array."""
    return days.agg(F.collect_set(F.year(date))).scalar()


def holiday_windows(daily: DataFrame, config: DataFrame) -> DataFrame:
    """Each campaign's holiday and lift window in every year of the series."""
    return (
        config.withColumn("year", F.explode(years_of(daily)))
        .withColumn("holiday", F.make_date("year", "month", "day"))
        .select(
            "campaign", "year", "holiday",
            F.date_sub("holiday", F.col("window")).alias("window_start"),
            F.date_add("holiday", fv.DAYS_AFTER_HOLIDAY).alias("window_end"),
        )
    )


def in_holiday_window(date, years, before, after=fv.DAYS_AFTER_HOLIDAY) -> Column:
    """True from ``before`` days ahead of a holiday to ``after`` days past it, in any year.

    The holiday comes from the columns ``month`` and ``day``; ``years`` is an array column.
    """
    day = as_col(date)

    def hit(year):
        holiday = F.make_date(year, F.col("month"), F.col("day"))
        return F.coalesce(
            day.between(F.date_sub(holiday, as_col(before)), F.date_add(holiday, as_col(after))),
            F.lit(False),
        )

    return F.exists(as_col(years), hit)


def holiday_days(daily: DataFrame, config: DataFrame) -> DataFrame:
    """Every day and campaign with its ``is_holiday`` flag (window days before, one after)."""
    dated = per_campaign(daily, config).withColumn("years", years_of(daily))
    flag = in_holiday_window("ds", "years", "window")
    return dated.withColumn("is_holiday", flag).drop("years")


def holiday_dates(daily: DataFrame, config: DataFrame) -> DataFrame:
    """``(campaign, month, ds)``: the dates of each campaign's windows, a few per campaign and year."""
    windows = holiday_windows(daily, config).join(config.select("campaign", "month"), "campaign")
    return windows.select(
        "campaign", "month", F.explode(F.sequence("window_start", "window_end")).alias("ds")
    ).distinct()


def _days(rows: Column, name: str) -> list[Column]:
    """Number of days, of days with an amount, and the exact total of the rows that hold."""
    own = F.when(rows, units("y"))
    return [F.count_if(rows).alias(f"{name}_days"), F.count(own).alias(f"{name}_n"), whole_sum(own).alias(f"{name}_sum")]


def _less(whole: str, part: str) -> tuple[Column, Column]:
    """Number and total of the days of ``whole`` that are not in ``part``."""
    return tuple(
        F.coalesce(f"{whole}_{x}", F.lit(0)) - F.coalesce(f"{part}_{x}", F.lit(0)) for x in ("n", "sum")
    )


def _mean(number: Column, total: Column) -> Column:
    return F.when(number > 0, total.cast("double") / F.lit(10.0**MONEY_SCALE) / number)


def observed_lift(daily: DataFrame, config: DataFrame) -> DataFrame:
    """Mean holiday day over mean comparable day, per campaign.

    Comparable: the campaign's month outside its windows, or, with fewer than five such
    days, every day outside. The configured lift stands in when either mean is missing.

    Days meet windows by an equi-join on the date; what lies outside is the whole less what
    lies inside, in exact sums. So no day is paired with every campaign.
    """
    c = F.col
    all_days = F.lit(True)
    inside = holiday_dates(daily, config).join(daily.select("ds", "y"), "ds").groupBy("campaign").agg(
        *_days(all_days, "holiday"), *_days(F.month("ds") == c("month"), "holiday_month")
    )
    months = daily.groupBy(F.month("ds").alias("month")).agg(*_days(all_days, "in_month"))
    whole = daily.agg(F.struct(*_days(all_days, "all"))).scalar()
    joined = (
        config.select("campaign", "month")
        .join(inside, "campaign", "left").join(months, "month", "left")
        .withColumn("whole", whole).select("*", "whole.*")
    )
    means = joined.select(
        "campaign",
        F.coalesce("holiday_days", F.lit(0)).alias("holiday_days"),
        (F.coalesce("in_month_days", F.lit(0)) - F.coalesce("holiday_month_days", F.lit(0))).alias("month_days"),
        _mean(c("holiday_n"), c("holiday_sum")).alias("holiday_mean"),
        _mean(*_less("in_month", "holiday_month")).alias("month_mean"),
        _mean(*_less("all", "holiday")).alias("outside_mean"),
    )
    too_few = c("month_days") < fv.MIN_BASELINE_DAYS
    baseline = F.when(too_few, c("outside_mean")).otherwise(c("month_mean"))
    ratio = F.when(c("baseline_mean") > 0, c("holiday_mean") / c("baseline_mean"))
    return (
        config.select("campaign", "default_lift")
        .join(means, "campaign", "left")
        .withColumn("baseline_mean", baseline)
        .withColumn(
            "observed_lift",
            F.when(ratio.isNotNull(), clip(ratio, *fv.OBSERVED_LIFT_RANGE))
            .otherwise(c("default_lift")),
        )
        .withColumn("planned_lift", planned_lift("observed_lift"))
        .select(
            "campaign",
            F.coalesce("holiday_days", F.lit(0)).alias("holiday_days"),
            F.coalesce("month_days", F.lit(0)).alias("baseline_days"),
            "observed_lift", "planned_lift",
        )
    )


def planned_lift(observed) -> Column:
    return clip(as_col(observed) * F.lit(fv.PLANNED_LIFT_FACTOR), *fv.PLANNED_LIFT_RANGE)


def campaign_peak(series: DataFrame, config: DataFrame, last_date=None) -> DataFrame:
    """Highest forecast day inside each campaign's month and day window.

    Days after ``last_date`` (without it: rows flagged ``is_future``) win over observed
    ones; the earliest day wins a tie. A campaign without such a day keeps a null date and
    volume 0.
    """
    c = F.col
    is_future = c("is_future") if last_date is None else c("ds") > as_col(last_date)
    near = c("day_of_month").between(c("day") - c("window"), c("day") + c("window"))
    best = (
        in_campaign_month(series.withColumn("day_of_month", F.dayofmonth("ds")), config, "ds")
        .where(near)
        .withColumn("is_future", is_future)
        .groupBy("campaign")
        .agg(
            F.max_by(
                F.struct("ds", "yhat", "is_future"),
                F.struct("is_future", "yhat", (-F.unix_date("ds")).alias("early")),
            ).alias("best")
        )
    )
    return config.select("campaign").join(best, "campaign", "left").select(
        "campaign",
        c("best.ds").alias("peak_date"),
        c("best.is_future").alias("is_future"),
        F.coalesce(c("best.yhat").cast("bigint"), F.lit(0)).cast("bigint").alias("projected_volume"),
    )


def campaign_action(peaks: DataFrame, daily: DataFrame) -> DataFrame:
    """Stock up when the peak clearly exceeds the mean day, else advertise discounts."""
    mean_day = daily.agg(exact_mean("y")).scalar()
    high = F.col("projected_volume") > mean_day * F.lit(fv.PEAK_FACTOR)
    return peaks.withColumns({
        "strategy": F.lit(fv.STRATEGY),
        "action_item": F.when(high, fv.ACTION_HIGH[0]).otherwise(fv.ACTION_LOW[0]),
        "status_color": F.when(high, fv.ACTION_HIGH[1]).otherwise(fv.ACTION_LOW[1]),
    })
