"""The campaign dashboard: lift, peak, action and heroes per campaign, and its tables."""

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.fixed_values import DEFAULT_STATUS, TOP_SKUS
from tidemark.functions.scalars import round_even
from tidemark.operators.campaigns import (
    campaign_action, campaign_peak, campaigns, observed_lift,
)
from tidemark.operators.demand import top_skus
from tidemark.operators.forecast import seasonal_trend_forecast
from tidemark.operators.inventory import synth_inventory
from tidemark.operators.planner import dashboard_units, with_date_range
from tidemark.operators.ranking import hero_products
from tidemark.session import materialise
from tidemark.sources import star


def campaign_plan(daily: DataFrame, config: DataFrame, forecast: DataFrame) -> DataFrame:
    """One row per campaign: lifts, forecast peak, action and the dates around the peak."""
    peaks = campaign_action(campaign_peak(forecast, config), daily)
    plan = (
        config.select("position", "campaign", "baseline_units")
        .join(observed_lift(daily, config).select("campaign", "observed_lift", "planned_lift"), "campaign")
        .join(peaks, "campaign")
    )
    return with_date_range(plan)


def published_lifts(plan: DataFrame) -> DataFrame:
    """Position, baseline and planned lift with the two decimals planning works with."""
    return plan.select(
        "campaign", "position", "baseline_units", round_even("planned_lift", 2).alias("planned_lift")
    )


def campaigns_table(plan: DataFrame) -> DataFrame:
    """The plan as rows of the relational ``campaigns`` table (dated campaigns only)."""
    return plan.where("peak_date is not null").select(
        F.col("position").cast("bigint").alias("id"), F.col("campaign").alias("name"),
        "start_date", "peak_date", "end_date",
        F.col("projected_volume").cast("double").alias("projected_volume"),
        "strategy", F.col("action_item").alias("action_items"), F.lit(DEFAULT_STATUS).alias("status"),
    )


def campaign_products_table(heroes: DataFrame, plan: DataFrame) -> DataFrame:
    """Heroes as rows of ``campaign_products`` with expected units."""
    return heroes.join(published_lifts(plan), "campaign").select(
        (F.col("position") * 1000 + F.col("rank")).cast("bigint").alias("id"),
        F.col("position").cast("bigint").alias("campaign_id"),
        "sku", "category", "rank",
        dashboard_units().cast("int").alias("expected_sales"),
    )


class Inputs:
    """The frames a plan over one data folder shares; each is built once when asked for.

    ``daily``, ``heroes`` and ``plan`` are small results of full scans that several later
    steps read, so they are written to the shared folder once.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @cached_property
    def config(self) -> DataFrame:
        return campaigns(self.spark)

    @cached_property
    def as_of(self):
        return star.cut_off(self.spark, self.path)

    @cached_property
    def daily(self) -> DataFrame:
        return materialise(star.daily(self.spark, self.path), "daily")

    @cached_property
    def days(self) -> DataFrame:
        return star.sku_day(self.spark, self.path)

    @cached_property
    def months(self) -> DataFrame:
        return star.sku_month(self.spark, self.path)

    @cached_property
    def products(self) -> DataFrame:
        return star.products(self.spark, self.path)

    @cached_property
    def rollup(self) -> DataFrame:
        return top_skus(star.sku_totals(self.spark, self.path), TOP_SKUS)

    @cached_property
    def inventory(self) -> DataFrame:
        """Written once, so that no step that reads it rolls all order lines up again."""
        return materialise(synth_inventory(self.rollup, self.as_of), "inventory")

    @property
    def stored_inventory(self) -> DataFrame:
        return self.inventory

    @cached_property
    def forecast(self) -> DataFrame:
        return seasonal_trend_forecast(self.daily)

    @cached_property
    def plan(self) -> DataFrame:
        return materialise(campaign_plan(self.daily, self.config, self.forecast), "plan")

    def rank_heroes(self, rounded: bool) -> DataFrame:
        return hero_products(
            self.days, self.products, self.inventory, self.config, self.as_of, rounded=rounded,
            months=self.months, days_of=lambda skus: star.sku_day(self.spark, self.path, skus),
        )

    @cached_property
    def heroes(self) -> DataFrame:
        return materialise(self.rank_heroes(True), "heroes")

    @property
    def events(self) -> DataFrame:
        return star.events(self.spark, self.path)

    @property
    def event_stream(self) -> DataFrame:
        return star.event_stream(self.spark, self.path)
