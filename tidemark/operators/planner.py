"""Campaign planning: SKU mixes, units, discount scenarios, stockout risk, planned sets."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

import pyarrow as pa

from tidemark import fixed_values as fv
from tidemark.functions.exact import exact_sum
from tidemark.functions.scalars import (
    as_col, date_range_label, or_default, round_half_up, status_color, trim_space,
)


def category_mix(heroes: DataFrame, category) -> DataFrame:
    """Heroes of a category, ignoring case; every hero of a campaign that has none of it.

    ``All``, a missing or an empty category keeps everything.
    """
    wanted = F.nullif(F.lit(category) if isinstance(category, str) or category is None else category, F.lit(""))
    matches = F.lower(F.coalesce("category", F.lit(""))) == F.lower(wanted)
    flagged = heroes.withColumn("is_match", F.coalesce(matches, F.lit(False)))
    any_match = flagged.groupBy("campaign").agg(F.max("is_match").alias("any_match"))
    keep_all = F.coalesce(wanted == "All", F.lit(True)) | ~F.col("any_match")
    return (
        flagged.join(any_match, "campaign")
        .where(keep_all | F.col("is_match"))
        .drop("any_match")
    )


def campaign_categories(heroes: DataFrame) -> DataFrame:
    """The non-empty categories of each campaign."""
    return heroes.where(F.col("category") != "").select("campaign", "category").distinct()


def pick_campaign(config: DataFrame, wanted: str | None, planned: DataFrame | None = None) -> DataFrame:
    """The wanted campaign when it is known, else the first planned one, else the first one.

    ``planned`` has a column ``campaign``; "first" is by ``position``.
    """
    if planned is None:
        is_planned = F.lit(False)
    else:
        names = planned.select("campaign").where("campaign is not null").distinct().withColumn("is_planned", F.lit(True))
        config = config.join(names, "campaign", "left")
        is_planned = F.coalesce("is_planned", F.lit(False))
    found = config.orderBy(
        F.coalesce(F.col("campaign") == F.lit(wanted), F.lit(False)).desc(), is_planned.desc(), "position").limit(1)
    return found.drop("is_planned")


def planner_units() -> Column:
    """Forecast units on the planner, with its discount boost."""
    return round_half_up(
        or_default("baseline_units", 100) * or_default("planned_lift", 2.8)
        * F.lit(fv.DISCOUNT_BOOST)
        * (F.lit(0.8) + or_default("velocity", 0.75) * F.lit(0.4))
    )


def dashboard_units() -> Column:
    """Forecast units on the dashboard: no boost, other defaults."""
    return round_half_up(
        or_default("baseline_units", 100) * or_default("planned_lift", 1.0)
        * (F.lit(0.8) + or_default("velocity", 0.5) * F.lit(0.4))
    )


def strategies(spark: SparkSession) -> DataFrame:
    """The signal-to-strategy dimension."""
    labels = [dict(zip(("signal", "strategy", "color"), row)) for row in fv.STRATEGY_BY_SIGNAL]
    return spark.createDataFrame(pa.Table.from_pylist(labels))


def with_strategy(df: DataFrame, dimension: DataFrame) -> DataFrame:
    """Add ``strategy`` and ``color`` of the signal; unknown signals get the organic entry."""
    fallback = next(r for r in fv.STRATEGY_BY_SIGNAL if r[0] == fv.SIGNAL_ORGANIC)
    signal = F.coalesce(F.nullif("signal", F.lit("")), F.lit(fv.SIGNAL_ORGANIC))
    return (
        df.withColumn("signal", signal)
        .join(dimension, "signal", "left")
        .withColumn("strategy", F.coalesce("strategy", F.lit(fallback[1])))
        .withColumn("color", F.coalesce("color", F.lit(fallback[2])))
    )


def discount_scenarios(products: DataFrame, inventory: DataFrame,
                       max_discount: int = fv.MAX_DISCOUNT) -> DataFrame:
    """Demand, stockout, revenue and risk of each product at every whole discount.

    ``products`` has ``sku`` and ``forecast``; each row fans out to a fixed number of
    discounts, after the join so that the join sees each product once.
    """
    c = F.col
    stock = inventory.select("sku", "qty_on_hand", "msrp")
    demand = c("forecast") * (F.lit(1.0) + c("discount_pct") / F.lit(100.0) * F.lit(fv.DISCOUNT_ELASTICITY))
    return (
        products.withColumn("forecast", F.coalesce("forecast", F.lit(0)))
        .join(stock, "sku", "left")
        .withColumns({
            "qty_on_hand": F.coalesce("qty_on_hand", F.lit(0)),
            "msrp": F.coalesce("msrp", F.lit(0.0)),
            "discount_pct": F.explode(F.sequence(F.lit(0), F.lit(max_discount))),
        })
        .withColumn("demand_units", demand)
        .withColumn("daily_units", c("demand_units") / F.lit(float(fv.SCENARIO_DAYS)))
        .withColumn("stockout_days", F.when(c("daily_units") > 0, c("qty_on_hand") / F.nullif("daily_units", F.lit(0.0))))
        .withColumn("revenue", c("demand_units") * c("msrp"))
        .withColumn(
            "risk",
            F.when(c("stockout_days") <= fv.RISK_HIGH_DAYS, "High")
            .when(c("stockout_days") <= fv.RISK_MEDIUM_DAYS, "Medium")
            .otherwise("Low"),
        )
        .withColumn(
            "recommendation",
            F.when(c("stockout_days") <= fv.RISK_HIGH_DAYS, fv.ADVICE_LOW_STOCK)
            .otherwise(fv.ADVICE_HEALTHY),
        )
        .drop("qty_on_hand", "msrp", "daily_units")
    )


def simulation_results(scenarios: DataFrame, plan: DataFrame) -> DataFrame:
    """Scenarios in their stored form: per campaign and discount the parameters, the total
    revenue and a map SKU -> days to stockout.

    The map holds one entry per planned product (the campaign's heroes).
    """
    entries = F.array_sort(F.collect_list(F.struct("sku", "stockout_days")))
    sums = scenarios.groupBy("campaign", "discount_pct").agg(
        exact_sum("revenue").alias("total_revenue"),
        F.map_from_entries(entries).alias("stockout_days"),
    )
    discount = F.col("discount_pct").cast("double")
    multiplier = F.lit(1.0) + discount / F.lit(100.0) * F.lit(fv.DISCOUNT_ELASTICITY)
    return sums.join(plan.select("campaign", "position"), "campaign").select(
        (F.col("position") * 1000 + F.col("discount_pct")).cast("bigint").alias("id"),
        F.col("position").cast("bigint").alias("campaign_id"),
        F.struct(discount.alias("discount_pct"), multiplier.alias("demand_multiplier")).alias("scenario_params"),
        "stockout_days", "total_revenue",
    )


def at_risk(mode: str = "zero_fill") -> Column:
    """Whether a hero joined with its inventory row is at risk of running out.

    ``zero_fill`` reads a missing stockout time as 0 days and ignores zero quantities and
    zero reorder points; ``strict`` treats missing as unknown and zero stock as low.
    """
    c = F.col
    if mode == "zero_fill":
        days = F.coalesce("stockout_days", F.lit(0.0))
        lead = F.coalesce("lead_time_days", F.lit(0))
        pressure = F.coalesce("pressure", F.lit(0.0))
        on_hand, reorder = F.nullif("qty_on_hand", F.lit(0)), F.nullif("reorder_point", F.lit(0))
    elif mode == "strict":
        days, lead, pressure = c("stockout_days"), c("lead_time_days"), c("pressure")
        on_hand, reorder = c("qty_on_hand"), c("reorder_point")
    else:
        raise ValueError(f"unknown mode {mode}")
    rules = [days < lead, days < fv.AT_RISK_DAYS, pressure <= fv.AT_RISK_PRESSURE, on_hand <= reorder]
    hit = F.lit(False)
    for rule in rules:
        hit = hit | F.coalesce(rule, F.lit(False))
    return hit


def stockout_risk_count(heroes: DataFrame, inventory: DataFrame, mode: str = "zero_fill") -> DataFrame:
    """Heroes and heroes at risk per campaign."""
    stock = inventory.select("sku", "qty_on_hand", "reorder_point")
    return (
        heroes.join(stock, "sku", "left")
        .withColumn("at_risk", at_risk(mode))
        .groupBy("campaign")
        .agg(F.count_if("at_risk").alias("at_risk_count"), F.count(F.lit(1)).alias("hero_count"))
    )


def with_date_range(plan: DataFrame) -> DataFrame:
    return plan.withColumns({
        "start_date": F.date_sub("peak_date", fv.RANGE_DAYS),
        "end_date": F.date_add("peak_date", fv.RANGE_DAYS),
        "date_range": date_range_label("peak_date"),
    })


def campaign_by_id(campaigns: DataFrame, key) -> DataFrame:
    """One campaign with ISO dates and its status colour."""
    iso = {d: F.date_format(d, "yyyy-MM-dd") for d in ("start_date", "peak_date", "end_date")}
    return (
        campaigns.where(F.col("id") == as_col(key))
        .withColumns(iso)
        .withColumn("status_color", status_color("status"))
    )


def campaign_products(products: DataFrame, key=None) -> DataFrame:
    """Hero rows of one campaign (or of all), unknown categories named."""
    rows = products if key is None else products.where(F.col("campaign_id") == as_col(key))
    return rows.select(
        "campaign_id", "sku",
        F.coalesce(F.nullif("category", F.lit("")), F.lit(fv.UNKNOWN_CATEGORY)).alias("category"),
        "rank", "expected_sales",
    )


def campaigns_with_products(campaigns: DataFrame, products: DataFrame) -> DataFrame:
    """Every campaign with its hero list nested, in rank order (ranks are 1..n)."""
    lists = campaign_products(products).groupBy("campaign_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "sku", "category"))).alias("hero_products")
    )
    return (
        campaigns.join(lists, F.col("id") == F.col("campaign_id"), "left")
        .withColumn("status_color", status_color("status"))
        .drop("campaign_id")
    )


# Planned campaigns are kept per planner (``user_id``), one row per planner and campaign.

def launch(planned: DataFrame, launched: DataFrame) -> DataFrame:
    """Planned campaigns after a launch: the union without repeats."""
    return planned.select("user_id", "campaign").union(
        launched.where(trim_space("campaign") != "").select("user_id", "campaign")
    ).distinct()


def delete(planned: DataFrame, deleted: DataFrame) -> DataFrame:
    """Planned campaigns after deletions. The pinned campaign is never deleted, and a
    planner left with nothing gets the pinned one."""
    gone = deleted.where(F.col("campaign") != fv.PINNED_CAMPAIGN)
    left = planned.select("user_id", "campaign").join(gone, ["user_id", "campaign"], "left_anti")
    emptied = planned.select("user_id").distinct().join(left, "user_id", "left_anti")
    return left.union(emptied.select("user_id", F.lit(fv.PINNED_CAMPAIGN)))


def planned_order(planned: DataFrame, plan: DataFrame) -> DataFrame:
    """Each planner's known campaigns: pinned first, then by peak date, unknown dates
    last, then by name. Campaigns the plan does not know are left out."""
    known = planned.join(plan.select("campaign", "peak_date"), "campaign")
    w = W.partitionBy("user_id").orderBy(
        F.col("campaign") != fv.PINNED_CAMPAIGN, F.col("peak_date").asc_nulls_last(), "campaign"
    )
    return known.withColumn("position", F.row_number().over(w))
