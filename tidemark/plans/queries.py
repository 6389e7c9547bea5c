"""The registered queries: name -> callable (spark, data folder) -> DataFrame."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.functions.exact import exact_mean, exact_sum
from tidemark.functions.scalars import cover_label, display_name
from tidemark.operators import accuracy, callouts, campaigns, demand, forecast, global_rank, intervals, inventory, keywords
from tidemark.operators import planner, quality, ranking, rolling, series
from tidemark.plans import backtest as bt
from tidemark.plans import incremental
from tidemark.plans.dashboard import (
    Inputs, campaign_products_table, campaigns_table, published_lifts,
)
from tidemark.plans.refresh import refresh
from tidemark.session import configure, materialise, work_folder
from tidemark.sources import documents, sales, sinks, star, tables
from tidemark.streaming import lateness, ledger, live, runner

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# Keyword lists that match few or no SKUs, so that the fallback candidates are needed.
NARROW_KEYWORDS = {
    "New Year": ["777"],
    "Valentine's Day": ["promo"],
    "Halloween": ["All", "none"],
    "Christmas": ["no such word"],
}
# The list query looks further ahead than the alert, which this data hardly ever raises.
CRITICAL_LIST_MINUTES = 1440
ROLLING_HORIZONS = (1, 4, 13, 26, 52)
FILTER_KEYWORDS = ["promo", "Std+", "199", "dar."]


def query(build: Callable[[Inputs], DataFrame]):
    """Register a function of the shared inputs under its own name."""
    def run(spark: SparkSession, path: str) -> DataFrame:
        configure(spark)
        return build(Inputs(spark, path))

    QUERIES[build.__name__] = run
    return build


# Scans and cleaning

def raw_sales(x: Inputs) -> DataFrame:
    """Order lines as delivered text: padded and blank SKUs, unreadable dates and amounts,
    negative amounts and missing categories occur."""
    lines = star.table(x.spark, x.path, "lineitem")
    orders = star.table(x.spark, x.path, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    part = star.table(x.spark, x.path, "part").select("p_partkey", "p_name", "p_type", "p_size")
    customer = star.table(x.spark, x.path, "customer").select("c_custkey", "c_nationkey")
    nation = star.table(x.spark, x.path, "nation").select("n_nationkey", "n_name")
    joined = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    )
    price = F.col("l_extendedprice").cast("string")
    return joined.select(
        F.when(F.col("l_linenumber") == 7, "not a date")
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("Order Date"),
        F.when(F.col("l_linenumber") == 6, F.concat(F.lit("-"), price))
        .when(F.col("l_linenumber") == 5, "n/a").otherwise(price).alias("Sales"),
        F.when(F.col("l_partkey") % 50 == 0, "   ")
        .otherwise(F.concat(F.lit("  "), F.col("l_partkey").cast("string"), F.lit(" "))).alias("Product-ID"),
        F.col("p_name").alias("Product Name"),
        F.when(F.col("p_size") > 45, "").otherwise(F.col("p_type")).alias("Category"),
        F.col("n_name").alias("Country"),
    )


@query
def clean_sales(x):
    clean = sales.clean_sales(sales.normalise_headers(raw_sales(x)))
    return clean.groupBy("category", "country").agg(
        F.count(F.lit(1)).alias("n_rows"), exact_sum("sales").alias("sales"),
        F.min("order_date").alias("first_date"), F.max("order_date").alias("last_date"),
    )


@query
def sales_csv_scan(x):
    path = work_folder(x.spark, "sales-csv")
    raw_sales(x).write.csv(path, header=True, escape='"')
    clean = sales.clean_sales(sales.read_sales(x.spark, path))
    return series.daily_sales(clean, ("category",))


@query
def dataset_profile(x):
    return series.dataset_profile(star.sales(x.spark, x.path))


# Series, lift and peak

@query
def daily_gmv(x):
    return star.daily(x.spark, x.path)


@query
def weekly_resample(x):
    return series.weekly_sales(x.daily)


@query
def holiday_windows(x):
    return campaigns.holiday_windows(x.daily, x.config)


@query
def holiday_days(x):
    return campaigns.holiday_days(x.daily, x.config).where("is_holiday").select("campaign", "ds", "y")


@query
def campaign_lift(x):
    return campaigns.observed_lift(x.daily, x.config)


@query
def future_calendar(x):
    return series.future_calendar(x.daily)


@query
def seasonal_trend_forecast(x):
    return x.forecast


@query
def category_trend_forecast(x):
    return forecast.seasonal_trend_forecast(series.daily_sales(x.days, ("category",)), ("category",))


@query
def forecast_split(x):
    history, future = series.split_future(x.forecast, series.last_day(x.daily))
    parts = history.withColumn("part", F.lit("history")).union(future.withColumn("part", F.lit("future")))
    return parts.groupBy("part").agg(
        F.count(F.lit(1)).alias("n_days"), F.min("ds").alias("first_day"), F.max("ds").alias("last_day")
    )


@query
def campaign_peak(x):
    return campaigns.campaign_peak(x.forecast, x.config)


@query
def campaign_action(x):
    return campaigns.campaign_action(campaigns.campaign_peak(x.forecast, x.config), x.daily)


@query
def campaign_plan(x):
    return x.plan.drop("is_future")


@query
def campaign_forecast_table(x):
    return forecast.campaign_forecast_table(x.daily, x.forecast, x.plan)


@query
def forecast_additive(x):
    return forecast.additive_forecast(x.daily)


@query
def forecast_by_category(x):
    return forecast.additive_forecast(series.daily_sales(x.days, ("category",)), ("category",))


@query
def forecast_weekly(x):
    return forecast.additive_forecast(series.weekly_sales(x.daily), horizon=52, step_days=7, weekly=False)


def fit_checks(found: DataFrame, actual: DataFrame, *keys: str) -> DataFrame:
    """What must hold of a fitted forecast, whatever its last digits: its dates, ordered bounds, errors
    below those of the mean, and 80 to 100 % of the observed days inside the interval."""
    c = F.col
    joined = materialise(found.join(actual, [*keys, "ds"], "left"), "fit")
    means = joined.groupBy(*keys).agg(F.avg("y").alias("mean_y"))
    joined = joined.join(means, list(keys)) if keys else joined.withColumn("mean_y", means.select("mean_y").scalar())
    inside = c("y").between(c("yhat_lower"), c("yhat_upper"))
    return joined.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("ds").alias("first_ds"), F.max("ds").alias("last_ds"),
        F.count_if("is_future").alias("n_future"),
        F.bool_and((c("yhat_lower") <= c("yhat")) & (c("yhat") <= c("yhat_upper"))).alias("bounds_hold"),
        (F.sum(F.pow(c("y") - c("yhat"), F.lit(2))) < F.sum(F.pow(c("y") - c("mean_y"), F.lit(2)))).alias("beats_mean"),
        (F.count_if(inside) / F.count("y")).between(0.8, 1.0).alias("covers"),
    )


@query
def forecast_additive_check(x):
    return fit_checks(forecast.additive_forecast(x.daily), x.daily)


@query
def forecast_category_check(x):
    daily = materialise(series.daily_sales(x.days, ("category",)), "category-days")
    return fit_checks(forecast.additive_forecast(daily, ("category",)), daily, "category")


@query
def forecast_weekly_check(x):
    weekly = materialise(series.weekly_sales(x.daily), "weekly")
    return fit_checks(forecast.additive_forecast(weekly, horizon=52, step_days=7, weekly=False), weekly)


@query
def forecast_sparse(x):
    """Weekly sales with a trend of few changes and an interval of sampled futures."""
    return forecast.additive_forecast(series.weekly_sales(x.daily), horizon=52, step_days=7, weekly=False, trend="sparse")


@query
def forecast_sparse_check(x):
    daily = materialise(series.daily_sales(x.days, ("category",)), "category-days")
    found = forecast.additive_forecast(daily, ("category",), 90, trend="sparse")
    return fit_checks(found, daily, "category")


# Backtest

def backtest_inputs(x: Inputs, method: str = "closed_form"):
    weekly = materialise(series.weekly_sales(x.daily), "weekly")
    year = bt.last_full_year(x.daily)
    return bt.backtest(weekly, year, method=method), weekly, year


@query
def train_test_split(x):
    _, weekly, year = backtest_inputs(x)
    parts = [("train", bt.year_range(year - bt.TRAIN_YEARS, year - 1)), ("test", bt.year_range(year, year))]
    split = [series.between_days(weekly, *days).withColumn("part", F.lit(name)) for name, days in parts]
    return split[0].union(split[1]).groupBy("part").agg(
        F.count(F.lit(1)).alias("n_weeks"), F.min("ds").alias("first_week"),
        F.max("ds").alias("last_week"), exact_sum("y").alias("y"),
    )


@query
def backtest_weeks(x):
    return backtest_inputs(x)[0].drop("is_future")


@query
def forecast_accuracy(x):
    return accuracy.forecast_accuracy(backtest_inputs(x)[0])


@query
def campaign_accuracy(x):
    merged, _, year = backtest_inputs(x)
    return accuracy.campaign_accuracy(merged, x.config, year)


@query
def forecast_accuracy_additive(x):
    return accuracy.forecast_accuracy(backtest_inputs(x, "additive")[0])


@query
def forecast_accuracy_sparse(x):
    return accuracy.forecast_accuracy(backtest_inputs(x, "sparse")[0])


@query
def rolling_accuracy(x):
    """Accuracy of every week as an origin, one to 52 weeks ahead, over all categories."""
    weekly = materialise(series.weekly_sales(series.daily_sales(x.days, ("category",)), ("category",)), "category-weeks")
    ahead = rolling.rolling_forecasts(rolling.origins(weekly, ("category",)), ROLLING_HORIZONS)
    return rolling.rolling_accuracy(ahead, weekly, ("category",))


@query
def accuracy_report(x):
    merged, _, year = backtest_inputs(x)
    merged = materialise(merged, "merged")
    report = sinks.accuracy_report(
        accuracy.forecast_accuracy(merged), accuracy.campaign_accuracy(merged, x.config, year),
        bt.year_range(year - bt.TRAIN_YEARS, year - 1), bt.year_range(year, year),
    )
    path = work_folder(x.spark, "accuracy")
    sinks.write_accuracy_report(report, path)
    back = x.spark.read.schema(report.schema).json(path)
    return back.select(
        F.col("train_window.start").alias("train_start"), F.col("train_window.end").alias("train_end"),
        F.col("test_window.start").alias("test_start"), F.col("test_window.end").alias("test_end"),
        F.col("overall.`Test weeks`").alias("test_weeks"),
        F.explode("per_campaign").alias("campaign", "m"),
    ).select("*", F.col("m.weeks").alias("weeks")).drop("m")


# SKUs, inventory and ranking

@query
def sku_rollup(x):
    return x.rollup


@query
def sku_rollup_from_sales(x):
    return demand.sku_rollup(star.sales(x.spark, x.path))


@query
def synth_inventory(x):
    return x.inventory


@query
def available_qty(x):
    return inventory.with_available(x.inventory).select(
        "sku", "warehouse", "supplier", "qty_on_hand", "qty_reserved", "available_qty",
        "reorder_point", "last_restock_date", "lead_time_days",
    )


@query
def low_stock(x):
    return inventory.low_stock(x.inventory)


@query
def low_stock_count(x):
    return inventory.low_stock_count(x.inventory)


@query
def sku_lookup(x):
    best = x.rollup.agg(F.max_by("sku", "total_sales")).scalar()
    return inventory.lookup(x.inventory, F.lower(best)).drop("name", "category")


@query
def bulk_lookup(x):
    return inventory.bulk_lookup(x.inventory, x.events.select("sku").distinct())


@query
def sku_demand(x):
    return demand.sku_demand(star.sku_day_totals(x.spark, x.path))


def all_metrics(x: Inputs) -> DataFrame:
    return demand.sku_metrics(star.sku_day_totals(x.spark, x.path), x.inventory, x.as_of)


@query
def sku_metrics(x):
    return all_metrics(x).select(
        "sku", "trend", "age_days", "velocity", "available", "daily_units", "pressure_raw",
        "pressure", "stockout_days", "margin",
    )


@query
def sku_signals(x):
    signals = all_metrics(x).select("sku", "signal")
    return planner.with_strategy(signals, planner.strategies(x.spark))


@query
def inventory_health(x):
    return all_metrics(x).select("sku", "low_margin", "stockout_risk", "health")


@query
def month_topk(x):
    totals = demand.month_totals(x.months, x.config)
    return demand.month_topk(totals, 20).select("campaign", "rank", "sku", "total")


@query
def keyword_filter(x):
    return demand.keyword_filter(x.days, FILTER_KEYWORDS).groupBy("sku", "category").agg(
        exact_sum("sales").alias("sales"), F.sum("n_lines").alias("n_lines")
    )


@query
def candidate_fallback(x):
    rows = [{**row, "keywords": NARROW_KEYWORDS[row["campaign"]]} for row in fv.CAMPAIGNS]
    narrow = campaigns.campaigns(x.spark, rows)
    return demand.candidates(demand.month_totals(x.months, narrow))


@query
def hero_products(x):
    return x.rank_heroes(False)


@query
def hero_products_published(x):
    return x.rank_heroes(True).drop("total")


@query
def top_movers(x):
    return ranking.top_movers(x.rank_heroes(True)).select("campaign", "rank", "sku", "name")


@query
def modal_category(x):
    lines = star.table(x.spark, x.path, "lineitem").select("l_orderkey", F.col("l_partkey").alias("sku"))
    orders = star.table(x.spark, x.path, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("category")
    )
    return demand.modal_value(lines.join(orders, "l_orderkey"), ["sku"], "category")


@query
def first_country(x):
    return demand.first_value(star.sales(x.spark, x.path), "country")


@query
def display_names(x):
    part = star.table(x.spark, x.path, "part")
    names = part.select(
        "p_partkey", "p_size",
        F.when(F.col("p_size") % 10 == 0, "  ").otherwise(F.concat(F.lit(" "), "p_name")).alias("name"),
        F.when(F.col("p_size") % 20 != 0, F.concat(F.lit("SKU_"), F.col("p_partkey").cast("string")))
        .alias("sku"),
    )
    return names.select("p_partkey", display_name("name", "sku", "p_size").alias("display_name"))


# Planner, scenarios, risk and lookups

@query
def category_mix(x):
    mix = planner.category_mix(x.heroes, "promo")
    return mix.select("campaign", "rank", "sku", "category", "is_match")


@query
def campaign_categories(x):
    return planner.campaign_categories(x.heroes)


@query
def pick_planned(x):
    """No campaign is asked for by a known name, so the first planned one is picked."""
    planned = x.plan.where("position > 2").select("campaign")
    return planner.pick_campaign(x.plan, "Summer Sale", planned).select("campaign", "projected_volume")


@query
def pick_campaign(x):
    return planner.pick_campaign(x.plan, "Summer Sale").select("campaign", "peak_date", "projected_volume")


def planned_heroes(x: Inputs) -> DataFrame:
    return x.heroes.join(published_lifts(x.plan), "campaign")


@query
def planner_units(x):
    units = planned_heroes(x).withColumn("units", planner.planner_units())
    return planner.with_strategy(units, planner.strategies(x.spark)).select(
        "campaign", "rank", "sku", "units", "signal", "strategy", "color"
    )


@query
def dashboard_units(x):
    return planned_heroes(x).select("campaign", "rank", "sku", planner.dashboard_units().alias("units"))


def hero_scenarios(x: Inputs) -> DataFrame:
    products = planned_heroes(x).select("campaign", "sku", planner.planner_units().alias("forecast"))
    return planner.discount_scenarios(products, x.stored_inventory)


@query
def discount_scenarios(x):
    return hero_scenarios(x)


@query
def scenario_grid(x):
    """Every SKU sold in a campaign's month at every discount, summed per risk label."""
    totals = demand.month_totals(x.months, x.config).select("campaign", "sku")
    products = (
        totals.join(published_lifts(x.plan), "campaign")
        .withColumn("velocity", F.lit(0.0))
        .select("campaign", "sku", planner.planner_units().alias("forecast"))
    )
    return planner.discount_scenarios(products, x.inventory).groupBy("campaign", "discount_pct", "risk").agg(
        F.count(F.lit(1)).alias("n_skus"), exact_sum("revenue").alias("revenue"),
        exact_sum("demand_units").alias("demand_units"),
    )


@query
def simulation_results(x):
    """Scenarios stored as the relational table and read back."""
    path = work_folder(x.spark, "tables")
    tables.write_table(planner.simulation_results(hero_scenarios(x), x.plan), "simulation_results", path)
    return tables.read_table(x.spark, "simulation_results", path).select(
        "id", "campaign_id", F.col("scenario_params.demand_multiplier").alias("demand_multiplier"),
        "total_revenue", F.explode("stockout_days").alias("sku", "stockout_days"),
    )


@query
def stockout_risk_count(x):
    return planner.stockout_risk_count(x.heroes, x.inventory)


@query
def stockout_risk_strict(x):
    return planner.stockout_risk_count(x.heroes, x.inventory, mode="strict")


@query
def campaign_by_id(x):
    """The campaign with the highest projected volume, looked up by its id."""
    table = campaigns_table(x.plan)
    best = table.agg(F.max_by("id", F.struct("projected_volume", -F.col("id")))).scalar()
    return planner.campaign_by_id(table, best)


@query
def campaign_products(x):
    return planner.campaign_products(campaign_products_table(x.heroes, x.plan))


@query
def campaign_nested(x):
    nested = planner.campaigns_with_products(
        campaigns_table(x.plan), campaign_products_table(x.heroes, x.plan)
    )
    skus = F.transform("hero_products", lambda h: F.concat(h["sku"], F.lit(":"), h["category"]))
    return nested.select("name", "status_color", "peak_date", F.array_join(skus, ",").alias("heroes"))


def chosen_campaigns(x: Inputs, event_type: str) -> DataFrame:
    """Planner choices taken from events: the user and the campaign its key points at."""
    known = x.config.select((F.col("position") - 1).alias("slot"), "campaign")
    picks = x.events.where(F.col("event_type") == event_type).select(
        "user_id", (F.col("sku").cast("int") % 5).alias("slot")
    )
    return picks.join(known, "slot", "left").select(
        "user_id", F.coalesce("campaign", F.lit("Retired Sale")).alias("campaign")
    )


@query
def planned_union(x):
    return planner.launch(chosen_campaigns(x, "signup").distinct(), chosen_campaigns(x, "view"))


@query
def planned_delete(x):
    return planner.delete(chosen_campaigns(x, "signup").distinct(), chosen_campaigns(x, "error").distinct())


@query
def planned_order(x):
    return planner.planned_order(chosen_campaigns(x, "signup").distinct(), x.plan)


# Files written and read back

@query
def inventory_csv(x):
    path = work_folder(x.spark, "inventory-csv")
    sinks.write_inventory_csv(x.inventory, path)
    return sales.read_inventory(x.spark, path)


@query
def inventory_json(x):
    csv, path = work_folder(x.spark, "inventory-csv"), work_folder(x.spark, "inventory-json")
    sinks.write_inventory_csv(x.inventory, csv)
    sinks.write_inventory_json(sales.read_inventory(x.spark, csv), path)
    return sales.read_inventory(x.spark, path, "json")


@query
def dashboard_document(x):
    path = work_folder(x.spark, "dashboard")
    documents.write_dashboard(documents.dashboard_document(x.plan, x.heroes), path)
    return documents.read_dashboard(x.spark, path)


@query
def dashboard_campaigns(x):
    path = work_folder(x.spark, "dashboard")
    documents.write_dashboard(documents.dashboard_document(x.plan, x.heroes), path)
    return documents.read_dashboard_entries(x.spark, path).select(
        "campaign", "peak_date", "projected_volume", "avg_units_per_product_baseline",
        F.size("hero_products").cast("bigint").alias("n_heroes"), "strategy", "action_item", "status_color",
    )


@query
def sku_mix_export(x):
    path = work_folder(x.spark, "mix")
    sinks.export_sku_mix(sinks.sku_mix(x.plan, x.heroes), path)
    mix = sales.normalise_headers(x.spark.read.csv(path, header=True, escape='"'))
    return mix.withColumnRenamed("projected_volume_(usd)", "projected_volume")


@query
def critical_export(x):
    """SKUs at or below their reorder point, written one per line."""
    path = work_folder(x.spark, "critical")
    sinks.export_critical_skus(inventory.low_stock(x.inventory), path)
    return x.spark.read.text(path).withColumnRenamed("value", "sku")


@query
def table_defaults(x):
    """Inventory with gaps conformed to the relational table: defaults are filled in."""
    gaps = x.inventory.withColumns({
        "qty_reserved": F.when(F.col("lead_time_days") > 5, F.col("qty_reserved")),
        "lead_time_days": F.when(F.col("qty_on_hand") > 50, F.col("lead_time_days")),
    })
    return tables.conform(gaps, "inventory").select("sku", "qty_on_hand", "qty_reserved", "lead_time_days")


@query
def relational_sales(x):
    """SKU-day totals stored as the relational sales table and read back."""
    rows = x.days.select(
        "sku", F.col("category").alias("category_name_1"), F.col("order_date").alias("date"),
        F.col("n_lines").cast("int").alias("sales_quantity"), F.col("sales").alias("gmv"),
    )
    path = work_folder(x.spark, "tables")
    tables.write_table(rows, "sales_data", path)
    return tables.read_table(x.spark, "sales_data", path).groupBy("category_name_1").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("sales_quantity").alias("quantity"),
        exact_sum("gmv").alias("gmv"),
    )


# Live operations (streams over the events file)

def hourly(x: Inputs) -> DataFrame:
    return runner.run_to_table(live.gmv_by_hour(x.event_stream), "gmv")


def mean_hour(hours: DataFrame):
    return hours.agg(exact_mean("gmv")).scalar()


@query
def live_gmv_hourly(x):
    hours = hourly(x)
    return live.pacing(hours, mean_hour(hours))


@query
def live_velocity(x):
    return live.velocity(hourly(x))


@query
def live_velocity_stream(x):
    """The same rows, joined while the stream runs."""
    return runner.run_to_table(live.velocity_stream(x.event_stream, x.event_stream), "velocity")


def deliveries(x: Inputs) -> DataFrame:
    """What each sold SKU is supplied with: lots of the part's size, every three to nine days."""
    sold = live.purchases(x.events).select(F.col("sku").try_cast("bigint").alias("p_partkey")).distinct()
    span = x.events.agg(F.struct(F.date_trunc("day", F.min("ts")).alias("lo"), F.max("ts").alias("hi"))).scalar()
    parts = star.table(x.spark, x.path, "part").join(sold, "p_partkey", "left_semi").withColumn("span", span)
    days = F.make_dt_interval(F.col("p_size") % 7 + 3)
    return parts.select(
        F.col("p_partkey").cast("string").alias("sku"),
        F.explode(F.sequence("span.lo", "span.hi", days)).alias("ts"),
        F.col("p_size").cast("bigint").alias("qty"),
    )


def stock_ledger(x: Inputs) -> DataFrame:
    came, path = deliveries(x), work_folder(x.spark, "deliveries")
    came.write.parquet(path)
    arriving = x.spark.readStream.schema(came.schema).parquet(path)
    booked = ledger.running_stock(ledger.moves(x.event_stream, arriving))
    # Every state partition starts a Python worker and a state store of its own in each batch: one a core.
    return runner.run_to_table(booked, "ledger", most_partitions=x.spark.sparkContext.defaultParallelism)


@query
def live_running_stock(x):
    """The stock that each purchase leaves, in finished hours."""
    booked = stock_ledger(x).where("event_id is not null")
    return booked.select("sku", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id", "remaining")


@query
def live_stock_hours(x):
    """Stock, orders and minutes to out-of-stock at the end of each hour with purchases."""
    closed = stock_ledger(x).where("orders is not null")
    return closed.select("sku", F.col("ts").cast("timestamp_ntz").alias("hour_end"), "remaining", "orders", "eta_oos_mins")


@query
def live_users(x):
    return runner.run_to_table(live.online_users(x.event_stream), "users")


@query
def live_users_check(x):
    """Do the estimates of finished windows lie within three standard errors of the exact numbers?"""
    estimated = runner.run_to_table(live.online_users(x.event_stream), "users").withColumnRenamed("users", "estimate")
    both = estimated.join(live.online_users_exact(x.events), ["window_start", "window_end"])
    near = F.abs(F.col("estimate") - F.col("users")) <= 1 + 3 * 0.05 * F.col("users")
    return both.agg(F.count(F.lit(1)).alias("n_windows"), F.bool_and(near).alias("all_near"))


@query
def live_users_panes(x):
    """Are the users of windows, days and all time, merged from stored panes, within three standard errors?"""
    panes = runner.run_to_table(live.user_panes(x.event_stream), "panes")
    last = panes.agg(F.max("pane_end")).scalar()
    seen = x.events.withColumn("last", last).where(F.col("ts").cast("timestamp_ntz") < F.col("last"))

    def scopes(estimate, exact, name, *on):
        both = estimate.withColumnRenamed("users", "estimate").join(exact, list(on), "full")
        return both.select(F.lit(name).alias("scope"), "estimate", "users")

    def distinct(*on):
        users = seen.select(*on, "user_id").distinct()
        return users.groupBy(*users.columns[:-1]).agg(F.count("user_id").alias("users"))

    day = F.to_date(F.col("ts").cast("timestamp_ntz")).alias("day")
    every = panes.agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate")).select(
        F.lit("all").alias("scope"), "estimate", distinct().scalar().alias("users"))
    both = scopes(live.pane_windows(panes), live.online_users_exact(seen), "window", "window_start", "window_end").unionByName(
        scopes(live.merge_panes(panes, F.to_date("pane_start").alias("day")), distinct(day), "day", "day")).unionByName(every)
    near = F.abs(F.col("estimate") - F.col("users")) <= 1 + 3 * live.SKETCH_ERROR * F.col("users")
    return both.groupBy("scope").agg(
        F.count(F.lit(1)).alias("n_scopes"), F.sum("users").alias("users"), F.bool_and(F.coalesce(near, F.lit(False))).alias("all_near"))


@query
def users_exact(x):
    return live.online_users_exact(x.events)


def sku_etas(x: Inputs) -> DataFrame:
    counted = live.sku_orders_by_hour(x.event_stream, x.stored_inventory)
    return live.minutes_to_out_of_stock(runner.run_to_table(counted, "sku-hours"))


@query
def live_oos_eta(x):
    return sku_etas(x)


@query
def live_watchlist(x):
    hours = hourly(x)
    watched = live.watchlist(sku_etas(x), live.pacing(hours, mean_hour(hours)))
    return watched.select(
        "hour_start", "sku", "diagnosis", "action", cover_label("eta_oos_mins").alias("cover")
    )


@query
def live_critical(x):
    """Per hour the number of SKUs about to sell out and the shortest time left."""
    return sku_etas(x).groupBy("hour_start").agg(
        F.count_if(ranking.is_critical()).alias("critical_count"),
        F.min("eta_oos_mins").alias("least_minutes"),
    )


@query
def critical_list(x):
    """The SKUs about to sell out, per hour and most urgent first, exported as lines and read back."""
    urgent = live.critical(sku_etas(x), CRITICAL_LIST_MINUTES).select("hour_start", "sku", "eta_oos_mins")
    ranked = global_rank.global_rank(urgent, F.asc("hour_start"), F.asc("eta_oos_mins"), F.asc("sku"), percentile=None)
    first = ranked.groupBy("hour_start").agg(F.min("rank").alias("first"))
    listed = ranked.join(first, "hour_start").withColumn("position", (F.col("rank") - F.col("first") + 1).cast("int"))
    path = work_folder(x.spark, "critical")
    listed = materialise(listed.drop("rank", "first"), "critical-list")
    sinks.export_critical_skus(listed.orderBy("hour_start", "position"), path)
    exported = x.spark.read.text(path).groupBy(F.col("value").alias("sku")).agg(F.count(F.lit(1)).alias("n_hours"))
    return listed.join(exported, "sku").select(
        "hour_start", "position", "sku", F.floor("eta_oos_mins").alias("minutes"), cover_label("eta_oos_mins").alias("reason"),
        "n_hours")


@query
def live_ticker(x):
    sold = live.purchases(x.event_stream).select("event_id", "ts", "user_id", "value", "sku")
    return runner.run_ticker(sold).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query
def live_sessions(x):
    return runner.run_to_table(live.sessions(x.event_stream), "sessions")


@query
def sessions_batch(x):
    return live.sessions_batch(x.events)


@query
def live_dedup(x):
    """Every third event arrives twice; finished rows per type after deduplication."""
    doubled = x.event_stream.union(x.event_stream.where(F.col("event_id") % 3 == 0))
    once = runner.run_to_table(live.deduplicate(doubled), "dedup")
    return once.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n_events"), exact_sum("value").alias("value"),
        F.max("ts").cast("timestamp_ntz").alias("last_ts"),
    )


def arrivals(x: Inputs) -> str:
    """The events as six files that arrive one after the other: a quarter twice at once, a seventh again
    with the next file, and every fiftieth only with the file after that."""
    events = star.table(x.spark, x.path, "events")
    folder, number = work_folder(x.spark, "arrivals"), F.col("event_id")
    last = events.agg(F.max("event_id")).scalar()
    due = F.floor(number * 6 / (last + 1)).cast("int")
    again = F.array(
        F.when(number % 50 == 7, F.least(due + 2, F.lit(5))).otherwise(due), F.when(number % 4 == 0, due),
        F.when(number % 7 == 0, F.least(due + 1, F.lit(5))))
    placed = materialise(events.withColumn("file", F.explode(F.array_compact(again))), "arrivals")
    for k in range(6):
        placed.where(F.col("file") == k).drop("file").coalesce(1).write.parquet(f"{folder}/events-{k}.parquet")
    return folder


@query
def live_late_events(x):
    """Rows kept, copies and late ones per type, each told by the watermark when it arrived."""
    stream = star.event_stream(x.spark, f"{arrivals(x)}/*", files_per_trigger=1, glob=False)
    told, _ = lateness.run_split(stream)
    return told.groupBy("status", "event_type").agg(F.count(F.lit(1)).alias("n_events"), exact_sum("value").alias("value"))


@query
def dedup_batch(x):
    doubled = x.events.union(x.events.where(F.col("event_id") % 3 == 0))
    return live.deduplicate(doubled).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n_events"), exact_sum("value").alias("value")
    )


@query
def live_document(x):
    """The sales ticker with each sale's minutes to out-of-stock, written as one nested
    document and read back as rows."""
    etas = live.minutes_to_out_of_stock(live.sku_orders_by_hour(x.events, x.stored_inventory))
    sold = ranking.newest(live.purchases(x.events)).withColumn(
        "hour_start", F.date_trunc("hour", "ts").cast("timestamp_ntz")
    )
    sale = F.struct(
        F.col("sku").alias("name"), F.floor("eta_oos_mins").alias("etaMins"), F.col("ts").alias("time")
    )
    ticker = sold.join(etas, ["hour_start", "sku"]).agg(
        F.reverse(F.array_sort(F.collect_list(F.struct("ts", sale.alias("sale"))))).getField("sale")
        .alias("liveSalesHistory")
    )
    path = work_folder(x.spark, "live-document")
    iso = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    ticker.select(F.to_json(F.struct("liveSalesHistory"), iso).alias("value")).write.text(path)
    back = documents.live_sales_rows(documents.read_live_document(x.spark, path))
    return back.withColumn("time", F.col("time").cast("timestamp_ntz"))


# Data quality

@query
def empty_sku_check(x):
    """Heroes of the written document whose SKU was blanked on every third rank."""
    return quality.empty_sku_check(blanked(x))


@query
def empty_sku_sample(x):
    return quality.empty_sku_sample(blanked(x)).select("campaign", "rank")


def blanked(x: Inputs) -> DataFrame:
    return x.heroes.withColumn("sku", F.when(F.col("rank") % 3 == 0, " ").otherwise(F.col("sku")))


@query
def duplicate_keys(x):
    lines = star.table(x.spark, x.path, "lineitem")
    return quality.duplicate_keys(lines, ["l_orderkey", "l_linenumber"])


@query
def null_checks(x):
    gaps = star.dated_sales(x.spark, x.path, category=True).select(
        "sku", F.nullif("category", F.lit("PROMO")).alias("category"),
        F.when(F.month("order_date") != 2, F.col("order_date")).alias("order_date"), "sales",
    )
    return quality.missing_values(gaps, ["sku", "category", "order_date", "sales"])


@query
def orphan_check(x):
    """Orders that own no order line, and their customers."""
    orders = star.table(x.spark, x.path, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    lines = star.table(x.spark, x.path, "lineitem").select("l_orderkey")
    return quality.orphans(orders, lines, "o_orderkey", "l_orderkey")


@query
def orphans_removed(x):
    orders = star.table(x.spark, x.path, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    lines = star.table(x.spark, x.path, "lineitem").select("l_orderkey")
    kept = quality.without_orphans(orders, lines, "o_orderkey", "l_orderkey")
    return kept.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n_orders"), exact_sum("o_totalprice").alias("total")
    )


@query
def table_checks(x):
    """Rules of the relational sales table on raw lines: the (SKU, date) key repeats."""
    lines = star.dated_sales(x.spark, x.path).select(
        "sku", F.col("order_date").alias("date"), F.col("sales").alias("gmv")
    )
    return quality.table_checks(tables.conform(lines, "sales_data"), "sales_data")


@query
def refresh_report(x):
    return refresh(x.spark, x.path, work_folder(x.spark, "refresh")).select("step", "status")


# Messages

@query
def callout_candidates(x):
    tones = F.explode(F.array(F.lit(fv.URGENT), F.lit(fv.PLAYFUL)))
    products = x.products.select("sku", "name", tones.alias("tone"))
    return products.select(
        "sku", "tone", F.posexplode(callouts.template_messages("sku", "name", "tone")).alias("pos", "m")
    ).select("sku", "tone", (F.col("pos") + 1).alias("position"), "m.template_id", "m.text")


def replies(x: Inputs) -> DataFrame:
    return star.table(x.spark, x.path, "conversations").where("role = 'assistant'")


@query
def callout_clean(x):
    return callouts.clean_callouts(replies(x), ["conv_id", "turn"], "text")


@query
def callout_fallback(x):
    """Messages per reply; a reply without a usable line gets the templates."""
    products = replies(x).select(
        F.concat_ws("-", "conv_id", "turn").alias("sku"),
        F.concat(F.lit("conversation "), F.col("conv_id").cast("string")).alias("name"),
        F.when(F.col("turn") % 4 == 1, fv.URGENT).otherwise(fv.PLAYFUL).alias("tone"),
        F.when(F.col("conv_id") % 7 == 0, F.lit("1. short\n\n2) \"tiny\"")).otherwise(F.col("text")).alias("text"),
    )
    return callouts.callouts(products, "text")


# Operators for tables and calendars of any size

@query
def interval_sales(x):
    """Sales of the days in each of as many windows as there are orders."""
    windows = star.table(x.spark, x.path, "orders").select(
        "o_orderkey", F.to_date("o_orderdate").alias("window_start"),
        F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 30).cast("int")).alias("window_end"))
    met = intervals.points_in_windows(x.daily, windows)
    return met.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n_days"), exact_sum("y").alias("gmv"))


@query
def keyword_lists(x):
    """A keyword list for each product: a part of its name, and its number with a seven behind it."""
    parts = star.table(x.spark, x.path, "part")
    lists = parts.select(
        F.col("p_partkey").cast("string").alias("list_id"),
        F.array(F.upper(F.substring("p_name", 2, 6)), F.concat(F.col("p_partkey").cast("string"), F.lit("7"))).alias("keywords"))
    return keywords.match_lists(x.products, lists, ("name", "sku"), totals=True)


def delivered(x: Inputs) -> str:
    """All sales as three deliveries to a stored table: old years, then twice the new ones."""
    path = work_folder(x.spark, "sku-days")
    sold = star.dated_sales(x.spark, x.path)
    old, even = F.year("order_date") < 1996, F.col("sku").cast("bigint") % 2 == 0
    for number, part in enumerate([old, ~old & even, ~old & ~even], 1):
        incremental.add_delivery(sold.where(part), number, path)
    return path


@query
def incremental_sku_totals(x):
    return incremental.sku_totals(x.spark, delivered(x))


@query
def incremental_daily(x):
    return incremental.daily_totals(x.spark, delivered(x))


@query
def sku_ranks(x):
    """Rank and percentile of every SKU by its sales."""
    totals = star.sku_totals(x.spark, x.path).select("sku", "total_sales")
    return global_rank.global_rank(totals, F.desc("total_sales"), F.asc("sku"))


@query
def repeated_order_parts(x):
    """Pairs of order and part that occur on several lines, counted from repeated fingerprints alone."""
    return quality.repeated_keys(star.table(x.spark, x.path, "lineitem"), ["l_orderkey", "l_partkey"])
