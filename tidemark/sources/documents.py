"""The nested dashboard document and the live-operations document."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import round_even
from tidemark.schemas import DASHBOARD, LIVE_DOCUMENT


def dashboard_document(plan: DataFrame, heroes: DataFrame) -> DataFrame:
    """One row ``document``: campaigns by name, each with its ranked heroes.

    Heroes are already cut to the top n per campaign, so each list is n long at most.
    """
    hero = F.struct(
        "sku", "name", "category",
        F.struct(
            F.col("trend").alias("search_volume_trend"),
            F.col("age_days").cast("bigint").alias("inventory_age_days"),
            F.col("velocity").alias("demand_velocity"),
            F.col("pressure").alias("stock_pressure"),
            F.col("stockout_days"),
            F.col("lead_time_days").cast("bigint").alias("lead_time_days"),
            F.col("margin").alias("gross_margin_pct"),
        ).alias("metrics"),
        F.col("signal").alias("ai_signal"),
        F.col("priority_score"),
    )
    lists = heroes.groupBy("campaign").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", hero.alias("hero")))),
            lambda x: x["hero"],
        ).alias("hero_products")
    )
    entry = F.struct(
        F.coalesce(F.col("peak_date").cast("string"), F.lit("N/A")).alias("peak_date"),
        F.col("projected_volume"),
        round_even("planned_lift", 2).alias("campaign_lift_multiplier"),
        round_even("observed_lift", 2).alias("observed_lift_multiplier"),
        F.col("baseline_units").alias("avg_units_per_product_baseline"),
        F.coalesce("hero_products", F.array().cast(
            lists.schema["hero_products"].dataType)).alias("hero_products"),
        "strategy", "action_item", "status_color",
    )
    return (
        plan.join(lists, "campaign", "left")
        .agg(F.map_from_entries(F.collect_list(F.struct("campaign", entry))).alias("Campaigns"))
        .select(F.to_json(F.struct("Campaigns"), {"ignoreNullFields": "false"}).alias("document"))
    )


def write_dashboard(document: DataFrame, path: str) -> None:
    document.write.mode("errorifexists").text(path)


def read_dashboard_entries(spark: SparkSession, path: str) -> DataFrame:
    """One row per campaign of the document, heroes still nested."""
    doc = spark.read.schema(DASHBOARD).json(path, multiLine=True)
    return doc.select(F.explode("Campaigns").alias("campaign", "entry")).select(
        "campaign", "entry.*"
    )


def read_dashboard(spark: SparkSession, path: str) -> DataFrame:
    """One row per campaign and hero product; ``rank`` is the place in the list."""
    return (
        read_dashboard_entries(spark, path)
        .select("campaign", F.posexplode("hero_products").alias("position", "hero"))
        .select("campaign", (F.col("position") + 1).alias("rank"), "hero.*")
        .select("*", "metrics.*")
        .drop("metrics")
    )


def read_live_document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LIVE_DOCUMENT).json(path, multiLine=True)


def live_watchlist_rows(document: DataFrame) -> DataFrame:
    return document.select(F.inline("oosWatchlist"))


def live_critical_rows(document: DataFrame) -> DataFrame:
    return document.select(F.inline("criticalInterventions"))


def live_sales_rows(document: DataFrame) -> DataFrame:
    return document.select(F.inline("liveSalesHistory"))
