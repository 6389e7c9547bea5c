"""Writers for inventory, SKU mixes, SKU lists and accuracy reports."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.functions.scalars import round_even, trim_space
from tidemark.schemas import INVENTORY

MIX_HEADERS = ["Campaign", "Peak Date", "Projected Volume (USD)", "Category", "Strategy",
               "Action Item", "Rank", "SKU"]


def write_inventory_csv(inventory: DataFrame, path: str) -> None:
    """Quotes inside a quoted cell are doubled."""
    inventory.select(*INVENTORY.names).write.mode("errorifexists").csv(
        path, header=True, escape='"'
    )


def write_inventory_json(inventory: DataFrame, path: str) -> None:
    """One JSON record per line, nulls kept."""
    inventory.select(*INVENTORY.names).write.mode("errorifexists").json(
        path, ignoreNullFields=False
    )


def sku_mix(plan: DataFrame, heroes: DataFrame) -> DataFrame:
    """The eight export columns, as text, one row per campaign and hero."""
    return heroes.join(
        plan.select("campaign", "peak_date", "projected_volume", "strategy", "action_item"),
        "campaign",
    ).select(
        F.col("campaign").alias(MIX_HEADERS[0]),
        F.coalesce(F.col("peak_date").cast("string"), F.lit("N/A")).alias(MIX_HEADERS[1]),
        F.col("projected_volume").cast("string").alias(MIX_HEADERS[2]),
        F.coalesce("category", F.lit(fv.UNKNOWN_CATEGORY)).alias(MIX_HEADERS[3]),
        F.col("strategy").alias(MIX_HEADERS[4]),
        F.col("action_item").alias(MIX_HEADERS[5]),
        F.col("rank").cast("string").alias(MIX_HEADERS[6]),
        F.coalesce("sku", F.lit("")).alias(MIX_HEADERS[7]),
    )


def export_sku_mix(mix: DataFrame, path: str) -> None:
    """Every cell quoted, inner quotes doubled."""
    mix.write.mode("errorifexists").csv(path, header=True, quoteAll=True, escape='"')


def export_critical_skus(critical: DataFrame, path: str) -> None:
    """One non-empty SKU per line."""
    critical.select("sku").where(trim_space("sku") != "").write.mode("errorifexists").text(path)


def accuracy_report(overall: DataFrame, per_campaign: DataFrame, train, test) -> DataFrame:
    """One nested row: both windows, overall metrics and metrics per campaign (a few rows).

    ``train`` and ``test`` are pairs of date columns or literals.
    """
    def window(pair):
        start, end = (F.lit(v) if not hasattr(v, "cast") else v for v in pair)
        return F.struct(start.cast("string").alias("start"), end.cast("string").alias("end"))

    campaign_entries = per_campaign.agg(
        F.map_from_entries(F.collect_list(F.struct(
            "campaign",
            F.struct(
                F.col("n_weeks").alias("weeks"),
                round_even("mae", 2).alias("MAE"),
                round_even("rmse", 2).alias("RMSE"),
                round_even("mape", 2).alias("MAPE"),
                round_even("coverage", 1).alias("Coverage"),
            ),
        )))
    ).scalar()
    return overall.select(
        window(train).alias("train_window"),
        window(test).alias("test_window"),
        F.struct(
            round_even("mae", 2).alias("MAE ($)"),
            round_even("rmse", 2).alias("RMSE ($)"),
            round_even("mape", 2).alias("MAPE (%)"),
            round_even("coverage", 1).alias("Coverage (%)"),
            F.col("n_weeks").alias("Test weeks"),
        ).alias("overall"),
        campaign_entries.alias("per_campaign"),
    )


def write_accuracy_report(report: DataFrame, path: str) -> None:
    report.write.mode("errorifexists").json(path)
