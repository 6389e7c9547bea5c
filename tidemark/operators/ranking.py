"""Hero products: candidates, metrics and the final rank."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.functions.scalars import as_col, round_even
from tidemark.functions.stock import priority_score, rounded_metrics
from tidemark.operators.demand import (
    candidates, month_category, month_totals, sku_metrics,
)
from tidemark.session import materialise


def hero_products(days: DataFrame, products: DataFrame, inventory: DataFrame, config: DataFrame,
                  as_of, n: int = fv.HERO_COUNT, rounded: bool = True, months=None,
                  days_of=None) -> DataFrame:
    """The top ``n`` products of each campaign by priority score.

    ``days`` are SKU-day rows, ``products`` has one row per SKU with its name. Metrics are
    computed for candidate SKUs only. A source may offer shorter ways than ``days``:
    ``months``, rows grouped by month already, and ``days_of``, the SKU-day rows of a small
    SKU table. With ``rounded`` metrics and score are rounded before ranking, as published;
    without it the ranking uses full precision.
    """
    c = F.col
    # The rows are read three times and cost a full scan, so they are written once. Their size
    # is known then, and Spark broadcasts what is small enough.
    totals = month_totals(days if months is None else months, config)
    chosen = materialise(candidates(totals, n), "candidates")
    chosen_skus = chosen.select("sku").distinct()
    picked = days_of(chosen_skus) if days_of else days.join(chosen_skus, "sku", "left_semi")
    # One row per candidate SKU, category and day, read for metrics and for categories.
    chosen_days = materialise(picked, "candidate-days")
    metrics = sku_metrics(chosen_days, inventory, as_of)
    if rounded:
        metrics = rounded_metrics(metrics)
    categories = month_category(chosen_days, config)
    names = products.select("sku", "name").join(chosen_skus, "sku", "left_semi")
    scored = (
        chosen.join(metrics, "sku")
        .join(names, "sku", "left")
        .join(categories, ["campaign", "sku"], "left")
        .withColumns({
            "name": F.coalesce("name", "sku"),
            "category": F.coalesce("category", F.lit(fv.DEFAULT_CATEGORY)),
        })
        .withColumn("priority_score", priority_score(c("total") / c("best_total")))
    )
    if rounded:
        scored = scored.withColumn("priority_score", round_even("priority_score", 3))
    order = W.partitionBy("campaign").orderBy(F.desc("priority_score"), F.desc("total"), "sku")
    return scored.withColumn("rank", F.row_number().over(order)).where(c("rank") <= n).select(
        "campaign", "rank", "sku", "name", "category", "total", "trend", "age_days", "velocity",
        "pressure", "stockout_days", "lead_time_days", "margin", "health", "signal",
        "priority_score",
    )


def top_movers(heroes: DataFrame, n: int = 5) -> DataFrame:
    return heroes.where(F.col("rank") <= n)


def newest(df: DataFrame, n: int = fv.TICKER_ROWS, time: str = "ts", tie: str = "event_id") -> DataFrame:
    return df.orderBy(F.desc(time), F.desc(tie)).limit(n)


def is_critical(minutes="eta_oos_mins") -> Column:
    return as_col(minutes) < fv.CRITICAL_MINUTES
