"""SKU metrics, signals and scores as column expressions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.functions.scalars import as_col, clip, round_even


def available_quantity(on_hand="qty_on_hand", reserved="qty_reserved") -> Column:
    """On hand less reserved, not below zero; missing when on hand is missing."""
    left = (as_col(on_hand) - as_col(reserved)).cast("double")
    return F.when(as_col(on_hand).isNotNull(), F.greatest(F.lit(0.0), left))


def stock_metrics(demand: DataFrame, as_of) -> DataFrame:
    """Add trend, age, velocity, stock, margin, signal and health to SKU demand rows.

    ``demand`` holds the output of ``sku_demand`` left-joined with one inventory row per
    SKU; every inventory column may be missing.
    """
    c = F.col
    base = F.when(c("base_sales") > 0, c("base_sales")).otherwise(F.lit(1.0))
    selling_days = F.greatest(F.datediff("last_order", "first_order"), F.lit(1))
    recent_span = F.greatest(c("recent_days"), F.lit(1))
    restock_age = F.datediff(as_col(as_of), c("last_restock_date"))
    return (
        demand.withColumns({
            "trend": F.least(F.lit(1.0), c("recent_sales") / base),
            "age_days": F.coalesce(restock_age, F.datediff("last_order", "first_order")),
            "velocity": F.least(F.lit(1.0), c("n_lines") / selling_days / F.lit(10.0)),
            "available": available_quantity(),
            "daily_units": F.greatest(F.lit(0.1), c("recent_lines") / recent_span),
            "margin": F.when(
                (c("msrp") > 0) & c("cost_price").isNotNull(),
                clip((c("msrp") - c("cost_price")) / F.nullif(c("msrp"), F.lit(0.0)), -1.0, 1.0),
            ).otherwise(F.lit(fv.DEFAULT_MARGIN)),
        })
        .withColumns({
            "pressure_raw": F.when(c("reorder_point") > 0,
                                   c("available") / F.nullif(c("reorder_point"), F.lit(0))),
            "stockout_days": c("available") / c("daily_units"),
            "low_margin": c("margin") < fv.LOW_MARGIN,
        })
        .withColumns({
            # least() skips nulls, so a missing ratio needs its own branch.
            "pressure": F.when(c("pressure_raw").isNull(), F.lit(fv.DEFAULT_PRESSURE))
            .otherwise(F.least(F.lit(1.0), c("pressure_raw"))),
            "stockout_risk": F.coalesce(c("stockout_days") < c("lead_time_days"), F.lit(False)),
        })
        .withColumns({"signal": signal(), "health": health()})
    )


def signal() -> Column:
    """The first label whose rule holds."""
    c = F.col
    return (
        F.when(c("stockout_risk") & (c("trend") > 0.6), fv.SIGNAL_STOCKOUT)
        .when(c("low_margin"), fv.SIGNAL_MARGIN)
        .when(c("trend") > 0.75, fv.SIGNAL_TRENDING)
        .when((c("age_days") > 180) & (c("pressure_raw") > 1.0), fv.SIGNAL_AGING)
        .otherwise(fv.SIGNAL_ORGANIC)
    )


def health() -> Column:
    """Stock and margin blended, marked down for stockout risk and for low margin."""
    c = F.col
    blend = (F.lit(0.55) * clip("pressure", 0.0, 1.0)
             + F.lit(0.45) * clip(c("margin") / F.lit(0.40), 0.0, 1.0))
    return (
        blend
        * F.when(c("stockout_risk"), F.lit(0.65)).otherwise(F.lit(1.0))
        * F.when(c("low_margin"), F.lit(0.70)).otherwise(F.lit(1.0))
    )


def rounded_metrics(metrics: DataFrame) -> DataFrame:
    """Round and cap the metrics the way they are published."""
    return metrics.withColumns({
        "trend": round_even("trend", 2),
        "age_days": F.least(F.col("age_days"), F.lit(365)),
        "velocity": round_even("velocity", 2),
        "pressure": round_even("pressure", 2),
        "stockout_days": round_even("stockout_days", 1),
        "margin": round_even("margin", 2),
        "health": round_even("health", 3),
    })


def priority_score(sales_share, trend="trend", velocity="velocity", health="health") -> Column:
    w = fv.SCORE_WEIGHTS
    return (
        F.lit(w["sales"]) * as_col(sales_share)
        + F.lit(w["trend"]) * as_col(trend)
        + F.lit(w["velocity"]) * as_col(velocity)
        + F.lit(w["health"]) * as_col(health)
    )
