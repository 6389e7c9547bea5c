"""SKU-day totals and everything derived from them per SKU."""

import re

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.functions.exact import exact_sum
from tidemark.functions.scalars import as_col
from tidemark.functions.stock import stock_metrics
from tidemark.operators.campaigns import in_campaign_month
from tidemark.operators.inventory import one_row_per_sku


def sku_day(sales: DataFrame) -> DataFrame:
    """Sales and line counts per SKU, category and day.

    The first and only pass over raw sales: it combines map-side, so a SKU holding a
    large share of all lines becomes one row per day before anything is partitioned by SKU.
    """
    return sales.groupBy("sku", "category", "order_date").agg(
        exact_sum("sales").alias("sales"), F.count(F.lit(1)).alias("n_lines")
    )


def sku_demand(days: DataFrame) -> DataFrame:
    """Order dates, line count and recent and earlier sales of each SKU.

    Recent: the 90 days up to the SKU's own last order. Base: the 90 days before those. The
    SKU may come as text or number; it leaves as text.
    """
    c = F.col
    last = F.max("order_date").over(W.partitionBy("sku"))
    recent = c("order_date") >= F.date_sub("last", fv.RECENT_DAYS)
    base = (c("order_date") >= F.date_sub("last", fv.BASE_DAYS)) & ~recent
    return (
        days.withColumn("last", last)
        .groupBy("sku")
        .agg(
            F.min("order_date").alias("first_order"),
            F.max("order_date").alias("last_order"),
            F.sum("n_lines").alias("n_lines"),
            exact_sum(F.when(recent, c("sales"))).alias("recent_sales"),
            F.sum(F.when(recent, c("n_lines"))).alias("recent_lines"),
            F.datediff(F.max("order_date"), F.min(F.when(recent, c("order_date")))).alias("recent_days"),
            F.coalesce(exact_sum(F.when(base, c("sales"))), F.lit(0.0)).alias("base_sales"),
        )
        .withColumn("sku", c("sku").cast("string"))
    )


def sku_metrics(days: DataFrame, inventory: DataFrame, as_of) -> DataFrame:
    """Metrics, signal and health per SKU; they do not depend on a campaign."""
    stock = one_row_per_sku(inventory).select(
        "sku", "cost_price", "msrp", "qty_on_hand", "qty_reserved", "reorder_point",
        "last_restock_date", "lead_time_days",
    )
    return stock_metrics(sku_demand(days).join(stock, "sku", "left"), as_of)


def keyword_match(keywords="keywords", *text_columns: str) -> Column:
    """True when the list is empty or holds ``All``, or when a keyword occurs in a column.

    Case is ignored; dots and plus signs in keywords are literal.
    """
    words = as_col(keywords)
    dotted = F.transform(words, lambda k: F.replace(F.replace(k, F.lit("+"), F.lit("\\+")),
                                                    F.lit("."), F.lit("\\.")))
    pattern = F.concat(F.lit("(?iu)"), F.array_join(dotted, "|"))
    hit = F.lit(False)
    for name in text_columns or ("category", "sku"):
        hit = hit | F.coalesce(F.rlike(F.col(name), pattern), F.lit(False))
    open_list = F.coalesce(
        (F.size(words) <= 0) | F.array_contains(words, fv.UNFILTERED_KEYWORD), F.lit(True)
    )
    return open_list | hit


def keyword_filter(df: DataFrame, keywords: list[str] | None) -> DataFrame:
    """Rows whose category or SKU matches one of the keywords; all rows if they make no valid pattern.

    The pattern is one literal, so it is compiled once.
    """
    if not keywords or fv.UNFILTERED_KEYWORD in keywords:
        return df
    pattern = "|".join(k.replace("+", "\\+").replace(".", "\\.") for k in keywords)
    try:
        re.compile(pattern)
        df.sparkSession.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except (re.error, Py4JJavaError):
        return df
    hit = [F.coalesce(F.rlike(F.col(name), F.lit("(?iu)" + pattern)), F.lit(False)) for name in ("category", "sku")]
    return df.where(hit[0] | hit[1])


def modal_value(df: DataFrame, keys: list[str], column: str, weight=None) -> DataFrame:
    """Most frequent non-null value per key; the smallest wins a tie.

    Counted per value first, so the second grouping sees one row per distinct value.
    """
    n = F.sum(weight) if weight is not None else F.count(F.lit(1))
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(n.alias("n"))
    return counts.groupBy(*keys).agg(
        F.min_by(column, F.struct(-F.col("n"), F.col(column))).alias(column)
    )


def first_value(sales: DataFrame, column: str) -> DataFrame:
    """A SKU's value on its earliest order day (smallest text among that day's)."""
    seen = (
        sales.where(F.col(column).isNotNull())
        .groupBy("sku", column)
        .agg(F.min("order_date").alias("day"))
    )
    return seen.groupBy("sku").agg(F.min_by(column, F.struct("day", column)).alias(column))


def sku_rollup(sales: DataFrame, n: int | None = fv.TOP_SKUS) -> DataFrame:
    """Total sales, first name and first category per SKU; the best-selling ``n``.

    Raw rows meet numbers-only buffers (hash aggregation); the text picks that need
    sorting see one row per SKU, name and category.
    """
    variants = sales.groupBy("sku", "name", "category").agg(
        exact_sum("sales").alias("sales"), F.min("order_date").alias("day")
    )
    totals = variants.groupBy("sku").agg(
        exact_sum("sales").alias("total_sales"),
        F.min_by("name", F.struct("day", "name")).alias("name"),
        F.min_by("category", F.struct("day", "category")).alias("category"),
    )
    return top_skus(totals, n)


def top_skus(totals: DataFrame, n: int | None, by: str = "total_sales") -> DataFrame:
    return totals if n is None else totals.orderBy(F.desc(by), "sku").limit(n)


def month_totals(days: DataFrame, config: DataFrame) -> DataFrame:
    """Per campaign and SKU: sales in the campaign's month and sales of the rows that match
    the campaign's keywords (null when none does). Numbers only, so both groupings hash."""
    c = F.col
    # The keyword lists join again after the grouping: they would widen every shuffled row.
    cells = (
        in_campaign_month(days, config)
        .groupBy("campaign", "sku", "category")
        .agg(exact_sum("sales").alias("sales"))
        .join(config.select("campaign", "keywords"), "campaign")
        .withColumn("matches", keyword_match())
    )
    return cells.groupBy("campaign", "sku").agg(
        exact_sum("sales").alias("total"),
        exact_sum(F.when(c("matches"), c("sales"))).alias("matched"),
    )


def month_category(days: DataFrame, config: DataFrame) -> DataFrame:
    """The modal category of each campaign and SKU in the campaign's month."""
    return modal_value(in_campaign_month(days, config), ["campaign", "sku"], "category", F.col("n_lines"))


def month_topk(totals: DataFrame, k: int, by: str = "total") -> DataFrame:
    """The best ``k`` SKUs of each campaign. The rank filter is applied per task before
    the shuffle, so no campaign is gathered whole."""
    w = W.partitionBy("campaign").orderBy(F.desc(by), "sku")
    return (
        totals.where(F.col(by).isNotNull())
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
    )


def candidates(totals: DataFrame, n: int = fv.HERO_COUNT) -> DataFrame:
    """Candidate SKUs per campaign: the top of the keyword matches and, where those are
    fewer than ``n``, the top ``2n`` of the month as well."""
    c = F.col
    n_matched, n_spare = max(5 * n, fv.MIN_CANDIDATES), 2 * n
    # Both rankings come from one pass: each SKU stands for election twice.
    entries = F.array(
        F.struct(F.lit(1).alias("is_main"), c("matched").alias("votes")),
        F.struct(F.lit(0).alias("is_main"), c("total").alias("votes")),
    )
    order = W.partitionBy("campaign", "is_main").orderBy(F.desc("votes"), "sku")
    best = (
        totals.select("campaign", "sku", "total", F.inline(entries))
        .where(c("votes").isNotNull())
        .withColumn("place", F.row_number().over(order))
        .where(c("place") <= max(n_matched, n_spare))
        .where(c("place") <= F.when(c("is_main") == 1, n_matched).otherwise(n_spare))
    )
    # At most max(5n, 30) + 2n rows per campaign from here on; the month's best is among them.
    merged = best.groupBy("campaign", "sku", "total").agg(F.max("is_main").alias("is_main"))
    group = W.partitionBy("campaign")
    return (
        merged.withColumns({
            "n_main": F.sum("is_main").over(group),
            "best_total": F.max("total").over(group),
        })
        .where((c("is_main") == 1) | (c("n_main") < n))
        .select(
            "campaign", "sku", "total", "best_total", (c("is_main") == 0).alias("is_fallback"),
        )
    )
