"""Canonical sales, SKU-day and event tables from the star-schema parquet files."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.exact import exact_sum
from tidemark.schemas import EVENTS, STAR

#: A sold line; NaN is above all numbers and so is no sale.
SOLD = "l_extendedprice > 0 and l_extendedprice < double('infinity')"


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(STAR[name]).parquet(f"{path}/{name}.parquet")


def _dated_lines(spark: SparkSession, path: str, *order_columns: str, skus=None) -> DataFrame:
    lines = table(spark, path, "lineitem").where(SOLD).select(
        "l_orderkey", "l_partkey", "l_extendedprice"
    )
    if skus is not None:
        keys = skus.select(F.col("sku").try_cast("bigint").alias("l_partkey"))
        lines = lines.join(keys, "l_partkey", "left_semi")
    orders = table(spark, path, "orders").select(
        "o_orderkey", F.to_date("o_orderdate").alias("order_date"), *order_columns
    )
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def sales(spark: SparkSession, path: str) -> DataFrame:
    """One row per order line with product and country columns."""
    part = table(spark, path, "part").select("p_partkey", "p_name", "p_type")
    customer = table(spark, path, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, path, "nation").select("n_nationkey", "n_name")
    return (
        _dated_lines(spark, path, "o_custkey")
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            "order_date",
            F.col("l_partkey").cast("string").alias("sku"),
            F.col("p_name").alias("name"),
            F.col("p_type").alias("category"),
            F.col("n_name").alias("country"),
            F.col("l_extendedprice").alias("sales"),
        )
    )


def dated_sales(spark: SparkSession, path: str, category: bool = False) -> DataFrame:
    """Order lines with their day, and the category if asked; no other table is joined."""
    lines = _dated_lines(spark, path)
    columns = ["order_date", F.col("l_partkey").cast("string").alias("sku"), F.col("l_extendedprice").alias("sales")]
    if category:
        part = table(spark, path, "part").select("p_partkey", F.col("p_type").alias("category"))
        lines = lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
        columns.append("category")
    return lines.select(*columns)


def daily(spark: SparkSession, path: str) -> DataFrame:
    """Total sales per day ``(ds, y)`` without touching the product tables.

    Lines are added per order first, so an order that owns a large share of all lines
    reaches the join as one row per map task.
    """
    per_order = (
        table(spark, path, "lineitem")
        .where(SOLD)
        .groupBy("l_orderkey")
        .agg(exact_sum("l_extendedprice").alias("amount"))
    )
    orders = table(spark, path, "orders").select(
        "o_orderkey", F.to_date("o_orderdate").alias("ds")
    )
    return (
        per_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("ds")
        .agg(exact_sum("amount").alias("y"))
    )


def _per_part(lines: DataFrame, *parts) -> DataFrame:
    return lines.groupBy("l_partkey", *parts).agg(
        exact_sum("l_extendedprice").alias("sales"), F.count(F.lit(1)).alias("n_lines")
    )


def _with_category(spark: SparkSession, path: str, per_part: DataFrame, *parts: str) -> DataFrame:
    part = table(spark, path, "part").select("p_partkey", F.col("p_type").alias("category"))
    return per_part.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_partkey").cast("string").alias("sku"), "category", *parts, "sales", "n_lines"
    )


def sku_day_totals(spark: SparkSession, path: str) -> DataFrame:
    """Sales and line counts per SKU and day, the SKU still as a number: it halves the
    shuffle of the many narrow rows."""
    return _per_part(_dated_lines(spark, path), "order_date").withColumnRenamed("l_partkey", "sku")


def sku_day(spark: SparkSession, path: str, skus: DataFrame | None = None) -> DataFrame:
    """SKU-day rows with the category; products are joined after the grouping. With
    ``skus`` the lines of other SKUs are dropped at the scan, before orders are joined."""
    days = _per_part(_dated_lines(spark, path, skus=skus), "order_date")
    return _with_category(spark, path, days, "order_date")


def sku_month(spark: SparkSession, path: str) -> DataFrame:
    """Sales and line counts per SKU and calendar month (1-12, all years together)."""
    lines = _dated_lines(spark, path).withColumn("month", F.month("order_date"))
    return _with_category(spark, path, _per_part(lines, "month"), "month")


def products(spark: SparkSession, path: str) -> DataFrame:
    return table(spark, path, "part").select(
        F.col("p_partkey").cast("string").alias("sku"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("category"),
    )


def cut_off(spark: SparkSession, path: str) -> Column:
    """The last order date, as a scalar subquery (nothing is collected)."""
    orders = table(spark, path, "orders")
    return orders.agg(F.to_date(F.max("o_orderdate"))).scalar()


def _event_columns(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").try_cast("bigint").cast("string").alias("sku"),
    )


def events(spark: SparkSession, path: str) -> DataFrame:
    return _event_columns(table(spark, path, "events"))


def event_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None, glob: bool = True) -> DataFrame:
    """The events file (or a folder filling up with such files) as a stream; without ``glob`` all files there."""
    reader = spark.readStream.schema(EVENTS)
    if glob:
        reader = reader.option("pathGlobFilter", "events*.parquet")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return _event_columns(reader.parquet(path))


def sku_totals(spark: SparkSession, path: str) -> DataFrame:
    """Total sales per SKU with product columns, returns included; orders are not needed for it."""
    per_part = (
        table(spark, path, "lineitem")
        .where("l_extendedprice < double('infinity')")
        .groupBy("l_partkey")
        .agg(exact_sum("l_extendedprice").alias("total_sales"))
        .withColumn("sku", F.col("l_partkey").cast("string"))
    )
    return per_part.join(products(spark, path), "sku").select(
        "sku", "total_sales", "name", "category"
    )
