"""SKU-day totals that grow by deliveries, and totals read from them.

The table is kept by month. A delivery is added up by SKU and day, merged with the months that it
touches, and only these are written again; other months are neither read nor written. Amounts are kept
as exact whole units, so totals after any number of deliveries equal those over all lines at once, to
the last bit.

Deliveries have rising numbers and come one after the other. Each month remembers the number that it
holds last; a delivery that broke off is given again and goes on with the months it had not reached, and
one that is given twice changes nothing.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.exact import MONEY_SCALE, units, whole_sum
from tidemark.session import materialise

SCHEMA = "sku string, order_date date, units decimal(38,0), n_lines bigint, upto bigint, month int"


def _month(day: str):
    return (F.year(day) * 100 + F.month(day)).cast("int")


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows: one per SKU and day, by month."""
    return spark.read.schema(SCHEMA).parquet(path)


def _is_empty(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return not files.exists(folder)


def touched(spark: SparkSession, path: str, months: DataFrame) -> DataFrame:
    """Stored rows of the given ``months``; their partitions are picked while the query runs."""
    own = months.where("n_days > 0").select(F.col("month").alias("_month"))
    return stored(spark, path).join(own, F.col("month") == F.col("_month"), "left_semi")


def add_delivery(sales: DataFrame, number: int, path: str,
                 before_write: Callable[[DataFrame], None] | None = None) -> None:
    """Merge a delivery (``sku, order_date, sales``) into the table at ``path``.

    Lines without a SKU or day are no sales. ``before_write`` sees the merged rows of the months
    that will be written.
    """
    spark = sales.sparkSession
    sold = sales.select("sku", F.to_date("order_date").alias("order_date"), units("sales").alias("u")).where(
        "sku is not null and order_date is not null and u is not null")
    added = sold.groupBy("sku", "order_date").agg(
        whole_sum(F.col("u")).cast("decimal(38,0)").alias("units"), F.count(F.lit(1)).alias("n_lines"))
    added = materialise(added.withColumns({"upto": F.lit(number).cast("bigint"), "month": _month("order_date")}), "delivery")
    months = materialise(added.groupBy("month").agg(F.count(F.lit(1)).alias("n_days")), "delivery-months")
    if not _is_empty(spark, path):
        held = touched(spark, path, months)
        done = held.groupBy("month").agg(F.max("upto").alias("upto")).where(F.col("upto") >= number)
        added = added.join(done, "month", "left_anti")
        held = held.join(done, "month", "left_anti")
        added = held.unionByName(added)
    merged = added.groupBy("sku", "order_date", "month").agg(
        F.sum("units").cast("decimal(38,0)").alias("units"), F.sum("n_lines").alias("n_lines"))
    merged = materialise(merged.withColumn("upto", F.lit(number).cast("bigint")).select(
        *T._parse_datatype_string(SCHEMA).names), "merged")  # apart from the partitions that it replaces
    if before_write:
        before_write(merged)
    merged.repartition("month").sortWithinPartitions("month", "sku").write.partitionBy("month").mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").parquet(path)


def _amount(column: str = "units"):
    return F.sum(column).cast("double") / F.lit(10.0**MONEY_SCALE)


def sku_days(spark: SparkSession, path: str) -> DataFrame:
    """``(sku, order_date, sales, n_lines)``, as ``star.sku_day`` has them."""
    return stored(spark, path).select(
        "sku", "order_date", (F.col("units").cast("double") / F.lit(10.0**MONEY_SCALE)).alias("sales"), "n_lines")


def daily_totals(spark: SparkSession, path: str, first=None, last=None) -> DataFrame:
    """``(ds, y)``; with bounds (dates as text) only their months are read."""
    rows = stored(spark, path)
    if first:
        rows = rows.where(F.col("month") >= _month_of(first)).where(F.col("order_date") >= F.lit(first).cast("date"))
    if last:
        rows = rows.where(F.col("month") <= _month_of(last)).where(F.col("order_date") <= F.lit(last).cast("date"))
    return rows.groupBy(F.col("order_date").alias("ds")).agg(_amount().alias("y"))


def _month_of(day: str) -> int:
    return int(day[:4]) * 100 + int(day[5:7])


def sku_totals(spark: SparkSession, path: str) -> DataFrame:
    """``(sku, total_sales, n_lines, first_day, last_day)`` of every SKU."""
    return stored(spark, path).groupBy("sku").agg(
        _amount().alias("total_sales"), F.sum("n_lines").alias("n_lines"),
        F.min("order_date").alias("first_day"), F.max("order_date").alias("last_day"))
