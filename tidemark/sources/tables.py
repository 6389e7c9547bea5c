"""Relational tables: conforming rows to a schema and writing them."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schemas import TABLES


def conform(df: DataFrame, table: str) -> DataFrame:
    """The table's columns in order and type; absent columns are null, defaults filled."""
    spec = TABLES[table]
    columns = []
    for field in spec["schema"].fields:
        value = F.col(field.name) if field.name in df.columns else F.lit(None)
        value = value.cast(field.dataType)
        if field.name in spec["defaults"]:
            value = F.coalesce(value, F.lit(spec["defaults"][field.name]).cast(field.dataType))
        columns.append(value.alias(field.name))
    return df.select(*columns)


def write_table(df: DataFrame, table: str, path: str) -> None:
    """Write one relational table as parquet."""
    writer = conform(df, table).write.mode("errorifexists")
    writer.parquet(f"{path}/{table}")


def read_table(spark: SparkSession, table: str, path: str) -> DataFrame:
    return spark.read.schema(TABLES[table]["schema"]).parquet(f"{path}/{table}")


def save_sku_day(sku_day: DataFrame, name: str, buckets: int) -> None:
    """Keep the SKU-day table bucketed by SKU: later SKU windows and joins need no shuffle."""
    (
        sku_day.repartition(buckets, "sku")
        .write.bucketBy(buckets, "sku")
        .sortBy("sku", "order_date")
        .format("parquet")
        .mode("errorifexists")
        .saveAsTable(name)
    )
