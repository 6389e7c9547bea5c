"""Scans of delivered sales and inventory files, with header and value cleaning."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.functions.scalars import first_present, trim_space
from tidemark.schemas import INVENTORY


def normalise_headers(df: DataFrame) -> DataFrame:
    """Strip and lower every header; blanks and hyphens become underscores."""
    return df.toDF(*[c.strip().lower().replace(" ", "_").replace("-", "_") for c in df.columns])


def pick_column(df: DataFrame, aliases: list[str], role: str) -> str:
    """The first alias that is a column of ``df``; an error before any job otherwise."""
    for alias in aliases:
        if alias in df.columns:
            return alias
    raise ValueError(f"no {role} column: expected one of {aliases}, found {df.columns}")


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")
    return df


def _read_csv(spark: SparkSession, paths: str | list[str], multi_line: bool) -> DataFrame:
    """CSV files as text columns with normalised headers.

    Every delivery (one path) has its own header; columns are matched by name and those that a
    delivery lacks are null there. ``multi_line`` allows line breaks inside quoted cells; a file is
    then read by one task.
    """
    out = None
    for path in [paths] if isinstance(paths, str) else paths:
        part = normalise_headers(spark.read.csv(
            path, header=True, encoding="utf-8", escape='"', multiLine=multi_line, enforceSchema=False))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no paths given")
    return out


def read_sales(spark: SparkSession, path: str | list[str], fmt: str = "csv", multi_line: bool = False) -> DataFrame:
    """Raw sales with normalised headers. CSV values stay text until ``clean_sales``.

    A folder whose files have different headers is an error; give such files one by one.
    """
    if fmt == "csv":
        raw = _read_csv(spark, path, multi_line)
    elif fmt == "json":
        raw = spark.read.json(path)
    elif fmt in ("parquet", "orc"):
        raw = spark.read.format(fmt).load(path)
    else:
        raise ValueError(f"unsupported format {fmt}")
    return normalise_headers(raw)


def clean_sales(raw: DataFrame) -> DataFrame:
    """Typed sales rows: bad dates, bad or non-positive amounts and empty SKUs are dropped."""
    date_col = pick_column(raw, fv.DATE_ALIASES, "date")
    sales_col = pick_column(raw, fv.SALES_ALIASES, "sales")
    sku_col = pick_column(raw, fv.SKU_ALIASES, "product id")
    names = [c for c in fv.NAME_ALIASES if c in raw.columns] or [sku_col]
    country = F.col("country") if "country" in raw.columns else F.lit(None)
    date_text = trim_space(F.col(f"`{date_col}`").cast("string"))
    return (
        raw.select(
            F.coalesce(
                F.to_date(F.try_to_timestamp(date_text)),
                F.to_date(F.try_to_timestamp(date_text, F.lit("M/d/yyyy"))),
            ).alias("order_date"),
            trim_space(F.col(f"`{sku_col}`").cast("string")).alias("sku"),
            trim_space(F.col(f"`{names[0]}`").cast("string")).alias("name"),
            first_present(fv.CATEGORY_ALIASES, raw.columns, fv.DEFAULT_CATEGORY).alias("category"),
            country.cast("string").alias("country"),
            F.trim(F.col(f"`{sales_col}`").cast("string")).try_cast("double").alias("sales"),
        )
        .where("order_date is not null and sales > 0 and sales < double('infinity') and sku <> ''")
    )


def read_inventory(spark: SparkSession, path: str | list[str], fmt: str = "csv", multi_line: bool = False) -> DataFrame:
    """Inventory rows; numbers and dates that cannot be read become null."""
    if fmt == "csv":
        raw = _read_csv(spark, path, multi_line)
    elif fmt == "json":
        # Both one record per line and one bracketed array per file.
        text = ", ".join(f"{c} string" for c in INVENTORY.names)
        raw = spark.read.schema(text).json(path, multiLine=False)
    else:
        raise ValueError(f"unsupported format {fmt}")
    require_columns(raw, ["sku"])

    def typed(field):
        if field.name not in raw.columns:
            return F.lit(None).cast(field.dataType).alias(field.name)
        text = F.trim(F.col(field.name))
        kind = field.dataType.typeName()
        if kind == "string":
            value = F.col(field.name)
        elif kind == "integer":
            value = text.try_cast("double").try_cast("int")
        elif kind == "date":
            value = F.to_date(F.try_to_timestamp(text))
        else:
            value = text.try_cast(field.dataType)
        return value.alias(field.name)

    return raw.select(*[typed(f) for f in INVENTORY.fields]).withColumn("sku", trim_space("sku"))
