"""Inventory synthesis, lookups and stock predicates."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.functions.scalars import as_col


def synth_inventory(rollup: DataFrame, as_of) -> DataFrame:
    """Inventory rows for the best-selling SKUs, by arithmetic on rank and key.

    Even ranks get low stock (1-99), odd ranks normal stock (100-1000). ``rollup`` is the
    output of ``sku_rollup`` with a limit, so the global rank sees that many rows.
    """
    rank = F.row_number().over(W.orderBy(F.desc("total_sales"), "sku")) - 1
    k = F.coalesce(F.col("sku").try_cast("bigint"), F.crc32(F.col("sku").cast("binary")))

    def mod(factor: int, modulus) -> Column:
        # The key is reduced first, or a long one would overflow.
        return F.pmod(F.pmod(F.col("k"), as_col(modulus)) * factor, as_col(modulus)).cast("int")

    on_hand = F.when(F.col("i") % 2 == 0, mod(37, F.lit(99)) + 1).otherwise(mod(59, F.lit(901)) + 100)
    reserve_cap = F.least(F.lit(50), F.floor(F.col("qty_on_hand") / F.lit(5)).cast("int")) + 1
    restock_age = mod(13, F.lit(41)) + 5 + F.when(F.col("k") % 10 == 0, 200).otherwise(0)

    def pick(names: list[str], factor: int) -> Column:
        return F.element_at(F.array(*[F.lit(x) for x in names]), mod(factor, F.lit(len(names))) + 1)

    return (
        rollup.withColumns({"i": rank, "k": k})
        .withColumn("qty_on_hand", on_hand)
        .select(
            "sku", "name", "category",
            pick(fv.WAREHOUSES, 1).alias("warehouse"),
            pick(fv.SUPPLIERS, 3).alias("supplier"),
            (F.lit(20.0) + mod(7919, F.lit(38001)) / F.lit(100.0)).alias("cost_price"),
            (F.lit(40.0) + mod(104729, F.lit(66001)) / F.lit(100.0)).alias("msrp"),
            "qty_on_hand",
            mod(17, reserve_cap).alias("qty_reserved"),
            (mod(29, F.lit(451)) + 50).alias("reorder_point"),
            F.date_sub(as_col(as_of), restock_age).alias("last_restock_date"),
            (mod(11, F.lit(12)) + 3).alias("lead_time_days"),
        )
    )


def one_row_per_sku(inventory: DataFrame) -> DataFrame:
    """The first row of each SKU: most recent restock, then lowest quantity, then warehouse, cost and
    price, then all other columns, so that no two different rows tie.

    Taken with a combinable minimum, so copies of a SKU never meet in one task.
    """
    others = [c for c in inventory.columns if c != "sku"]
    order = F.struct(
        F.coalesce(-F.unix_date("last_restock_date"), F.lit(2**31 - 1)).alias("a"),
        F.col("qty_on_hand").alias("b"),
        *[F.col(c).alias(f"c_{c}") for c in dict.fromkeys(["warehouse", "cost_price", "msrp", *others]) if c in others],
    )
    best = F.min_by(F.struct(*others), order).alias("row")
    return inventory.where("sku is not null").groupBy("sku").agg(best).select("sku", "row.*")


def with_available(inventory: DataFrame) -> DataFrame:
    """On hand less reserved, unclamped."""
    return inventory.withColumn("available_qty", F.col("qty_on_hand") - F.col("qty_reserved"))


def low_stock(inventory: DataFrame) -> DataFrame:
    return inventory.where("qty_on_hand <= reorder_point").select(
        "sku", "qty_on_hand", "reorder_point", "warehouse"
    )


def low_stock_count(inventory: DataFrame) -> DataFrame:
    return inventory.agg(F.count_if(F.expr("qty_on_hand <= reorder_point")).alias("low_stock_count"))


def lookup(inventory: DataFrame, key) -> DataFrame:
    """The row of one SKU, whatever the case of the key."""
    return with_available(inventory).where(F.col("sku") == F.upper(as_col(key)))


def bulk_lookup(inventory: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of the asked SKUs, one per SKU (``keys`` has a column ``sku``)."""
    asked = keys.select(F.upper("sku").alias("sku")).distinct()
    return with_available(inventory).join(asked, "sku", "left_semi").select(
        "sku", "warehouse", "cost_price", "msrp", "qty_on_hand", "qty_reserved",
        "available_qty", "lead_time_days",
    )


#: SKUs of one request at most.
MOST_KEYS = 10_000


def as_lookup_map(rows: DataFrame) -> DataFrame:
    """A bulk answer as one map by SKU. More than ``MOST_KEYS`` rows are no request and raise an error;
    no task gathers more than one above that."""
    fields = [c for c in rows.columns if c != "sku"]
    gathered = rows.limit(MOST_KEYS + 1).agg(F.collect_list(F.struct("sku", F.struct(*fields))).alias("entries"))
    too_many = F.raise_error(F.lit(f"more than {MOST_KEYS} SKUs in one request"))
    entries = F.when(F.size("entries") > MOST_KEYS, too_many).otherwise(F.map_from_entries("entries"))
    return gathered.select(entries.alias("inventory"))
