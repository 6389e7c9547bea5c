"""Ranks over a whole table of any size, without a window over all rows.

Rows are dealt to ranges of the order and sorted there; a row's place in its range and the sizes of the
ranges before it give its rank. Only the sizes of the ranges, one number a task, pass through the driver.
"""

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialise

#: What ``monotonically_increasing_id`` counts within a task, below the task's number.
_PLACE_BITS = 33


def global_rank(df: DataFrame, *order: Column, parts: int | None = None, rank: str = "rank",
                percentile: str | None = "percentile") -> DataFrame:
    """``df`` with each row's rank by ``order`` (from 1) and, from 0 to 1, its share of ranks below.

    The order should end with a key, which settles ties; ties beyond it are ranked in some order. A
    table of one row has percentile 0.
    """
    spark = df.sparkSession
    number = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = materialise(df, "to-rank")  # read twice: ranges are sampled first
    dealt = rows.repartitionByRange(number, *order).sortWithinPartitions(*order)
    dealt = materialise(dealt.withColumn("_id", F.monotonically_increasing_id()), "ranked")
    place = dealt.withColumns({
        "_part": F.shiftright("_id", _PLACE_BITS).cast("int"), "_place": F.col("_id").bitwiseAND(F.lit(2**_PLACE_BITS - 1))})
    sizes = {r["_part"]: r["n"] for r in place.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before = dict(zip(sorted(sizes), accumulate((sizes[p] for p in sorted(sizes)), initial=0), strict=False))
    total = sum(sizes.values())
    offsets = spark.createDataFrame([(p, n) for p, n in before.items()], "_part int, _before bigint")
    ranked = place.join(offsets, "_part").withColumn(rank, F.col("_before") + F.col("_place") + 1)
    columns = [*df.columns, rank]
    if percentile:
        ranked = ranked.withColumn(percentile, (F.col(rank) - 1) / F.lit(float(max(total - 1, 1))))
        columns.append(percentile)
    return ranked.select(*columns)
