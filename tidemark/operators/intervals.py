"""Range joins: points in time against windows, for calendars of any size.

Both sides are dealt to cells of time and meet by an equi-join, then the bounds are tested. A window
takes cells of the first power of two above its own length, so it touches one cell or two, however
long it is; a point looks into one cell of each length that windows have (64 at most). A pair meets
once. No window is compared with points of other cells, and nothing is inlined or broadcast by hint.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import as_col


def _number(column: str, df: DataFrame) -> Column:
    """A date as days, a time as microseconds, anything else as a whole number."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("bigint")
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return F.unix_micros(F.col(column).cast("timestamp"))
    return F.col(column).cast("bigint")


def _level(low: Column, high: Column) -> Column:
    """Bits of the window's length, so that cells of ``2 ** level`` are longer than the window."""
    return F.when(high == low, 0).otherwise(F.length(F.bin(high - low)))


def points_in_windows(points: DataFrame, windows: DataFrame, at: str = "ds", start: str = "window_start",
                      end: str = "window_end") -> DataFrame:
    """Every pair of a point and a window with ``start <= at <= end``, with the columns of both.

    Columns of the two sides must differ in name. Nulls, and windows that end before they begin, meet
    nothing. Rows that repeat meet each by itself.
    """
    clash = set(points.columns) & set(windows.columns)
    if clash:
        raise ValueError(f"both sides have {sorted(clash)}")
    low, high = F.col("_low"), F.col("_high")
    dealt = windows.withColumns({"_low": _number(start, windows), "_high": _number(end, windows)}).where("_low <= _high")
    dealt = dealt.withColumn("_level", _level(low, high).cast("int"))
    cell = lambda value: F.expr(f"shiftright({value}, _level)")
    dealt = dealt.withColumn("_cell", F.explode(F.array_distinct(F.array(cell("_low"), cell("_high")))))
    levels = windows.select(_number(start, windows).alias("_low"), _number(end, windows).alias("_high")).where(
        "_low <= _high").agg(F.collect_set(_level(low, high).cast("int"))).scalar()
    placed = points.withColumn("_at", _number(at, points)).where("_at is not null")
    placed = placed.withColumn("_level", F.explode(levels)).withColumn("_cell", cell("_at"))
    met = placed.join(dealt, ["_level", "_cell"]).where((low <= F.col("_at")) & (F.col("_at") <= high))
    return met.select(*points.columns, *windows.columns)


def flag_points(points: DataFrame, windows: DataFrame, flag: str = "is_inside", at: str = "ds",
                start: str = "window_start", end: str = "window_end") -> DataFrame:
    """The points with whether any window holds them; each distinct time is looked up once."""
    times = points.select(F.col(at).alias("_time")).distinct()
    inside = points_in_windows(times, windows.select(start, end), "_time", start, end).select("_time").distinct()
    inside = inside.withColumn(flag, F.lit(True))
    return points.join(inside, as_col(at) == F.col("_time"), "left").select(
        *points.columns, F.coalesce(flag, F.lit(False)).alias(flag))
