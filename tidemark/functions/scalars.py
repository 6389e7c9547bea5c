"""Small scalar expressions shared by several operators."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import fixed_values as fv


WHITE_SPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def as_col(value) -> Column:
    """A column from a name, a Column or a plain literal that is not a name."""
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def clip(value, low: float, high: float) -> Column:
    """``value`` limited to a range; null stays null (least and greatest alone skip it)."""
    value = as_col(value)
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def or_default(value, default) -> Column:
    """``value``, but ``default`` when it is missing or zero."""
    return F.coalesce(F.nullif(as_col(value), F.lit(0)), F.lit(default))


def round_half_up(value) -> Column:
    """Nearest whole number, halves towards plus infinity."""
    return F.floor(as_col(value) + F.lit(0.5))


def round_even(value, digits: int) -> Column:
    return F.bround(as_col(value), digits)


def trim_space(value) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(as_col(value), F.lit(WHITE_SPACE))


def status_color(status) -> Column:
    return F.when(as_col(status) == "active", "green").otherwise("gray")


def display_name(name, sku, position) -> Column:
    """The trimmed name, else the SKU with blanks for underscores, else ``Product 0n``."""
    return F.coalesce(
        F.nullif(trim_space(name), F.lit("")),
        F.nullif(trim_space(F.replace(as_col(sku), F.lit("_"), F.lit(" "))), F.lit("")),
        F.concat(F.lit("Product "), F.lpad(as_col(position).cast("string"), 2, "0")),
    )


def cover_label(minutes) -> Column:
    """``17m remaining`` below an hour, else ``3h 15m``."""
    mins = as_col(minutes).cast("bigint")
    hours = F.floor(mins / F.lit(60)).cast("bigint")
    return F.when(
        mins < 60, F.concat(mins.cast("string"), F.lit("m remaining"))
    ).otherwise(
        F.concat(hours.cast("string"), F.lit("h "), (mins - hours * 60).cast("string"), F.lit("m"))
    )


def date_range_label(peak_date) -> Column:
    """The days around a peak, ``Jan 1 - Jan 7``; a dash when the peak is unknown."""
    peak = as_col(peak_date)
    return F.coalesce(
        F.concat(
            F.date_format(F.date_sub(peak, fv.RANGE_DAYS), "MMM d"),
            F.lit(" - "),
            F.date_format(F.date_add(peak, fv.RANGE_DAYS), "MMM d"),
        ),
        F.lit("—"),
    )


def first_present(columns: list[str], available: list[str], default: str) -> Column:
    """First non-empty of the listed columns that exist, else ``default``."""
    present = [F.nullif(trim_space(F.col(f"`{c}`")), F.lit("")) for c in columns if c in available]
    return F.coalesce(*present, F.lit(default))
