"""Sums and means that do not depend on the order of the rows.

Adding doubles gives different last bits for every task layout, so a retried or
re-partitioned job would rank near-ties differently. Amounts are therefore kept to
``10**-scale`` as whole numbers. A sum adds their upper bits and their lowest 20 bits
apart (two plain long buffers, combined before the shuffle) and joins them once a group in
a wide decimal, which becomes a double. A group may hold 10**12 rows of usual amounts.
What is not finite, or has 2**73 whole units or more, is no amount and is left out.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY_SCALE = 4


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


#: What the bits that are added apart count.
_LOW = float(2**20)
_MOST = float(2**73)
_EXACT = float(2**53)


def whole(value: Column) -> Column:
    """The largest whole number not above a double; null if it is not finite or too large to be added."""
    fits = F.abs(value) < F.lit(_MOST)  # false for NaN, which is above all numbers
    floor = F.when(F.abs(value) < F.lit(_EXACT), F.floor(value).cast("double")).otherwise(value)
    return F.when(fits, floor)


def units(value, scale: int = MONEY_SCALE) -> Column:
    return whole(_col(value).cast("double") * F.lit(10.0**scale) + F.lit(0.5))


def whole_sum(value: Column) -> Column:
    """The exact sum of whole doubles as a decimal."""
    upper = F.floor(value / F.lit(_LOW))
    lower = (value - upper.cast("double") * F.lit(_LOW)).cast("bigint")
    return F.sum(upper).cast("decimal(20,0)") * F.lit(int(_LOW)).cast("decimal(8,0)") + F.sum(lower)


def exact_sum(value, scale: int = MONEY_SCALE) -> Column:
    return whole_sum(units(value, scale)).cast("double") / F.lit(10.0**scale)


def exact_mean(value, scale: int = MONEY_SCALE) -> Column:
    return exact_sum(value, scale) / F.count(units(value, scale))


def exact_rms(value, scale: int = 2) -> Column:
    """Root of the mean square; squares of whole units are added as wide decimals."""
    own = units(value, scale).cast("decimal(19,0)")
    total = F.sum((own * own).cast("decimal(38,0)")).cast("double")
    return F.sqrt(total / F.count(_col(value))) / F.lit(10.0**scale)
