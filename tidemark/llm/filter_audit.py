"""What each of several quality filters removes, alone, in every order, and as its Shapley share.

A filter is a bit of a document's mask, set where the document fails it. Documents are counted by
part and mask; from these counts the removal v(S) of every coalition S of filters is tabulated:
the documents that fail a filter of S. All else is read from the tables of a part:

* A step of an order removes v(before and this filter) - v(before).
* The Shapley shares are the weights p of a linear game that fits v best under the kernel weights
  (m - 1) / (C(m, s) s (m - s)) for coalitions of s of m filters, with the p adding up to v(all)
  (`Shares`). The normal equations with this constraint do not depend on the data but for their
  right side, so they are inverted once, in rationals; shares are exact and m! times a share is a
  whole number.

The text is read once. Which document of equal texts comes first is found by a grouping on the
text's SHA-256 and joined back on digest and id together, so equal texts do not meet in one task.

Nulls and oddities: a null text is empty, a null part the empty string. A row with a null id is
nobody's copy, makes none, and has no labels. Rows that repeat the smallest id of a text are not
copies. Of repeated labels any that says so counts; null labels say nothing. Empty tables give empty
results. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from itertools import permutations
from math import comb, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import staging

#: The rules of `failures`, in the order of their bits; the last one is judged over the whole table.
LETTERS = "ABCDE"
_LEAST_WORDS, _DISTINCT_PERCENT, _CAPITAL_PERCENT = 200, 50, 2
_SPACE, _SYMBOL = r"[\x20\x09-\x0D]+", "[#$%&*|]"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class Shares:
    """Kernel-weighted least squares with the efficiency constraint, for m filters."""

    def __init__(self, m: int):
        self.m = m
        self.weights = [Fraction(0)] * (1 << m)
        for s in range(1, (1 << m) - 1):
            k = s.bit_count()
            self.weights[s] = Fraction(m - 1, comb(m, k) * k * (m - k))
        rows = [[sum((self.weights[s] for s in range(1 << m) if s >> i & 1 and s >> j & 1), Fraction(0)) for j in range(m)]
                + [Fraction(1)] for i in range(m)]
        self.inverse = self._inverted([*rows, [Fraction(1)] * m + [Fraction(0)]])

    @staticmethod
    def _inverted(matrix: list[list[Fraction]]) -> list[list[Fraction]]:
        """Gauss-Jordan elimination."""
        n = len(matrix)
        rows = [[*row, *(Fraction(i == j) for j in range(n))] for i, row in enumerate(matrix)]
        for c in range(n):
            pivot = next(r for r in range(c, n) if rows[r][c])
            rows[c], rows[pivot] = rows[pivot], rows[c]
            rows[c] = [x / rows[c][c] for x in rows[c]]
            for r in range(n):
                if r != c and rows[r][c]:
                    rows[r] = [x - rows[r][c] * y for x, y in zip(rows[r], rows[c], strict=True)]
        return [row[n:] for row in rows]

    def of(self, removed: list[int]) -> list[Fraction]:
        """The share of each filter, from the removals of all coalitions."""
        right = [sum((self.weights[s] * v for s, v in enumerate(removed) if s >> i & 1), Fraction(0)) for i in range(self.m)]
        right.append(Fraction(removed[-1] - removed[0]))
        return [sum((a * b for a, b in zip(row, right, strict=True)), Fraction(0)) for row in self.inverse[:self.m]]


@lru_cache(8)
def shares(m: int) -> Shares:
    return Shares(m)


def _first_rules(text: Column) -> Column:
    """Bits of the rules that look at one text only."""
    words = F.array_remove(F.split(text, _SPACE), "")
    n_words, n_distinct = F.size(words), F.size(F.array_distinct(words))
    length = F.length(text).cast("bigint")
    capitals = length - F.length(F.translate(text, _CAPITALS, ""))
    rules = [
        n_words < _LEAST_WORDS, 100 * n_distinct.cast("bigint") < _DISTINCT_PERCENT * n_words,
        100 * capitals > _CAPITAL_PERCENT * length, text.rlike(_SYMBOL)]
    return sum((F.when(rule, 1 << i).otherwise(0) for i, rule in enumerate(rules)), F.lit(0))


def failures(documents: DataFrame) -> DataFrame:
    """(doc_id, part, mask) of every row: the filters of LETTERS that it fails."""
    plain = staging.plain(documents, {"doc_id": "bigint", "text": "string", "source": "string"})
    text = F.coalesce("text", F.lit(""))
    rows = staging.stage(plain.select(
        "doc_id", F.coalesce("source", F.lit("")).alias("part"), _first_rules(text).alias("mask"),
        F.unhex(F.sha2(text, 256)).alias("digest")))
    known = rows.where("doc_id is not null")
    firsts = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    later = known.join(firsts, ["digest", "doc_id"], "left")
    copy = F.when(F.col("first"), 0).otherwise(1 << len(LETTERS) - 1)
    return later.select("doc_id", "part", (F.col("mask") + copy).alias("mask")).unionAll(
        rows.where("doc_id is null").select("doc_id", "part", "mask"))


def tables(masks: DataFrame, labels: DataFrame, m: int) -> DataFrame:
    """(part, total, removed, good, toxic): removals of all coalitions of m filters, in each part.

    masks: doc_id, part, mask. The arrays hold one number a coalition, in the order of its bits.
    """
    says = lambda name: F.coalesce(F.max(F.col(name) == 1), F.lit(False)).cast("int")
    marks = staging.plain(labels, {"doc_id": "bigint", "quality": "int", "toxic": "int"}).where(
        "quality = 1 or toxic = 1").groupBy("doc_id").agg(says("quality").alias("good"), says("toxic").alias("toxic"))
    known = masks.where("doc_id is not null").join(marks, "doc_id", "left").select("part", "mask", "good", "toxic")
    nameless = masks.where("doc_id is null").select("part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    cells = known.unionAll(nameless).groupBy("part", "mask").agg(
        F.count("*").alias("total"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"),
        F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    of = lambda name: F.array(*[
        F.sum(F.when(F.col("mask").bitwiseAND(s) != 0, F.col(name)).otherwise(0)) for s in range(1 << m)])
    return cells.groupBy("part").agg(
        F.sum("total").alias("all"), of("total").alias("removed"), of("good").alias("good"), of("toxic").alias("toxic"))


def audit(masks: DataFrame, labels: DataFrame, letters: str = LETTERS) -> DataFrame:
    """Every step of every order of the filters `letters`, in each part.

    Columns: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley (the share times the number of orders).
    """
    m = len(letters)
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    schema = staging.fields(part="string", filter_order="string", step="int", **dict.fromkeys(names, "bigint"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = list(permutations(range(m)))
        own = np.array(orders).reshape(-1)  # the filter of each step
        after = np.bitwise_or.accumulate(1 << np.array(orders), axis=1).reshape(-1)
        before = after - (1 << own)
        rest = (1 << m) - 1 - (1 << own)
        order = np.repeat(["".join(letters[i] for i in o) for o in orders], m)
        step = np.tile(np.arange(1, m + 1, dtype=np.int32), len(orders))
        for batch in batches:
            for part, total, *removals in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                v, good, toxic = (np.array(x, np.int64) for x in removals)
                share = [x * factorial(m) for x in shares(m).of(removals[0])]
                if any(x.denominator != 1 for x in share):
                    raise ArithmeticError(f"shares {share} of {part!r} are not whole")
                gone = v[after] - v[before]
                columns = [total - v[after], gone, v[1 << own] - gone, v[-1] - v[rest], good[after] - good[before],
                           toxic[after] - toxic[before], np.array([int(x) for x in share], np.int64)[own]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(own), pa.string()), pa.array(order, pa.string()), pa.array(step),
                     *map(pa.array, columns)], names=schema.names)

    staging.send_package(masks.sparkSession)
    return tables(masks, labels, m).mapInArrow(rows, schema)
