"""Data-quality checks that return rows."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import trim_space
from tidemark.schemas import TABLES
from tidemark.session import materialise

SAMPLE_ROWS = 10


def _blank(column: str):
    return F.coalesce(trim_space(column), F.lit("")) == ""


def empty_sku_check(heroes: DataFrame) -> DataFrame:
    """One row: whether every hero has a SKU, and how many have none."""
    return heroes.agg(F.count_if(_blank("sku")).alias("empty_count")).select(
        (F.col("empty_count") == 0).alias("ok"), "empty_count"
    )


def empty_sku_sample(heroes: DataFrame) -> DataFrame:
    """Up to ten heroes without a SKU."""
    return heroes.where(_blank("sku")).orderBy("campaign", "rank").limit(SAMPLE_ROWS)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def missing_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column with its number of nulls, from one pass."""
    counts = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in columns])
    return counts.unpivot([], columns, "column_name", "n_missing")


def table_checks(df: DataFrame, table: str) -> DataFrame:
    """Nulls in required columns and repeats of the unique key of a relational table.

    Both come from one pass: nulls are counted per key, and the counts added up.
    """
    spec = TABLES[table]
    required = list(spec["required"])
    missing = [F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(required)]
    per_key = df.groupBy(*spec["unique"]).agg(F.count(F.lit(1)).alias("n_rows"), *missing)
    totals = per_key.agg(
        F.count_if(F.col("n_rows") > 1).alias("repeats"),
        *[F.coalesce(F.sum(f"n{i}"), F.lit(0)).alias(f"n{i}") for i in range(len(required))],
    )
    entry = lambda rule, column, n: F.struct(
        F.lit(rule).alias("rule"), F.lit(column).alias("column_name"), F.col(n).cast("bigint").alias("n_bad"))
    entries = [entry("unique", ",".join(spec["unique"]), "repeats")]
    entries += [entry("required", c, f"n{i}") for i, c in enumerate(required)]
    return totals.select(F.lit(table).alias("table_name"), F.inline(F.array(*entries)))


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose parent does not exist (a null key has no parent).

    Parent keys are reduced to distinct ones first: repeats of a key meet once per task.
    """
    keys = parents.select(F.col(parent_key).alias(child_key)).distinct()
    return children.join(keys, child_key, "left_anti")


def without_orphans(children: DataFrame, parents: DataFrame, child_key: str,
                    parent_key: str) -> DataFrame:
    keys = parents.select(F.col(parent_key).alias(child_key)).distinct()
    return children.join(keys, child_key, "left_semi")


#: Parts of the hash domain that repeated keys are sought in; a part meets in one task as packed numbers.
HASH_PARTS = 256
#: Fingerprints that are held by a task before they are packed.
HELD = 1 << 22
#: Suspects, 8 bytes each, that may be sent to every task.
MOST_SENT = 1_000_000


def _packed(keys: DataFrame, parts: int) -> DataFrame:
    """``(part, prints)``: the fingerprints that each task met in each part, as packed bytes.

    A fingerprint that a task met twice is packed twice, so that it counts as repeated.
    """
    schema = "part int, prints binary"

    def rows(batches):
        held, size = [], 0

        def packs():
            values = np.sort(np.concatenate(held))
            first = np.concatenate([[True], values[1:] != values[:-1]])
            again = np.concatenate([[False], ~first[1:] & first[:-1]])  # the second of a run
            values = values[first | again]
            own = (values % np.uint64(parts)).astype(np.int32)
            order = np.argsort(own, kind="stable")
            values, own = values[order], own[order]
            edges = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]]))
            blobs = [values[a:b].tobytes() for a, b in zip(edges, edges[1:])]
            return pa.RecordBatch.from_arrays([pa.array(own[edges[:-1]]), pa.array(blobs, pa.binary())], names=["part", "prints"])

        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            size += batch.num_rows
            if size >= HELD:
                yield packs()
                held, size = [], 0
        if size:
            yield packs()

    return keys.mapInArrow(rows, schema)


def _repeated_prints(packed: DataFrame) -> DataFrame:
    """``(print)`` of the fingerprints that occur twice or more in a part."""
    def repeats(key, table):
        values = np.sort(np.concatenate([np.frombuffer(b, np.uint64) for b in table["prints"].to_pylist()]))
        return pa.table({"print": pa.array(np.unique(values[1:][values[1:] == values[:-1]]).view(np.int64))})

    return packed.groupBy("part").applyInArrow(repeats, "print bigint")


def repeated_keys(df: DataFrame, keys: list[str], parts: int = HASH_PARTS) -> DataFrame:
    """The rows of ``duplicate_keys``, for tables whose keys are wide and nearly all unique.

    The first pass moves no keys, only a packed 64-bit fingerprint each, a few rows a task. What has a
    repeated fingerprint is counted exactly in a second pass, so that about the repeated keys are all that
    is shuffled. A part of the fingerprints meets in one task: 8 bytes a key and ``parts`` tasks, so
    ``parts`` should grow with the table. Null keys are equal to each other, as in a grouping.
    """
    own = F.xxhash64(*keys, *[F.col(k).isNull() for k in keys])
    suspects = materialise(_repeated_prints(_packed(df.select(own.alias("print")), parts)), "suspects")
    if suspects.count() <= MOST_SENT:
        suspects = F.broadcast(suspects)
    rows = df.select(*keys, own.alias("print")).join(suspects, "print", "left_semi")
    return duplicate_keys(rows, keys)
