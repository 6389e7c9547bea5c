"""Sharding by a k-d tree over document metadata.

A document's point has the dimensions language, source, length and a hash, each as a place in the
order of all values, weighted by bytes. The root holds all documents and as many leaves as there
are shards; a node with several leaves is cut along the widest dimension of its points, at the
weighted median (for an odd number of leaves at the quantile that leaves each side its share), until
every node is one leaf and so holds the target bytes: all bytes over the number of shards.

Cuts are found for all nodes of a level at once. The key of a point along a dimension is 48 bits
(place, then a hash of the text), and the byte-weighted quantile is found 16 bits at a time from
sums over distributed groups; one row a node comes to the driver. The points are groups of equal
texts, so copies stay together. Only a group that lies on a cut and is larger than TOLERANCE of a
leaf is cut by rows, since sizes could not be equal otherwise.

Nulls: a null text has no bytes; a null language or source is a value of its own, a null id is kept.
Equal rows are distinct documents. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import staging

OVERHEAD = 8
TOLERANCE = 0.01
DIMENSIONS = ("lang", "source", "bytes", "hash")
_PLACE_BITS = 16
_HASH_BITS = 32
_STEP_BITS = 16
_BUCKETS = 64


def items(documents: DataFrame) -> DataFrame:
    """Rows without their texts: id, size, digest of the text, metadata."""
    columns = staging.plain(documents, {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string"})
    text = F.coalesce("text", F.lit(""))
    return columns.select(
        "doc_id", "lang", "source", (F.octet_length(text) + OVERHEAD).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("group"),
    )


def _places(groups: DataFrame, dimension: str) -> DataFrame:
    """(value, place): the value's place in the order of all values, by bytes, in 16 bits.

    Lengths are first taken to three figures, so that there are few distinct values of any column
    but the two given ones; those are ordered through distributed sums as well.
    """
    values = groups.groupBy(F.col(dimension).alias("value")).agg(F.sum("weight").alias("weight"))
    values = staging.stage(values)
    # Running sums of a table of any size: buckets by range, sums of buckets, sums within buckets.
    bucketed = staging.stage(values.repartitionByRange(_BUCKETS, F.col("value").asc_nulls_first())
                             .withColumn("bucket", F.spark_partition_id()))
    sums = bucketed.groupBy("bucket").agg(F.sum("weight").alias("own"))
    before = sums.select("bucket", (F.sum("own").over(Window.orderBy("bucket")) - F.col("own")).alias("before"),
                         F.sum("own").over(Window.partitionBy()).alias("all"))
    inside = F.sum("weight").over(Window.partitionBy("bucket").orderBy(F.col("value").asc_nulls_first()))
    middle = F.col("before") + inside - F.col("weight") / 2
    return bucketed.join(F.broadcast(before), "bucket").select(
        "value", F.floor(middle / F.col("all") * ((1 << _PLACE_BITS) - 1)).cast("bigint").alias("place"))


def points(rows: DataFrame) -> DataFrame:
    """One row a group of equal texts: weight in bytes, places in all dimensions, hash."""
    grouped = staging.stage(rows.groupBy("group").agg(
        F.sum("size").alias("weight"), F.count("*").alias("copies"), F.min("lang").alias("lang"),
        F.min("source").alias("source"), F.min("size").alias("length")))
    figures = F.floor(F.log10(F.col("length"))) - 2
    grouped = grouped.withColumn("bytes", F.floor(F.col("length") / F.pow(F.lit(10.0), figures)) * F.pow(F.lit(10.0), figures))
    out = grouped
    for dimension in DIMENSIONS[:3]:
        places = _places(grouped, dimension).select(
            F.col("value").alias(f"v_{dimension}"), F.col("place").alias(f"p_{dimension}"))
        out = out.join(places, F.col(dimension).eqNullSafe(F.col(f"v_{dimension}"))).drop(f"v_{dimension}")
    spread = F.xxhash64("group", F.lit(5))
    return out.select(
        "group", "weight", "copies", *[f"p_{d}" for d in DIMENSIONS[:3]],
        F.shiftrightunsigned(spread, 64 - _PLACE_BITS).alias("p_hash"),
        F.shiftrightunsigned(F.xxhash64("group", F.lit(9)), 64 - _HASH_BITS).alias("tie"))


def _key(dimension: Column) -> Column:
    """The point's key along the node's dimension; hashes order points of the same place."""
    place = F.lit(0).cast("bigint")
    for i, d in enumerate(DIMENSIONS):
        place = F.when(dimension == i, F.col(f"p_{d}")).otherwise(place)
    return F.shiftleft(place, _HASH_BITS) + F.col("tie")


def _case(node: Column, values: dict[int, int]) -> Column:
    """A value for each node; there are fewer nodes than shards."""
    return F.element_at(F.create_map(*[F.lit(x).cast("bigint") for kv in values.items() for x in kv]), node)


def cuts(placed: DataFrame, nodes: dict[int, int]) -> tuple[dict, dict, dict]:
    """Dimension, cut key and bytes still wanted below the cut's own point, for each node.

    nodes: leaves of each node to be cut.
    """
    own = placed.where(F.col("node").isin(list(nodes)))
    widths = own.groupBy("node").agg(
        F.sum("weight").alias("all"),
        *[(F.max(f"p_{d}") - F.min(f"p_{d}")).alias(f"w{i}") for i, d in enumerate(DIMENSIONS)]).collect()
    dimension, wanted, prefix = {}, {}, {}
    for r in widths:
        span = [r[f"w{i}"] for i in range(len(DIMENSIONS))]
        # The hash is the widest by chance in any node; metadata goes first while it still differs.
        best = max(range(3), key=lambda i: (span[i], -i))
        dimension[r["node"]] = best if span[best] >= (1 << _PLACE_BITS) // 16 else 3
        leaves = nodes[r["node"]]
        wanted[r["node"]], prefix[r["node"]] = r["all"] * (leaves // 2) / leaves, 0
    if not dimension:
        return {}, {}, {}
    keyed = own.where(F.col("node").isin(list(dimension))).select(
        "node", "weight", _key(_case(F.col("node"), dimension)).alias("key"))
    for shift in range(_PLACE_BITS + _HASH_BITS - _STEP_BITS, -1, -_STEP_BITS):
        inside = keyed.where(F.shiftright("key", shift + _STEP_BITS) == _case(F.col("node"), prefix))
        digits = inside.groupBy("node", F.shiftright("key", shift).alias("digits")).agg(F.sum("weight").alias("w"))
        upto = F.sum("w").over(Window.partitionBy("node").orderBy("digits"))  # 65,536 rows at most
        aim = F.element_at(F.create_map(*[F.lit(float(x)) if i % 2 else F.lit(x).cast("bigint")
                                          for kv in wanted.items() for i, x in enumerate(kv)]), F.col("node"))
        found = digits.withColumn("upto", upto).where((F.col("upto") > aim)).groupBy("node").agg(
            F.min(F.struct("digits", (F.col("upto") - F.col("w")).alias("below"))).alias("x")).collect()
        for r in found:
            prefix[r["node"]] = r["x"]["digits"]
            wanted[r["node"]] -= r["x"]["below"]
    return dimension, prefix, wanted


def shard(documents: DataFrame, shards: int = 24, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (gapless from 0 in a shard)."""
    rows = staging.stage(items(documents))
    placed = staging.stage(points(rows).withColumn("node", F.lit(0).cast("bigint")))
    # A node is named by its first leaf.
    total = placed.agg(F.sum("weight")).first()[0] or 0
    leaf = total / shards
    nodes = {0: shards}
    while any(n > 1 for n in nodes.values()):
        open_nodes = {k: n for k, n in nodes.items() if n > 1}
        dimension, at, rest = cuts(placed, open_nodes)
        right = {k: k + open_nodes[k] // 2 for k in open_nodes}
        if dimension:
            key = _key(_case(F.col("node"), dimension))
            cut, aim = _case(F.col("node"), at), _case(F.col("node"), {k: int(v) for k, v in rest.items()})
            beyond = _case(F.col("node"), right)
            mine = F.col("node").isin(list(dimension))
            # The point on the cut: whole to the nearer side if small, else its rows are shared out.
            share = F.when(key < cut, 1.0).when(key > cut, 0.0).when(
                F.col("weight") <= tolerance * leaf, F.when(2 * aim >= F.col("weight"), 1.0).otherwise(0.0)
            ).otherwise(F.least(aim / F.col("weight"), F.lit(1.0)))
            left_copies = F.round(F.col("copies") * share)
            parts = F.filter(F.array(
                F.struct(F.col("node").alias("node"), left_copies.cast("bigint").alias("copies")),
                F.struct(beyond.alias("node"), (F.col("copies") - left_copies).cast("bigint").alias("copies"))),
                lambda p: p["copies"] > 0)
            parts = F.when(mine, parts).otherwise(F.array(F.struct(F.col("node"), F.col("copies"))))
            rest_of = [c for c in placed.columns if c not in ("node", "copies", "weight")]
            # Copies of one text have the same size, so a part's weight is its copies' share.
            placed = staging.stage(
                placed.withColumn("part", F.explode(parts)).select(
                    *rest_of, F.col("part.node").alias("node"), F.col("part.copies").alias("copies"),
                    (F.col("weight") / F.col("copies") * F.col("part.copies")).cast("bigint").alias("weight")))
        nodes = {k: n for k, n in nodes.items() if n == 1} | {k: n // 2 for k, n in open_nodes.items()} \
            | {right[k]: n - n // 2 for k, n in open_nodes.items()}
    return slots(rows, placed)


def slots(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """Give each row its group's shard, or one of its group's shards, and a slot in it."""
    parts = placed.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("node", "copies"))).alias("parts"))
    one = parts.where(F.size("parts") == 1).select("group", F.col("parts")[0]["node"].alias("shard"))
    joined = rows.join(one, "group", "left")
    several = parts.where(F.size("parts") > 1)  # fewer than there are cuts
    split = rows.join(F.broadcast(several), "group").withColumn(
        "bucket", F.pmod(F.xxhash64("doc_id", "lang", "source"), F.lit(_BUCKETS)).cast("int"))
    split = _numbered(split, ["group"], "number")
    # Rows of a cut group are numbered, and the numbers dealt to its parts in turn.
    dealt = F.aggregate(
        "parts", F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("bigint").alias("at")),
        lambda s, p: F.struct(
            (s["seen"] + p["copies"]).alias("seen"),
            F.when(s["at"].isNull() & (F.col("number") < s["seen"] + p["copies"]), p["node"]).otherwise(s["at"]).alias("at")),
        lambda s: s["at"])
    columns = ["doc_id", "size", "text_crc32", "shard"]
    split = split.withColumn("shard", dealt)
    sharded = staging.stage(joined.where(F.col("shard").isNotNull()).select(*columns).unionByName(split.select(*columns)))
    sharded = sharded.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(_BUCKETS)).cast("int"))
    return _numbered(sharded, ["shard"], "slot").select(
        "doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), "slot")


def _numbered(rows: DataFrame, within: list[str], name: str) -> DataFrame:
    """Number rows from 0 within a key, without one task for a key: by buckets of hashes."""
    counts = rows.groupBy(*within, "bucket").agg(F.count("*").alias("n"))
    before = counts.withColumn(
        "before", F.sum("n").over(Window.partitionBy(*within).orderBy("bucket")) - F.col("n")).drop("n")
    ranked = rows.withColumn("rank", F.row_number().over(
        Window.partitionBy(*within, "bucket").orderBy("doc_id", "text_crc32")))
    return ranked.join(F.broadcast(before), [*within, "bucket"]).withColumn(
        name, F.col("before") + F.col("rank") - 1).drop("before", "rank", "bucket")
