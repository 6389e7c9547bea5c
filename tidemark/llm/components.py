"""Connected components of a distributed graph.

Each round joins the edges with the labels found so far and hooks larger labels to smaller ones,
then shortens label chains; rounds are written tables, so that a lost executor costs a reread. Only
the numbers of changed rows come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import staging


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from each node of `edges` (a, b).

    Alternates large-star and small-star steps until nothing changes: first every node links its
    larger neighbours to its smallest one, then its smaller ones. A node with very many neighbours
    sends one row a neighbour, and its smallest neighbour comes from a combining aggregate joined
    back, so no task holds a whole neighbourhood.
    """
    def oriented(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    current = staging.stage(oriented(edges))  # a > b
    signature = None
    while True:
        # Large-star: neighbours above a node link to its smallest neighbour or itself.
        both = current.select("a", "b").unionAll(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = staging.stage(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                              .where("a <> b").distinct())
        # Small-star: neighbours below a node, and itself, link to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        current = staging.stage(small.unionAll(least.select("a", F.col("m").alias("b"))).distinct())
        found = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(found) == signature:
            break
        signature = tuple(found)
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots).distinct()
