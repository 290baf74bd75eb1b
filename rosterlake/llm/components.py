"""Connected components of an edge table, wholly in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.llm._common import discard, stored


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every end of an edge (columns a, b); root is the component's smallest node.

    Alternates the large-star and small-star steps: each node passes its smallest neighbour on to its
    larger (smaller) neighbours, until the edges are stars and stay so, after a number of rounds
    that grows with the logarithm of the component's length. A node's neighbours are never gathered:
    their minimum is a partial aggregate, joined back. Each round is stored, so lineage stays short.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        # e holds each edge once, a > b
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        if large:  # larger neighbours, to the smallest of the neighbourhood
            out = both.filter("b > a").join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:  # smaller neighbours and the node itself
            out = e.join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("k").alias("a"), F.col("m").alias("b")))
        return out.filter("a <> b").distinct()

    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        after = stored(star(star(now, True), False), "edges")
        sums = after.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        discard(now)
        now = after
        if mark == (sums["n"], sums["h"]):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark = (sums["n"], sums["h"])
    raise RuntimeError("components did not settle")
