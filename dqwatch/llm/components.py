"""Connected components of a graph that no machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dqwatch.llm.common import written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the undirected ``edges`` (a, b; long): root is the smallest node that it reaches.

    Large-star and small-star rounds in turn: each joins a node's larger or smaller neighbours to the least of them.
    The minima are written before they are joined, so that both sides of the join are shuffled by the node and Spark
    may split a hot one. Loops and repeated edges do no harm; no edges give no rows.
    """
    now = written(_undirected(edges), "edges")
    state = _state(now)
    while True:
        now = _small_star(_large_star(now))
        after = _state(now)
        if after == state:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
                now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
            )
        state = after


def _undirected(edges: DataFrame) -> DataFrame:
    low, high = F.least("a", "b"), F.greatest("a", "b")
    return edges.filter(F.col("a") != F.col("b")).select(low.alias("a"), high.alias("b")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def _joined(pairs: DataFrame, name: str) -> DataFrame:
    """Each (node, other) with the least of the node and its others."""
    least = written(pairs.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("least")), name)
    return pairs.join(least, "node")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("a").alias("other"))
    )
    linked = _joined(both, "large").filter(F.col("other") > F.col("node")).select(F.col("least").alias("a"), F.col("other").alias("b"))
    return written(_undirected(linked), "edges")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.col("b").alias("node"), F.col("a").alias("other"))
    joined = _joined(down, "small")
    linked = joined.select(F.col("least").alias("a"), F.col("other").alias("b")).unionByName(
        joined.select(F.col("least").alias("a"), F.col("node").alias("b"))
    )
    return written(_undirected(linked), "edges")
