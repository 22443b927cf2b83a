"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dripline.session import cut


def _clean(edges: DataFrame, by: list[str]) -> DataFrame:
    return edges.filter("a <> b").select(*by, "a", "b").distinct()


def _large_star(edges: DataFrame, by: list[str]) -> DataFrame:
    """Hang every larger neighbour of a node on the node's smallest neighbour."""
    both = edges.unionByName(edges.select(*by, F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy(*by, "a").agg(F.min("b").alias("m"))
    low = low.withColumn("m", F.least("a", "m"))
    return both.join(low, [*by, "a"]).filter("b > a").select(*by, F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, by: list[str]) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them."""
    down = edges.select(*by, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy(*by, "a").agg(F.min("b").alias("m"))
    hung = down.join(low, [*by, "a"]).select(*by, F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(low.select(*by, "a", F.col("m").alias("b")))


def components(edges: DataFrame, by: list[str], max_rounds: int = 60) -> DataFrame:
    """Smallest node id reachable from each node that has an edge, that node itself too: (by, node, root).

    Minimums are taken by partial aggregation, so a hub with very many edges is no single task; rounds grow
    with the logarithm of the longest chain. Each round is checkpointed to keep the lineage short.
    """
    current = cut(_clean(edges, by))
    seen = None
    for _ in range(max_rounds):
        current = cut(_clean(_small_star(_clean(_large_star(current, by), by), by), by))
        mark = tuple(current.agg(F.count("*"), F.bit_xor(F.xxhash64(*by, "a", "b"))).first())
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    stars = current.select(*by, F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(*by, F.col("root").alias("node"), "root").distinct())
