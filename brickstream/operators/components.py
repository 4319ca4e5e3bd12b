"""Connected components of an edge table, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickstream.session import written


def _neighbours_min(pairs: DataFrame) -> DataFrame:
    """``(u, v)`` pairs with ``m``, the smallest of u and its neighbours.

    The minimum is a partial aggregate, so a hub with very many neighbours is combined
    before the shuffle; the join back is split by adaptive execution where one hub is hot.
    """
    low = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(low, "u")


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """``node, component`` for every node of an edge; ``component`` is its smallest node.

    Null ends and loops are left out; repeated edges count once; an empty edge table gives
    an empty result.  Large-star and small-star steps alternate until the edge set stands
    still, about log2 of the longest chain times; each round is written to the shared
    folder, so lineage stays short and a lost executor costs one round.
    """
    current = (
        edges.select(F.col(left).alias("a"), F.col(right).alias("b"))
        .filter("a is not null and b is not null and a != b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    current, before = written(current, "edges"), None
    while True:
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _neighbours_min(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        down = _neighbours_min(large)
        small = down.select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        current = written(small, "edges")
    roots = current.select(F.col("v").alias("node")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component"))).distinct()
