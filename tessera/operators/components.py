"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut, drop_cut

#: Steps before giving up; a component of n nodes needs about log2(n).
MAX_ROUNDS = 64


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest one: hubs lose their far ends."""
    near = _both(edges)
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are tied to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, src: str = "u", dst: str = "v") -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node.

    Nodes of any orderable type; self loops and repeated edges are allowed. Repeats go before the first round. Minima
    are combined before each exchange and hubs are split by adaptive joins, so no node's neighbours meet in one task.
    Each round is written to the shared folder, and the one before it is deleted.
    """
    pairs = cut(edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.least(src, dst).alias("v"), F.greatest(src, dst).alias("u")).distinct(), "component-edges", few=True)
    loops = pairs.where("u = v").select(F.col("u").alias("node"), F.col("v").alias("component"))
    now, seen = pairs.where("u <> v").select("u", "v"), None
    for _ in range(MAX_ROUNDS):
        was, now = now, cut(_small_star(_large_star(now)), "components", few=True)
        drop_cut(was)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
    return found.unionByName(loops.join(found, "node", "left_anti"))
