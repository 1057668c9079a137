"""Connected components of links too many for one machine: alternating large-star and small-star."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.session import materialize


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over local links: each node that is not its component's least, with that least node."""
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    parent = np.arange(len(nodes))
    x, y = at[: len(a)], at[len(a) :]
    while True:
        px, py = parent[x], parent[y]
        low, high = np.minimum(px, py), np.maximum(px, py)
        differ = low != high
        if not differ.any():
            break
        np.minimum.at(parent, high[differ], low[differ])
        while True:  # halve the paths
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    moved = parent != np.arange(len(nodes))
    return nodes[moved], nodes[parent[moved]]


def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """(node, component) of every node with a link to another: component is the least node reachable.

    edges: two long columns (a, b). Minima are aggregated before they are shuffled and joined back
    by node, so a hub with any number of links is a splittable join side. Each round is written to
    the shared folder, which ends the lineage; it ends when every node has one parent, a root.
    """
    now = edges.toDF("a", "b").where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = materialize(now, name)
    for _ in range(rounds):
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("child")).unionByName(now.select(F.col("v").alias("node"), F.lit(0).alias("child")))
        unsettled = ends.groupBy("node").agg(F.sum("child").alias("parents"), F.min("child").alias("never_parent")).where("parents > 1 OR parents = 1 AND never_parent = 0")
        if not unsettled.select("node").head(1):
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(small.unionByName(least.toDF("u", "v")).distinct(), name)
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.toDF("node", "component").unionByName(roots.select("node", F.col("node").alias("component")))
