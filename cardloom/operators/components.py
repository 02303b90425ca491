"""Connected components over an edge table, without bringing links to the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.storage import save


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component_id) of every node of ``edges`` (a, b); component_id is its smallest reachable node.

    Rounds of large stars and small stars (Kiveris et al., 2014): neighbours move to the smallest node known, first
    those above a node, then those below, until all edges are stars around smallest nodes. Each round is written to the
    shared folder. Self-edges and nulls are ignored.
    """
    down = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    state, e = None, save(down.distinct())
    while not e.isEmpty():
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = save(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")).first()
        if now == state or (now[0] == now[2] and _stars(e)):
            break
        state = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component_id")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component_id")).unionAll(roots)


def _stars(e: DataFrame) -> bool:
    """No node is both a leaf and a centre."""
    return e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()


def spanning_links(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of ``n`` nodes those that links (i, j) join to a smaller one, and the smallest node of the component of each."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    at = np.flatnonzero(label != np.arange(n))
    return at, label[at]
