"""Connected components of a graph given as edges, by alternating large-star and small-star steps."""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from takt.llm.common import few_tasks, settled, settled_few


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member index of each of n nodes' component, for edges a[i] - b[i] that one task holds."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(root, up := root[root]):
            root = up
        left = root[a] != root[b]
        a, b = a[left], b[left]
    return root


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that an edge (a, b) touches; component is its smallest node.

    Each step maps every node to the smallest node around it (a map-side minimum, so a node with very many
    edges costs one row per task) and hangs its neighbours there; the number of edges never grows. Steps
    repeat until edges stay as they are. Empty input gives no row. Self loops and repeated edges are dropped.
    A step has as many tasks as its edges need, however many the session shuffles to.
    """
    links = settled_few(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(links)
    while n := state[0]:
        # large star: neighbours above a node hang on the smallest node around it
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        moved = both.join(low, "a").where("b > a and b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        links = few_tasks(few_tasks(moved, n).distinct(), n)
        # small star: a node and its neighbours below hang on the smallest of them
        low = links.groupBy("a").agg(F.min("b").alias("low"))
        hung = links.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        hung = few_tasks(hung.unionByName(low.select("a", F.col("low").alias("b"))), n)
        links = few_tasks(settled(few_tasks(hung.distinct(), n)), n)
        new = _state(links)
        if new == state:
            break
        state = new
    roots = few_tasks(links.select("b").distinct(), state[0]).select(F.col("b").alias("node"), F.col("b").alias("component"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _state(links: DataFrame) -> tuple:
    """Number of edges and two sums over them; equal states mean that a round changed nothing."""
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
    return tuple(row)
