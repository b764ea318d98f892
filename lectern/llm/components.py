"""Connected components of link tables of any size, as joins and aggregates.

``forest``      inside a task: reduce many links to at most one per node, keeping who is connected
``components``  over the whole table: alternate large-star and small-star steps until only stars are left
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import written


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest node number reachable from each of ``n`` nodes over the links left[i] - right[i]."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a < b). Large: the larger neighbours of a node move to its smallest one.
    Small: the smaller neighbours of a node, and the node itself, move to the smallest."""
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = both.filter("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        down = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = (
            down.join(low, "u").filter("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b"))
            .unionAll(low.select(F.col("m").alias("a"), F.col("u").alias("b")))
        )
    return moved.distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node that is linked to a smaller one; root is the smallest node reachable.

    ``links`` has long columns a and b in any order, repeats and self-links allowed, nulls ignored.
    A node that is the smallest of its component, or has no link, is absent. Degrees may be as large as the table:
    a node's neighbours meet only in a partial aggregate and in a join that Spark can split.
    """
    edges = written(
        links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links"
    )
    seen = None
    for _ in range(most_rounds):
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if mark[0] == 0 or tuple(mark) == seen:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        seen = tuple(mark)
        edges = written(_stars(_stars(edges, large=True), large=False), "links")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
