"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timbral.llm.shared import durable


def _hung(edges: DataFrame, end: str) -> DataFrame:
    """edges(a > b) with top: the least smaller neighbour of the node in the column end, null for a node without one."""
    least = edges.groupBy(F.col("a").alias("_node")).agg(F.min("b").alias("top"))
    return edges.join(least, F.col(end) == F.col("_node"), "left").select("a", "b", "top")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a, b): root is the smallest node of its component.

    Each round makes two stars of the edges a > b.  The large star hangs a on the
    least smaller neighbour of b; the small star hangs a, and all its other
    smaller neighbours, on the least of them.  Both keep components as they are
    and never make more edges, equal edges become one, and once nothing changes
    every node hangs on its root: the rounds grow with the logarithm of a
    component's width.  A round is two joins, each of the edges with one row for
    each node, so that Spark can split a hot node's edges.  Edges are kept in the
    shared folder after each round.  Nulls, loops and repeated edges have no
    effect; no edges give no rows.
    """
    ends = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # kept before it is read twice: a search may find other links of the same component when it is run again
    now, was = durable(ends.distinct()), None
    while True:
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.hash("a", "b"))).first()
        if state == was or not state[0]:
            return now.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("root")), F.struct(F.col("b").alias("node"), F.col("b").alias("root")))).alias("r")).select("r.node", "r.root").distinct()
        was = state
        large = _hung(now, "b").select("a", F.coalesce("top", "b").alias("b")).distinct()
        turned = F.explode(F.array(F.struct("a", F.col("top").alias("b")), F.struct(F.col("b").alias("a"), F.col("top").alias("b")))).alias("r")
        now = durable(_hung(large, "a").select(turned).select("r.a", "r.b").where("a <> b").distinct())
