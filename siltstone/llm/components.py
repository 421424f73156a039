"""Connected components by distributed union-find, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.session import Scratch, tidy

#: Pointer jumping halves depth each time; so many passes reach any depth below 2**64.
_MOST_JUMPS = 64
#: Rows of a step's table to a task: small graphs need not be spread over every partition of a shuffle.
ROWS = 250_000


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of `edges` (columns a, b); component is the smallest node reached.

    Each round hooks every node that has a smaller neighbour to its smallest one, flattens the trees by pointer
    jumping, and contracts the edges to their roots; a local minimum hooks in a later round. A node with any number
    of edges is met by partial aggregates and by joins that the adaptive planner can split. Edges with a null end
    and loops are ignored; an empty input gives an empty result.
    """
    wide = (
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low"))
        .distinct()
    )
    tidy(scratch.spark)
    wide, left = scratch.keep_counting(wide, F.lit(True))
    # No later table has more than two rows for each edge.
    parts = 1 + left // ROWS
    live = wide
    rounds: list[DataFrame] = []
    while left:
        tree = _flatten(live.groupBy("high").agg(F.min("low").alias("root")).withColumnRenamed("high", "node"), scratch, parts)
        rounds.append(tree)
        high = tree.select(F.col("node").alias("high"), F.col("root").alias("high_root"))
        low = tree.select(F.col("node").alias("low"), F.col("root").alias("low_root"))
        ends = live.join(high, "high", "left").join(low, "low", "left")
        a, b = F.coalesce("high_root", "high"), F.coalesce("low_root", "low")
        after, left = scratch.keep_counting(
            ends.select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).where("high <> low").distinct().coalesce(parts), F.lit(True)
        )
        scratch.drop(live)
        live = after
        tidy(scratch.spark)
    if not rounds:
        return wide.select(F.col("high").alias("node"), F.col("low").alias("component"))
    found = rounds[-1]
    for tree in reversed(rounds[:-1]):
        up = found.select(F.col("node").alias("root"), F.col("root").alias("above"))
        found = tree.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root")).unionByName(found)
    # A root is a node that no round hooked; it stands for itself.
    roots = found.select(F.col("root").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return scratch.keep(found.unionByName(roots).select("node", F.col("root").alias("component")).coalesce(parts))


def _flatten(tree: DataFrame, scratch: Scratch, parts: int) -> DataFrame:
    """Point every node of a forest (node, root) at the root of its tree; each pass makes two jumps."""
    tree = scratch.keep(tree.coalesce(parts))
    for _ in range(_MOST_JUMPS):
        up = tree.select(F.col("node").alias("root"), F.col("root").alias("above"))
        higher = tree.select(F.col("node").alias("above"), F.col("root").alias("top"))
        far = tree.join(up, "root", "left").join(higher, "above", "left")
        far = far.select("node", F.coalesce("top", "above", "root").alias("root"), F.col("above").isNotNull().alias("moved"))
        jumped, moved = scratch.keep_counting(far.coalesce(parts), F.col("moved"))
        scratch.drop(tree)
        tree = jumped.drop("moved")
        if not moved:
            return tree
    return tree
