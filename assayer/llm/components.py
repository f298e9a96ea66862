"""Connected components of a graph whose edges are a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import cut


def _jump(hooks: DataFrame) -> DataFrame:
    """Hang every node where the node that it hangs on hangs; `moved` says whether that is elsewhere."""
    above = hooks.select(F.col("id").alias("up"), F.col("up").alias("top"))
    return hooks.join(above, "up", "left").select("id", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(`id`, `component`) of every node of an edge; a component is named by its least node.

    Each round every node hooks onto its least neighbour if that is smaller, chains of hooks are followed, and edges are
    relabelled by where their ends now hang; edges inside a tree vanish. Nodes that no edge leads on from are done. The
    number of edges falls by a constant factor or more a round, nothing leaves the cluster, and rounds are cut by
    checkpoints. Loops, repeated edges and either direction are fine; edges with a null end are not edges."""
    pairs = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    left = cut(pairs.filter("a < b").distinct())
    found: DataFrame | None = None
    while not left.isEmpty():
        hooks = left.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("up"))
        moving = True
        while moving:  # twice as far with each jump, until every node hangs on the top of its tree
            hooks = cut(_jump(_jump(hooks.select("id", "up"))))
            moving = not hooks.filter("moved").isEmpty()
        hooks = hooks.select("id", "up")
        low, high = hooks.select(F.col("id").alias("a"), F.col("up").alias("low")), hooks.select(F.col("id").alias("b"), F.col("up").alias("high"))
        ends = left.join(low, "a", "left").join(high, "b", "left").select(F.coalesce("low", "a").alias("x"), F.coalesce("high", "b").alias("y"))
        left = cut(ends.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        if found is None:
            found = hooks
        else:
            moved = hooks.select(F.col("id").alias("up"), F.col("up").alias("top"))
            found = found.join(moved, "up", "left").select("id", F.coalesce("top", "up").alias("up")).unionByName(hooks.join(found.select("id"), "id", "left_anti"))
            found = cut(found)
    if found is None:
        return nodes.select("id", F.col("id").alias("component"))
    return nodes.join(found, "id", "left").select("id", F.coalesce("up", "id").alias("component"))
