"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, stage


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of links (a, b); root is the least node that it reaches.

    Each round hooks every node to its least neighbour, follows the hooks to their ends by doubling, and replaces nodes
    by ends; the ends that remain are local minima, at most half as many. Hooks only go down, so the least node of
    a component stays to the last. Both steps are joins on staged tables; nothing is gathered in one place.
    """
    edges = stage(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "edges")
    roots: DataFrame | None = None
    while not edges.isEmpty():
        hooks = stage(edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")), "hooks")
        while True:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = stage(hooks.join(up, "root").select("node", "next", (F.col("root") != F.col("next")).alias("moved")), "hooks")
            done = jumped.where("moved").isEmpty()
            free(hooks)
            hooks = jumped.select("node", F.col("next").alias("root"))
            hooks.staged_path = jumped.staged_path
            if done:
                break
        if roots is None:
            roots = hooks
        else:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
            new = stage(roots.join(up, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots")
            free(roots, hooks)
            roots = new
        a = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        next_edges = stage(edges.join(a, "a").join(b, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "edges")
        free(edges)
        edges = next_edges
    if roots is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots
