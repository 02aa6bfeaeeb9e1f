"""Connected components over an edge table, in DataFrame operations only.

Each round hooks every tree to the smallest label seen by its members' neighbours and then
halves the paths by pointer jumping; partial aggregates keep hubs small, and each round's
labels are written to the shared folder so that lineage stays short and survives lost
executors. The number of rounds grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alphaline.llm.shared import cut, drop_cut

MAX_ROUNDS = 200


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for the nodes of ``edges(a, b)``; component is the smallest node.

    Self-loops and repeated edges are harmless; edges with a null end are ignored. Rows of the
    result are unique by node.
    """
    known = edges.where("a IS NOT NULL AND b IS NOT NULL")
    both = cut(known.select("a", "b").union(known.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "cc-labels")
    for _ in range(MAX_ROUNDS):
        fresh = cut(_round(both, labels), "cc-labels")
        moved = fresh.where("moved").limit(1).count()
        drop_cut(labels)
        labels = fresh
        if not moved:
            break
    else:
        raise RuntimeError("connected components did not settle")
    drop_cut(both)
    return labels.select("node", F.col("root").alias("component"))


def _round(both: DataFrame, labels: DataFrame) -> DataFrame:
    """One hooking step and two pointer jumps."""
    old = labels.select("node", "root")
    far = both.join(old.select(F.col("node").alias("b"), F.col("root").alias("far")), "b").groupBy(F.col("a").alias("node")).agg(F.min("far").alias("far"))
    seen = old.join(far, "node")
    hooks = seen.groupBy("root").agg(F.min(F.least("far", "root")).alias("hook"))
    step = seen.join(hooks, "root").select("node", F.least("far", "hook").alias("next"), F.col("root").alias("was"))
    jump = old.select(F.col("node").alias("next"), F.col("root").alias("further"))
    # a root's own hook is its next label: follow it from the label just reached
    chained = hooks.select(F.col("root").alias("next"), F.col("hook").alias("hooked"))
    out = step.join(jump, "next", "left").join(chained, "next", "left")
    root = F.least("next", F.coalesce("further", "next"), F.coalesce("hooked", "next"))
    return out.select("node", root.alias("root"), (root < F.col("was")).alias("moved"))
