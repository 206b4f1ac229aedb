"""Connected components of a link table, by rounds of contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); component is the smallest node reached.

    Each round, every node takes the smallest of itself and its neighbours, then what that one
    took, and the nodes that took the same become one: links inside it go, the others are counted
    once.  So links and nodes shrink from round to round, dense groups at once, and the rounds end
    when no link is left.  Labels only ever become smaller, and the last one of a component is a
    node of it, hence its smallest.  Node ids are hashes, which keeps the paths of smaller and
    smaller neighbours short.  Every round's links and steps are written to the shared folder, so a
    lost executor costs no more than the running round.
    """
    links = scratch.stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    names = None
    while True:
        both = links.union(links.select("b", "a"))
        took = scratch.stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("took")), "took")
        step = took.join(took.select(F.col("node").alias("took"), F.col("took").alias("component")), "took").select("node", "component")
        step = scratch.stored(step, "step")
        if names is None:
            names = step
        else:
            next_ = step.select(F.col("node").alias("component"), F.col("component").alias("later"))
            names = names.join(next_, "component", "left").select("node", F.coalesce("later", "component").alias("component"))
        left, right = (step.select(F.col("node").alias(c), F.col("component").alias(f"to_{c}")) for c in ("a", "b"))
        moved = links.join(left, "a").join(right, "b").filter("to_a <> to_b")
        links = scratch.stored(moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "links")
        if links.isEmpty():
            return names
