"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each component of the undirected edges (a, b).

    Each round maps every node to its smallest neighbour, follows that map once
    more, and carries the edges over to the images; edges inside an image go and
    equal ones become one, so the work shrinks from round to round, and the rounds
    grow with the logarithm of a component. The smallest node always maps to
    itself. Rounds are written to the shared folder: a lost executor repeats one
    round at most. Joins read plain tables on both sides, so that a hub's rows can
    be split; minima combine before they move.
    """
    left = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b"), "edges")
    labels = None
    while True:
        both = left.union(left.select("b", "a"))
        low = materialize(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to")), "lows")
        jump = materialize(low.join(low.select(F.col("node").alias("to"), F.col("to").alias("next")), "to").select("node", F.col("next").alias("to")), "jumps")
        drop_scratch(low)
        at = lambda c: jump.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to"))
        half = materialize(left.join(at("a"), "a").select(F.col("a_to").alias("x"), "b"), "half")
        moved = half.join(at("b"), "b").select(F.greatest("x", "b_to").alias("a"), F.least("x", "b_to").alias("b")).where("a <> b").distinct()
        new = materialize(moved, "edges")
        drop_scratch(half)
        drop_scratch(left)
        left = new
        if labels is None:
            labels = jump.withColumnRenamed("to", "label")
        else:
            moved = labels.join(jump.withColumnRenamed("node", "label"), "label", "left")
            old, labels = labels, materialize(moved.select("node", F.coalesce("to", "label").alias("label")), "labels")
            drop_scratch(old)
            drop_scratch(jump)
        if not left.limit(1).count():
            drop_scratch(left)
            return labels
