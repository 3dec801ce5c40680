"""Connected components of a link table, by smallest label with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swatch.session import materialize


def components(links: DataFrame, limit: int = 60) -> DataFrame:
    """``(v, label)`` for every id in ``links`` (columns a, b): the smallest id of its component.

    Each round takes the smallest label among the neighbours and then the label's own label, so rounds
    grow with the logarithm of the longest path in the usual case.  Labels are written after each round.
    """
    both = materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), "cc-links")
    labels = materialize(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "cc")
    for _ in range(limit):
        best = (both.join(labels, both.b == labels.v).groupBy("a").agg(F.min("label").alias("seen")))
        near = labels.join(best, labels.v == best.a).select("v", F.least("label", "seen").alias("label"))
        near = materialize(near, "cc")
        own = near.select(F.col("v").alias("u"), F.col("label").alias("up"))
        jumped = materialize(near.join(own, near.label == own.u).select("v", F.least("label", "up").alias("label")), "cc")
        old = labels.select(F.col("v").alias("w"), F.col("label").alias("before"))
        changed = jumped.join(old, jumped.v == old.w).where("label <> before").limit(1).count()
        labels = jumped
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {limit} rounds")
