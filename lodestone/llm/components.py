"""Connected components of an edge table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """id, root for every id in edges (columns a, b); root is the least id of the component.

    A round gives each id the least label among its own and its neighbours',
    then follows the label's own label. Rounds end when no label changes;
    labels are written to the shared folder after each.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialize(both, "edges")
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("root")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("m"))
        stepped = labels.join(near, "id").select("id", F.least("root", "m").alias("root"), F.col("root").alias("was"))
        # Following the label's label of the round before halves the paths that are left.
        jump = labels.select(F.col("id").alias("root"), F.col("root").alias("next"))
        moved = stepped.join(jump, "root", "left").select("id", F.least("root", F.coalesce("next", "root")).alias("root"), "was")
        after = materialize(moved, "labels")
        changed = after.where("root <> was").limit(1).count()
        labels = after.select("id", "root")
        if not changed:
            return labels
    raise RuntimeError(f"components: labels still change after {most_rounds} rounds")
