"""Connected components as iterated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelix.llm.scratch import remove, written


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label): the smallest id that each end of the edges (a, b) can reach.

    Labels flow along the edges (pre-aggregated minima, so that a hub costs a row a task)
    and are then replaced by the label of their label, which halves path lengths. Every
    round is written to the shared folder; only the number of changes comes to the driver.
    """
    spark = edges.sparkSession
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both, both_path = written(both, "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label"))
    labels, path = written(labels, "labels")
    for _ in range(most_rounds):
        best = both.join(labels, F.col("a") == F.col("node")).groupBy(F.col("b").alias("node")).agg(F.min("label").alias("m"))
        near = labels.join(best, "node").select("node", "label", F.least("label", "m").alias("next"))
        up = labels.select(F.col("node").alias("next"), F.col("label").alias("above"))
        new = near.join(up, "next").select("node", F.least("next", "above").alias("next"), "label")
        new, new_path = written(new, "labels")
        changed = new.where("next <> label").limit(1).count()
        remove(spark, path)
        labels, path = new.select("node", F.col("next").alias("label")), new_path
        if not changed:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    remove(spark, both_path)
    return labels
