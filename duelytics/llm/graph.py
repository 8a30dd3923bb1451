"""Connected components of a graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from duelytics.llm.store import stored


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """id, label: the smallest id reachable from each id that has an edge.

    `edges`: a, b (long). Every round each id takes the smallest label around it and then the label
    of that label, so long paths halve. Minima combine before the shuffle, so an id with very many
    edges costs no more than they do.
    """
    both = stored(
        edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = stored(
        both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("near"))
        .select("id", F.least("id", "near").alias("label")), "labels")
    for _ in range(most_rounds):
        near = (
            both.join(labels, both.b == labels.id).groupBy(F.col("a").alias("n_id"))
            .agg(F.min("label").alias("near"))
        )
        lower = labels.join(near, F.col("id") == F.col("n_id")).select(
            "id", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("id").alias("j_id"), F.col("label").alias("jump"))
        following = stored(
            lower.join(jump, F.col("low") == F.col("j_id"), "left")
            .select("id", F.coalesce(F.least("low", "jump"), "low").alias("next"),
                    (F.coalesce(F.least("low", "jump"), "low") < F.col("label")).alias("moved")), "labels")
        labels = following.select("id", F.col("next").alias("label"))
        if following.where("moved").isEmpty():
            return labels
    raise RuntimeError(f"no end after {most_rounds} rounds")
