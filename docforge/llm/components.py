"""Connected components of a table of links, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docforge.plans.tables import release, written

MAX_ROUNDS = 64


def components(links: DataFrame) -> DataFrame:
    """For links (a, b): each linked node with its component's smallest node, as (node, component).

    Every round takes the least label among a node and its neighbours, then the label of that label; all
    steps are joins and aggregates, with tables written between rounds. Repeated links and links of a
    node to itself are allowed; an empty table gives no rows.
    """
    both = links.select("a", "b").where("a is not null and b is not null")
    edges = written(both.union(both.select("b", "a")).toDF("a", "b").distinct(), "edges")
    labels = written(edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels")
    for _ in range(MAX_ROUNDS):
        near = edges.join(labels.select(F.col("node").alias("b"), F.col("label").alias("near")), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        moved = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = written(moved.join(jump, "label", "left").select("node", F.least("label", "next").alias("label"), "old"), "labels")
        changed = new.where("label <> old").limit(1).count()
        release(labels)
        labels = new.select("node", "label")
        labels._docforge_path = new._docforge_path  # noqa: SLF001
        if not changed:
            return labels.select("node", F.col("label").alias("component"))
    raise RuntimeError(f"components did not settle within {MAX_ROUNDS} rounds")
