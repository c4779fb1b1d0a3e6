"""Connected components by label propagation with pointer jumping, staged round by round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.shared import forget, scratch, staged


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, label (the least node that links reach) for every node of edges (a, b: long).

    A round takes the least label among a node and its neighbours, then follows the label's own label, so chains shrink
    by more than half. A hub's edges meet its label in one join key, which adaptive execution splits where it is large;
    the least label is then taken by partial aggregation.
    """
    with scratch():
        return _settled(edges, rounds)


def _settled(edges: DataFrame, rounds: int) -> DataFrame:
    both = staged(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    table = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "cc-labels")
    for _ in range(rounds):
        labels = table.select("node", "label")
        seen = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        near = labels.join(seen, F.col("node") == F.col("a")).select("node", "label", F.least("label", "near").alias("least"))
        # the label of the label; labels are nodes themselves
        up = labels.select(F.col("node").alias("n"), F.col("label").alias("up"))
        nxt = near.join(up, F.col("least") == F.col("n")).select("node", F.least("least", "up").alias("label"), (F.least("least", "up") < F.col("label")).alias("moved"))
        nxt = staged(nxt, "cc-labels", keep=True)
        forget(table)
        table = nxt
        if table.filter("moved").isEmpty():
            return table.select("node", "label")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
