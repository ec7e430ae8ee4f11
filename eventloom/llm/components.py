"""Connected components by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import written


def connected(edges: DataFrame, *, rounds: int = 64) -> DataFrame:
    """(node, root) for every node of the (a, b) edges; root: the smallest node reachable.

    Each round takes the smallest label among a node's own and its neighbours', then the label of that label, so labels
    travel twice as far each time. Labels are written after each round; the driver sees one count a round. A node with
    very many edges costs no task more than its share: minima are taken before the shuffle, and its label reaches its
    edges by a join that adaptive execution can split.
    """
    edges = written(edges.select("a", "b"), "edges")  # read both ways below: links that come in no fixed order must not be made twice
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.filter("a <> b").distinct(), "links")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("m"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", "root", F.least("root", "m").alias("to"))
        # the label of the label
        ends = step.select(F.col("node").alias("to"), F.col("to").alias("end"))
        step = step.join(ends, "to").select("node", F.col("root").alias("old"), F.least("to", "end").alias("root"))
        step = written(step, "labels")
        labels = step.select("node", "root")
        if step.filter("old <> root").isEmpty():
            break
    else:
        raise RuntimeError(f"labels still change after {rounds} rounds")
    return labels
