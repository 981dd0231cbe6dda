"""Connected components of an edge table, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, root): the least node of each component, for every node of ``edges``
    (columns a, b; any direction, repeats allowed).  ``rows``: a bound on the edges,
    if one is known.

    Each round a node takes the least label among itself and its neighbours, then
    the label of that label, so chains halve; rounds end when nothing changes.
    Minima combine before the shuffle, so a node with very many edges is no single
    task; every round is written, so lineage stays short."""
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
                   .where("a <> b").distinct(), "cc-edges", rows=rows and 2 * rows)
    few = both.count()
    labels = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label"))
                     .withColumnRenamed("a", "node"), "cc-labels", rows=few)
    last = labels
    while True:
        near = (both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near")))
        step = (labels.join(near, labels["node"] == near["a"])
                .select("node", "label", F.least("label", "near").alias("next")))
        up = labels.select(F.col("node").alias("at"), F.col("label").alias("above"))
        after = written(step.join(up, F.col("next") == F.col("at"), "left")
                        .select("node", F.coalesce(F.least("next", "above"), "next").alias("label"),
                                (F.least("next", F.coalesce("above", "next")) != F.col("label")).alias("moved")),
                        "cc-labels", rows=few)
        discard(last)
        labels, last = after.select("node", "label"), after
        if after.where("moved").isEmpty():
            discard(both)
            return labels.withColumnRenamed("label", "root")
