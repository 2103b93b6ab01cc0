"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, join_hot, keep


def components(links: DataFrame) -> DataFrame:
    """Rows (node, component): the smallest node each linked node can reach.

    ``links`` has long columns a, b. In each round every node takes the smallest label among
    its own, its neighbours' and that of its label (which halves paths); rounds end when
    no label changes. Labels are written after each round, so a lost executor costs one round at most.
    Minima are taken by partial sums before the shuffle, and a node with very many links, or a label of very many nodes,
    is dealt into parts for the joins. Links of a node to itself and repeats are harmless.
    """
    both = keep(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    degree = both.groupBy("b").count().agg(F.max("count")).first()[0] or 0
    labels = keep(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"), "labels")
    largest = degree
    while True:
        near = join_hot(both, labels.withColumnRenamed("node", "b"), "b", ["a"], heaviest=degree).groupBy("a").agg(F.min("label").alias("near"))
        nearest = labels.join(near, labels["node"] == near["a"]).select("node", "label", F.least("label", "near").alias("best"))
        jump = labels.select(F.col("node").alias("best"), F.col("label").alias("far"))
        step = keep(join_hot(nearest, jump, "best", ["node"], heaviest=largest).select("node", "label", F.least("best", "far").alias("next")), "labels")
        drop(labels)
        labels = step.select("node", F.col("next").alias("label"))
        labels.stored_path = step.stored_path
        largest, changed = step.groupBy("next").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("next") < F.col("label")).alias("c")).agg(F.max("n"), F.sum("c")).first()
        if not changed:
            drop(both)
            return labels.select("node", F.col("label").alias("component"))
