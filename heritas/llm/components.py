"""Connected components of a table of links, without the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heritas.llm.common import drop_stored, stored


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long).  Returns node, component (the smallest id that a
    node reaches) for the nodes of links.

    Each turn a node takes the smallest label among its own and its
    neighbours', then its label's label (which halves paths), until none
    changes.  A turn is a join by the neighbour and an aggregation with partial
    results.  Links are two numbers a row; those of a node with very many meet its
    label by a join that Spark's adaptive execution splits when it is skewed."""
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    now = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(now, both["b"] == now["node"]).groupBy("a").agg(F.min("label").alias("near"))
        step = now.join(near, now["node"] == near["a"], "left").select("node", F.col("label").alias("was"), F.least("label", F.coalesce("near", "label")).alias("label"))
        step = stored(step, "labels")
        jump = step.select(F.col("node").alias("up"), F.col("label").alias("higher"))
        new = step.join(jump, step["label"] == jump["up"], "left").select("node", "was", F.least("label", F.coalesce("higher", "label")).alias("label"))
        new = stored(new, "labels")
        drop_stored(step, now)
        changed = new.where("label <> was").limit(1).count()
        now = new
        if not changed:
            drop_stored(both)
            out = now.select("node", F.col("label").alias("component"))
            out._heritas_path = now._heritas_path
            return out
