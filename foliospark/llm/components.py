"""Connected components by minimum labels with pointer jumping, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.scratch import Scratch


def merge_components(labels: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """Labels (node, label) after joining what ``links`` (a, b: nodes) connect.

    Works on the graph of labels, so earlier merges are never redone. Each round takes
    the smallest label around and then the label's label; rounds grow with the
    logarithm of a component's diameter. Both ends of every link must have a label.
    """
    a, b = labels.toDF("a", "la"), labels.toDF("b", "lb")
    edges = links.join(a, "a").join(b, "b").filter("la <> lb").select("la", "lb").distinct()
    edges = scratch.put(edges.union(edges.select("lb", "la")).toDF("x", "y"))
    if edges.isEmpty():
        return labels
    now = scratch.put(edges.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("l")))
    while True:
        near = now.toDF("y", "ly")
        lower = edges.join(near, "y").groupBy("x").agg(F.min("ly").alias("m"))
        stepped = now.join(lower, "x", "left").select("x", F.least("l", F.coalesce("m", "l")).alias("l"))
        jumped = stepped.join(stepped.toDF("l", "ll"), "l", "left").select(
            "x", F.least("l", F.coalesce("ll", "l")).alias("l")
        )
        was = now.toDF("x", "was")
        then = scratch.put(jumped)
        changed = not then.join(was, "x").filter("l < was").isEmpty()
        scratch.drop(now)
        now = then
        if not changed:
            break
    moved = labels.join(now.toDF("label", "root"), "label", "left")
    return scratch.put(moved.select("node", F.coalesce("root", "label").alias("label")))
