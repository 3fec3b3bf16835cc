"""Connected components of a distributed edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, tag: str, rows: int) -> DataFrame:
    """(node, label) for every node of ``edges`` (u, v: long; at most ``rows`` of them): nodes share a label exactly if edges connect them.

    Each round maps every node to that of itself and its neighbours which comes first in a hashed order, follows these
    images four steps, and keeps the edges between where they lead.  The order is random whatever the nodes' numbers, so
    hardly a way is longer than that, and few nodes but the first of their neighbourhood keep edges; a star's leaves meet
    in two rounds.  Every table is written before it is read again, and the joins read files on both sides, so AQE can
    split hubs.
    """
    steps: list[DataFrame] = []
    edges = scratch.write(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), f"{tag}-edges-0", rows)
    while rows := edges.count():
        at = len(steps)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        placed = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("node"))
        step = both.groupBy("u").agg(F.min(placed("v")).alias("m")).select(F.col("u").alias("node"), F.least(placed("u"), "m")["node"].alias("image"))
        step = scratch.write(step, f"{tag}-near-{at}", 2 * rows)
        for _ in range(2):
            step = step.join(step.toDF("image", "further"), "image").select("node", F.col("further").alias("image"))
        step = scratch.write(step, f"{tag}-step-{at}", 2 * rows)
        one, two = step.toDF("u", "a"), step.toDF("v", "b")
        met = edges.join(one, "u").join(two, "v").where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
        edges = scratch.write(met.distinct(), f"{tag}-edges-{at + 1}", rows)
        steps.append(step)
    if not steps:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    labels = steps[0].toDF("node", "label")
    for step in steps[1:]:
        labels = labels.join(step.toDF("label", "image"), "label", "left").select("node", F.coalesce("image", "label").alias("label"))
    return scratch.write(labels, f"{tag}-labels")
