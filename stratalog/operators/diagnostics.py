"""Reports on orderings and interval tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import PARAMS


def order_inversions(order: DataFrame) -> DataFrame:
    """(room, sg, diff): places at which the group id falls from one row of the ordering to the next."""
    rows = order.withColumn("diff", F.col("sg") - F.lag("sg").over(Window.partitionBy("room").orderBy("ordering", "sg")))
    return rows.where("diff < 0").select("room", "sg", "diff")


def hotspots(intervals: DataFrame, least: int = PARAMS.hotspot) -> DataFrame:
    """(room, start_index, runs) with more than ``least`` runs starting at one index."""
    return intervals.groupBy("room", "start_index").agg(F.count(F.lit(1)).alias("runs")).where(F.col("runs") > least)


def dag_gaps(intervals: DataFrame, edges: DataFrame) -> DataFrame:
    """(room, start_sg_id, prev): start groups with their parents, null where an edge is missing."""
    starts = intervals.select("room", "start_sg_id").distinct()
    return starts.join(edges.withColumnRenamed("sg", "start_sg_id"), ["room", "start_sg_id"], "left").select("room", "start_sg_id", "prev")


def compression(deltas: DataFrame, members: DataFrame, intervals: DataFrame) -> DataFrame:
    """(room, delta_rows, member_rows, events, intervals): rows in, rows expanded, the lower bound, rows out."""
    return summary(deltas, _count(members, "member_rows"), intervals)


def summary(deltas: DataFrame, sizes: DataFrame, intervals: DataFrame) -> DataFrame:
    """As ``compression`` from ``sizes`` (room, member_rows), so that rows expanded need not exist."""
    out = _count(deltas, "delta_rows").join(sizes, "room")
    runs = intervals.groupBy("room", "event").agg(F.count(F.lit(1)).alias("runs"))
    runs = runs.groupBy("room").agg(F.count("event").alias("events"), F.sum("runs").alias("intervals"))
    return out.join(runs, "room").withColumn("ratio", F.col("intervals") / F.col("delta_rows"))


def _count(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy("room").agg(F.count(F.lit(1)).alias(name))
