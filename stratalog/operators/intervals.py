"""Interval encoding: one row per maximal run of an event, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dense_index(order: DataFrame) -> DataFrame:
    """(room, sg, idx, n): 0-based place by (ordering, sg) in each room, and the room's length."""
    room = Window.partitionBy("room")
    return order.select("room", "sg", (F.row_number().over(room.orderBy("ordering", "sg")) - 1).cast("long").alias("idx"), F.count(F.lit(1)).over(room).alias("n"))


def chronological(groups: DataFrame) -> DataFrame:
    return dense_index(groups.select("room", "sg", F.col("sg").alias("ordering")))


def non_empty(groups: DataFrame, deltas: DataFrame) -> DataFrame:
    """Groups with at least one delta row, for an index that skips the others."""
    return groups.join(deltas.select("room", "sg"), ["room", "sg"], "left_semi")


def encode(members: DataFrame, index: DataFrame) -> DataFrame:
    """(room, event, start_index, end_index): runs of consecutive indexes; the end is exclusive, null while open.

    Within a run idx minus the event's row number is constant.
    """
    rows = members.select("room", "sg", "event").distinct().join(index, ["room", "sg"])
    run = F.col("idx") - F.row_number().over(Window.partitionBy("room", "event").orderBy("idx"))
    runs = rows.withColumn("run", run).groupBy("room", "event", "run").agg(F.min("idx").alias("start_index"), (F.max("idx") + 1).alias("end"), F.max("n").alias("n"))
    return runs.select("room", "event", "start_index", F.when(F.col("end") < F.col("n"), F.col("end")).alias("end_index"))


def with_groups(intervals: DataFrame, index: DataFrame) -> DataFrame:
    """Adds start_sg_id and end_sg_id."""
    start = index.select("room", F.col("idx").alias("start_index"), F.col("sg").alias("start_sg_id"))
    end = index.select("room", F.col("idx").alias("end_index"), F.col("sg").alias("end_sg_id"))
    return intervals.join(start, ["room", "start_index"]).join(end, ["room", "end_index"], "left")


def with_events(intervals: DataFrame, deltas: DataFrame) -> DataFrame:
    """Adds type and state_key; an event that deltas give several keys takes the smallest."""
    dimension = deltas.groupBy("room", "event").agg(F.min(F.struct("type", "state_key")).alias("k"))
    return intervals.join(dimension, ["room", "event"]).select(*intervals.columns, "k.type", "k.state_key")


def decode(intervals: DataFrame, index: DataFrame) -> DataFrame:
    """(room, sg, event): the members back from the intervals; each run is spelled out, then its groups looked up."""
    n = index.groupBy("room").agg(F.max("n").alias("n"))
    rows = intervals.join(n, "room").withColumn("idx", F.explode(F.sequence("start_index", F.coalesce("end_index", "n") - 1)))
    return rows.select("room", "event", "idx").join(index, ["room", "idx"]).select("room", "sg", "event")


def churn(intervals: DataFrame, index: DataFrame) -> DataFrame:
    """(room, sg, add_count, gone_count): runs that start and that end at each group; no state is compared."""
    edges = intervals.select("room", F.col("start_index").alias("idx"), F.lit(1).alias("a"), F.lit(0).alias("g"))
    edges = edges.union(intervals.where("end_index is not null").select("room", F.col("end_index").alias("idx"), F.lit(0).alias("a"), F.lit(1).alias("g")))
    counts = edges.groupBy("room", "idx").agg(F.sum("a").alias("a"), F.sum("g").alias("g"))
    out = index.join(counts, ["room", "idx"], "left")
    return out.select("room", "sg", F.coalesce("a", F.lit(0)).alias("add_count"), F.coalesce("g", F.lit(0)).alias("gone_count"))


def carried(counts: DataFrame) -> DataFrame:
    """Only groups that add something; what went since the last of them is in their gone_count."""
    order = Window.partitionBy("room").orderBy("sg")
    until = F.coalesce(F.sum((F.col("add_count") > 0).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = counts.withColumn("g", until)
    sums = F.sum("gone_count").over(Window.partitionBy("room", "g").orderBy("sg").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("gone_count", sums).where("add_count > 0").select("room", "sg", "add_count", "gone_count")


def ordered_lookup(deltas: DataFrame, index: DataFrame) -> DataFrame:
    """``deltas`` with each group's place (idx), for reading them in the order of ``index``; groups outside it drop out."""
    return deltas.join(index.select("room", "sg", "idx"), ["room", "sg"]).select("room", "idx", "sg", "type", "state_key", "event")


def current(intervals: DataFrame) -> DataFrame:
    return intervals.where("end_index is null")


def as_of(intervals: DataFrame, points: DataFrame) -> DataFrame:
    """(room, point, event) of the runs that cover each of ``points`` (room, point), a few rows."""
    p = points.select("room", "point")
    covers = (F.col("start_index") <= F.col("point")) & (F.col("end_index").isNull() | (F.col("end_index") > F.col("point")))
    return intervals.join(p, "room").where(covers).select("room", "point", "event")


def as_of_union(intervals: DataFrame, points: DataFrame) -> DataFrame:
    """The same as a union of open and closed runs."""
    rows = intervals.join(points.select("room", "point"), "room").where("start_index <= point")
    open_, closed = rows.where("end_index is null"), rows.where("end_index > point")
    return open_.unionByName(closed).select("room", "point", "event")
