"""Resolution of full states from deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from ..sources.histories import History


def sg_dag_join(history: History) -> DataFrame:
    """(room, sg, prev) of all edges whose child is a group of the room."""
    return history.groups.join(history.edges, ["room", "sg"]).select("room", "sg", "prev")


def dag_nodes(history: History) -> DataFrame:
    """(room, sg): both ends of all edges."""
    return history.edges.select("room", "sg").union(history.edges.select("room", F.col("prev").alias("sg"))).distinct()


def closure(history: History, most_doublings: int = 40, starts: DataFrame | None = None) -> DataFrame:
    """(room, sg, anc, depth): every ancestor of every group, itself included, with its least distance.

    With ``starts`` (room, sg) only the ancestors of these groups are gathered.

    Pointer doubling: after k rounds all ancestors nearer than 2^k are known, so the number of joins is the logarithm of
    the depth.  Every round is written; if no group has several parents, what a round adds is new and only that is written.
    A cycle never stops adding ancestors at new depths and raises ValueError once
    depths pass the number of groups.  A group with several parents keeps each ancestor at its least depth.
    """
    known = (history.groups if starts is None else starts).select("room", "sg").distinct().select("room", "sg", F.col("sg").alias("anc"), F.lit(0).cast("long").alias("depth"))
    jump = history.edges.select("room", F.col("sg").alias("anc"), F.col("prev").alias("far"))
    known, jump, step = stage(known, "closure"), stage(jump, "jump"), 1
    groups = None
    for _ in range(most_doublings):
        more = known.join(jump, ["room", "anc"]).select("room", "sg", F.col("far").alias("anc"), (F.col("depth") + step).alias("depth"))
        if history.forest:
            known = known.unionByName(stage(more, "closure"))
        else:
            known = stage(known.unionByName(more).groupBy("room", "sg", "anc").agg(F.min("depth").alias("depth")), "closure")
        then = jump.select("room", F.col("anc").alias("far"), F.col("far").alias("next"))
        jump = jump.join(then, ["room", "far"]).select("room", "anc", F.col("next").alias("far"))
        jump = stage(jump if history.forest else jump.distinct(), "jump")
        if jump.isEmpty():
            return known
        step *= 2
        groups = history.groups.count() if groups is None else groups
        if step > groups:
            raise ValueError("the edges hold a cycle")
    raise ValueError("the edges hold a cycle")


def full_state(history: History, ancestors: DataFrame) -> DataFrame:
    """(room, sg, type, state_key, event): for each key the nearest ancestor's event, of equally near ones the higher group's.

    Null types and keys are keys like others.
    """
    deltas = history.deltas.select("room", F.col("sg").alias("anc"), "type", "state_key", "event")
    rows = ancestors.join(deltas, ["room", "anc"])
    nearer = -F.col("depth")  # a number keeps the aggregate hashed; ties need several parents
    best = F.max_by("event", nearer if history.forest else F.struct(nearer, F.col("anc")))
    return rows.groupBy("room", "sg", "type", "state_key").agg(best.alias("event"))


def full_state_by_id(history: History, ancestors: DataFrame) -> DataFrame:
    """As ``full_state``, but the highest group wins, however far it is."""
    deltas = history.deltas.select("room", F.col("sg").alias("anc"), "type", "state_key", "event")
    return ancestors.join(deltas, ["room", "anc"]).groupBy("room", "sg", "type", "state_key").agg(F.max_by("event", "anc").alias("event"))


def state_at(history: History, ancestors: DataFrame, every: int) -> DataFrame:
    """States of the groups whose id is divisible by ``every``, straight from their ancestors' deltas."""
    return full_state_by_id(history, ancestors.where(F.col("sg") % every == 0))


def chunks(history: History) -> DataFrame:
    """(room, sg, chunk): the smallest group id of each connected part, by min-label propagation with shortcuts."""
    both = history.edges.select("room", "sg", "prev").union(history.edges.select("room", F.col("prev").alias("sg"), F.col("sg").alias("prev")))
    both = stage(both.distinct(), "both-ways")
    labels = stage(history.groups.select("room", "sg").union(both.select("room", "sg")).distinct().withColumn("chunk", F.col("sg")), "labels")
    while True:
        near = both.join(labels.select("room", F.col("sg").alias("prev"), "chunk"), ["room", "prev"]).groupBy("room", "sg").agg(F.min("chunk").alias("near"))
        new = labels.join(near, ["room", "sg"], "left").withColumn("new", F.least("chunk", "near"))
        jump = labels.select("room", F.col("sg").alias("new"), F.col("chunk").alias("far"))
        new = stage(new.join(jump, ["room", "new"], "left").select("room", "sg", F.least("new", "far").alias("new"), "chunk"), "labels")
        if new.where("new <> chunk").isEmpty():
            return labels
        labels = new.select("room", "sg", F.col("new").alias("chunk"))


def topo_depth(history: History, ancestors: DataFrame) -> DataFrame:
    """(room, sg, depth): the longest way up; with one parent each, the largest ancestor distance."""
    return ancestors.groupBy("room", "sg").agg(F.max("depth").alias("depth"))
