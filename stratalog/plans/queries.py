"""The registered queries over the event, document and basket histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import colors
from ..functions.signatures import hex8, jaccard, shared_bands
from ..operators import diagnostics, intervals, ordering, resolve, rooms, segments, solvers
from ..session import stage
from ..sources import histories
from .lake import Lake, lake

QUERIES = {}
COLONY = solvers.Colony(ants=100, iterations=100)
MOST_BROADCAST = 1 << 20


def query(f):
    QUERIES[f.__name__] = lambda spark, sf_dir: f(lake(spark, sf_dir))
    return f


@query
def sg_dag_join(t: Lake) -> DataFrame:
    h = histories.from_events(t.table("events"))
    return resolve.sg_dag_join(h)


@query
def dag_nodes(t: Lake) -> DataFrame:
    return resolve.dag_nodes(t.history)


@query
def delta_rows(t: Lake) -> DataFrame:
    return histories.from_events(t.table("events")).deltas


@query
def ancestor_closure(t: Lake) -> DataFrame:
    return resolve.closure(t.history)


@query
def resolve_state(t: Lake) -> DataFrame:
    return resolve.full_state(t.history, t.closure)


@query
def resolve_state_by_id(t: Lake) -> DataFrame:
    return resolve.full_state_by_id(t.history, t.closure)


@query
def interval_encode(t: Lake) -> DataFrame:
    return intervals.with_groups(intervals.encode(t.state, t.index), t.index)


@query
def interval_decode(t: Lake) -> DataFrame:
    return intervals.decode(t.runs, t.index)


@query
def event_enrichment(t: Lake) -> DataFrame:
    return intervals.with_events(t.runs, t.history.deltas)


@query
def current_state(t: Lake) -> DataFrame:
    return intervals.current(t.runs).select("room", "event", "start_index")


def _points(t: Lake) -> DataFrame:
    """Three points a room: a quarter, a half and three quarters of its length."""
    n = t.index.groupBy("room").agg(F.max("n").alias("n"))
    return n.select("room", F.explode(F.array(*(F.floor(F.col("n") * k / 4) for k in (1, 2, 3)))).alias("point")).distinct()


@query
def asof_index(t: Lake) -> DataFrame:
    return intervals.as_of(t.runs, _points(t))


def _group_points(t: Lake) -> DataFrame:
    return _points(t).join(t.index.select("room", F.col("idx").alias("point"), "sg"), ["room", "point"]).select("room", F.col("sg").alias("point"))


def _by_group(t: Lake) -> tuple[DataFrame, DataFrame]:
    runs = intervals.with_groups(t.runs, t.index).select("room", "event", F.col("start_sg_id").alias("start_index"), F.col("end_sg_id").alias("end_index"))
    return runs, _group_points(t)


@query
def asof_state(t: Lake) -> DataFrame:
    return intervals.as_of(*_by_group(t))


@query
def asof_state_union(t: Lake) -> DataFrame:
    return intervals.as_of_union(*_by_group(t))


def _quarters(n: int) -> list[int]:
    """The places of ``_points``."""
    return sorted({n * k // 4 for k in (1, 2, 3)}) if n else []


@query
def asof_recursive(t: Lake) -> DataFrame:
    """States of the points by the way up from each of them."""

    def dealt(history: histories.History, index: DataFrame) -> DataFrame:
        found = resolve.full_state_by_id(history, resolve.closure(history, starts=t.asked(index, _quarters)))
        return found.select("room", F.col("sg").alias("point"), "event")

    return t.by_room(lambda packed, _: rooms.states_at(packed, _quarters), dealt, packed=True)


@query
def asof_tables(t: Lake) -> DataFrame:
    """The same from the three input tables, by the nearest ancestor."""

    def whole(packed: histories.Packed, _: None) -> DataFrame:
        at = F.array_distinct(F.array(*(F.floor(F.size("sg") * k / 4) for k in (1, 2, 3)))).alias("idx")
        points = packed.rows.select("room", "sg", F.explode(at).alias("idx")).select("room", F.get("sg", F.col("idx").cast("int")).alias("sg"), "idx")
        h = histories.from_tables(*histories.to_tables(rooms.unpacked(packed)))
        return rooms.states_of(h, points).select("room", F.col("sg").alias("point"), F.col("event").cast("long").alias("event"))

    def dealt(history: histories.History, index: DataFrame) -> DataFrame:
        h = histories.from_tables(*histories.to_tables(history))
        found = resolve.full_state(h, resolve.closure(h, starts=t.asked(index, _quarters)))
        return found.select("room", F.col("sg").alias("point"), F.col("event").cast("long").alias("event"))

    return t.by_room(whole, dealt, packed=True)


@query
def asof_reordered(t: Lake) -> DataFrame:
    """The states of groups from a table encoded in travelling order and written by room and start; groups by their index."""
    table = stage(t.reordered("tsp", _quarters), "reordered")
    points = table.where("idx is not null").select("room", "sg", F.col("idx").alias("point"))
    points = F.broadcast(points) if points.count() <= MOST_BROADCAST else points
    runs = table.where("idx is null").select("room", "event", "start_index", "end_index").join(points, "room")
    covers = (F.col("start_index") <= F.col("point")) & (F.col("end_index").isNull() | (F.col("end_index") > F.col("point")))
    return runs.where(covers).select("room", F.col("sg").alias("point"), "event")


@query
def reordered_intervals(t: Lake) -> DataFrame:
    """The state table in greedy order: runs with indexes and groups."""
    return t.reordered("greedy").select("room", "event", "start_index", "end_index", "start_sg_id", "end_sg_id")


@query
def index_non_empty(t: Lake) -> DataFrame:
    """Places of the groups with deltas, where each seventh group has none."""
    deltas = t.history.deltas.where("sg % 7 <> 0")
    return intervals.chronological(intervals.non_empty(t.history.groups, deltas)).select("room", "sg", "idx")


@query
def ordered_lookup(t: Lake) -> DataFrame:
    """Delta rows with the place of their group by falling segment number."""

    def dealt(history: histories.History, index: DataFrame) -> DataFrame:
        falling = t.segments.join(index, ["room", "sg"], "left_semi").select("room", "sg", (-F.col("segment")).alias("ordering"))
        return intervals.ordered_lookup(history.deltas, intervals.dense_index(falling))

    return t.by_room(lambda packed, _: rooms.ordered_lookup(packed), dealt, packed=True)


@query
def churn_counts(t: Lake) -> DataFrame:
    return intervals.churn(t.runs, t.index)


@query
def churn_carried(t: Lake) -> DataFrame:
    return intervals.carried(t.churn)


@query
def chunks(t: Lake) -> DataFrame:
    return resolve.chunks(t.history)


@query
def topo_depth(t: Lake) -> DataFrame:
    return resolve.topo_depth(t.history, t.closure)


@query
def minhash_signature(t: Lake) -> DataFrame:
    return t.doc_hashes.select("room", "sg", F.array_join(F.col("minhash").cast("array<string>"), ",").alias("minhash"))


@query
def lsh_bands(t: Lake) -> DataFrame:
    return t.doc_hashes.select("room", "sg", F.array_join(F.col("lsh_bands").cast("array<string>"), ",").alias("lsh_bands"))


@query
def hex_bands(t: Lake) -> DataFrame:
    return t.hashes.select("room", "sg", F.array_join(F.transform("lsh_bands", hex8), " ").alias("hex"))


@query
def doc_minhash_neighbors(t: Lake) -> DataFrame:
    """For each document the most similar earlier one of its language that shares a band."""
    found = segments.branch_points(t.doc_hashes, t.doc_hashes, True, fallback=False)
    return found.select("room", "probe", "match", F.round("similarity", 6).alias("similarity"))


@query
def jaccard_pairs(t: Lake) -> DataFrame:
    one = t.doc_hashes.select("room", F.col("sg").alias("a"), F.col("minhash").alias("m"), F.explode(F.array_distinct("lsh_bands")).alias("band"))
    two = one.withColumnsRenamed({"a": "b", "m": "m2"})
    pairs = one.join(two, ["room", "band"]).where("a < b").select("room", "a", "b", "m", "m2").dropDuplicates(["room", "a", "b"])
    return pairs.select("room", "a", "b", F.round(jaccard(F.col("m"), F.col("m2")), 6).alias("jaccard"))


@query
def band_overlap_k(t: Lake) -> DataFrame:
    """Section starts with the earlier groups that share at least eight of their bands."""
    p = segments.probes_of(t.sections, t.hashes, True).select("room", F.col("sg").alias("probe"), F.col("lsh_bands").alias("p"))
    keyed = p.select("room", "probe", F.explode(F.array_distinct("p")).alias("band"))
    c = t.hashes.select("room", "sg", F.explode(F.array_distinct("lsh_bands")).alias("band"))
    pairs = keyed.join(c, ["room", "band"]).where("sg < probe").select("room", "probe", "sg").distinct()
    full = pairs.join(p, ["room", "probe"]).join(t.hashes.select("room", "sg", "lsh_bands"), ["room", "sg"])
    return full.withColumn("shared", shared_bands(F.col("lsh_bands"), F.col("p")).cast("long")).where("shared >= 8").select("room", "probe", "sg", "shared")


@query
def sections(t: Lake) -> DataFrame:
    return t.sections


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("similarity", F.round("similarity", 6))


@query
def branch_points_past(t: Lake) -> DataFrame:
    return _rounded(t.matches(t.ends.where("past"), fallback=False).drop("past"))


@query
def branch_points_future(t: Lake) -> DataFrame:
    return _rounded(t.matches(t.ends.where("not past"), fallback=False).drop("past"))


@query
def branch_points_fallback(t: Lake) -> DataFrame:
    return _rounded(t.past)


@query
def segment_labels(t: Lake) -> DataFrame:
    return t.segments


@query
def segment_distance(t: Lake) -> DataFrame:
    return t.by_signatures(rooms.room_distances, lambda hashes: ordering.room_distances(t.signed_segments(hashes)[1]))


@query
def band_distance(t: Lake) -> DataFrame:
    return t.by_signatures(rooms.neighbour_distance, segments.neighbour_distance)


@query
def branch_detection(t: Lake) -> DataFrame:
    return t.branches


@query
def branch_fill(t: Lake) -> DataFrame:
    return segments.branch_fill(t.labels, t.branches)


@query
def range_assign(t: Lake) -> DataFrame:
    return segments.range_assign(t.labels.select("room", "sg"), segments.segment_ends(t.segments))


@query
def ordering_writeback(t: Lake) -> DataFrame:
    """The groups by falling segment number, with paired ids."""
    return t.by_signatures(rooms.written_back, lambda hashes: ordering.by_ids(segments.labels(hashes).select("room", "sg", (-F.col("segment")).alias("ordering"))))


@query
def order_inversions(t: Lake) -> DataFrame:
    return diagnostics.order_inversions(t.segments.select("room", "sg", (-F.col("segment")).alias("ordering")))


@query
def flipflop_hotspots(t: Lake) -> DataFrame:
    return diagnostics.hotspots(t.runs)


@query
def dag_gaps(t: Lake) -> DataFrame:
    return diagnostics.dag_gaps(intervals.with_groups(t.runs, t.index), t.history.edges)


@query
def compression_summary(t: Lake) -> DataFrame:

    def dealt(history: histories.History, index: DataFrame) -> DataFrame:
        state = stage(t._state(history), "large-states")
        return diagnostics.compression(history.deltas, state, intervals.encode(state, index)).drop("ratio")

    found = t.by_room(lambda packed, _: rooms.summary(packed), dealt, packed=True).withColumn("ratio", F.col("intervals") / F.col("delta_rows"))
    return found.withColumn("ratio", F.round("ratio", 6))


@query
def basket_intervals(t: Lake) -> DataFrame:
    """Each customer's orders as snapshots of parts; runs of a part over consecutive orders."""
    members = histories.basket_members(t.table("orders"), t.table("lineitem"))
    groups = members.select("room", "sg").distinct()
    return intervals.encode(members.withColumnRenamed("member", "event"), intervals.chronological(groups))


@query
def conversation_state(t: Lake) -> DataFrame:
    h = histories.from_conversations(t.table("conversations"))
    return resolve.full_state(h, resolve.closure(h))


def _ordered(solver: str):
    def run(t: Lake) -> DataFrame:
        return t.ordered(solver, COLONY)

    run.__name__ = f"order_{solver}"
    return query(run)


SOLVERS = ("greedy", "mst", "dfs", "msa", "tsp", "aco")
for _solver in SOLVERS:
    _ordered(_solver)


@query
def order_branches(t: Lake) -> DataFrame:
    return ordering.by_branches(t.labels, t.branches)


@query
def order_hilbert(t: Lake) -> DataFrame:
    return ordering.by_hilbert(t.hashes)


@query
def order_hilbert_folded(t: Lake) -> DataFrame:
    return t.by_signatures(rooms.by_hilbert_folded, lambda hashes: ordering.by_hilbert(hashes, folded=True))


@query
def order_topological(t: Lake) -> DataFrame:
    return ordering.by_topology(t.history, resolve.chunks(t.history))


@query
def order_comparison(t: Lake) -> DataFrame:
    """Interval rows of all rooms under each ordering."""
    counts = t.counted(SOLVERS, COLONY, topological=True)
    names = t.spark.range(1).select(F.explode(F.array(*(F.lit(x) for x in ("chronological", "topological", "branches", "hilbert", *SOLVERS)))).alias("ordering"))
    sums = counts.groupBy("ordering").agg(F.sum("intervals").alias("intervals"))
    return names.join(sums, "ordering", "left").select("ordering", F.coalesce("intervals", F.lit(0).cast("long")).alias("intervals"))


@query
def colorize(t: Lake) -> DataFrame:
    text = F.array_join(F.transform("lsh_bands", hex8), " ")
    return t.doc_hashes.select("room", "sg", colors.colorize(text).alias("painted"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was the state of each room half-way: resolve, encode, and look up."""
    t = lake(spark, sf_dir)
    half = t.index.groupBy("room").agg(F.floor(F.max("n") / 2).alias("point"))
    return intervals.with_events(intervals.as_of(t.runs, half).withColumnRenamed("point", "idx"), t.history.deltas)
