import numpy as np
import pytest

from stratalog.functions.hilbert import hilbert_index, hilbert_indexes
from stratalog.functions.signatures import signatures
from stratalog.operators import intervals, ordering, resolve, rooms, segments
from stratalog.plans import lake as lakes
from stratalog.plans import queries
from stratalog.sources.histories import History


def same(a, b, some=True):
    a, b = (sorted(map(repr, x.select(*b.columns).collect())) for x in (a, b))
    assert a == b and (a or not some)


@pytest.fixture(scope="module")
def odd(spark):
    """Two rooms: forks, a parent with a higher id, an ancestor that is no group, null keys and events, an event under two keys, a group without members."""
    groups = [("a", x) for x in (1, 2, 3, 4, 5, 9)] + [("b", x) for x in (1, 2, 3)]
    edges = [("a", 2, 1), ("a", 3, 9), ("a", 4, 2), ("a", 5, 2), ("a", 9, 77), ("b", 2, 1)]
    deltas = [("a", 1, "m", "x", 10), ("a", 2, "m", None, 11), ("a", 77, None, "y", 12), ("a", 4, "m", "z", 11), ("a", 5, "m", "x", 11), ("a", 9, "m", "x", None)]
    deltas += [("b", 2, "m", "x", 20), ("b", 2, "m", "y", 20), ("b", 3, "m", "x", 20), ("b", 99, "m", "x", 21)]
    long = "room string, sg long"
    return History(*(spark.createDataFrame(x, y) for x, y in ((groups, long), (edges, long + ", prev long"), (deltas, long + ", type string, state_key string, event long"))))


def test_rooms_give_what_the_operators_give(odd):
    index = intervals.chronological(odd.groups)
    state = resolve.full_state(odd, resolve.closure(odd))
    runs = intervals.encode(state, index)
    same(rooms.runs(odd, index), runs)
    turned = intervals.dense_index(odd.groups.selectExpr("room", "sg", "-sg % 4 as ordering"))
    same(rooms.runs(odd, turned), intervals.encode(state, turned))
    same(rooms.sizes(odd, index), state.groupBy("room").count().withColumnRenamed("count", "member_rows"))
    signed = signatures(state.selectExpr("room", "sg", "event as member")).join(intervals.churn(runs, index), ["room", "sg"])
    same(rooms.hashes(odd, index), signed)


def test_a_cycle_raises(spark, odd):
    edges = odd.edges.union(spark.createDataFrame([("b", 1, 2)], odd.edges.schema))
    with pytest.raises(Exception, match="cycle"):
        rooms.runs(History(odd.groups, edges, odd.deltas), intervals.chronological(odd.groups)).collect()


def test_branch_points_and_segment_ends_of_rooms(spark, sf_dir):
    t = queries.lake(spark, sf_dir)
    for past in (True, False):
        probes = segments.probes_of(t.sections, t.hashes, past)
        for few, fallback in ((1, True), (8, False)):
            asked = probes.selectExpr("room", "sg", f"{past} as past")
            same(rooms.branch_points(asked, t.hashes, few, fallback), segments.branch_points(probes, t.hashes, past, few, fallback), some=few == 1)
    same(rooms.segment_signatures(t.segments, t.hashes), segments.segment_signatures(t.segments, t.hashes))
    same(ordering.room_distances(t.ends_signed), segments.segment_distance(t.segments, t.hashes))


@pytest.mark.parametrize("cells", [0, None])
def test_large_rooms_go_by_the_operators(spark, sf_dir, monkeypatch, cells):
    """All rooms, or about half of them."""
    plain = queries.lake(spark, sf_dir)
    if cells is None:
        counts = sorted(r["count"] for r in plain.history.groups.unionAll(plain.history.edges.select("room", "sg")).groupBy("room").count().collect())
        monkeypatch.setattr(rooms, "MOST_GROUPS", counts[len(counts) // 2] // 2 - 1)
    else:
        monkeypatch.setattr(rooms, "MOST_CELLS", cells)
    t = lakes.Lake(spark, sf_dir)
    assert t.parts[1] is not None
    same(t.sizes, plain.sizes)
    same(t.runs, plain.runs)
    same(t.hashes, plain.hashes)
    same(t.segments, plain.segments)
    same(t.branches, plain.branches)


#: Queries over the events that once wrote the states of all groups.
STATELESS = (
    "branch_detection branch_fill asof_reordered band_distance compression_summary order_aco order_dfs order_inversions sections segment_labels order_comparison asof_recursive"
    " asof_tables branch_points_fallback order_greedy order_hilbert_folded order_msa order_tsp ordered_lookup range_assign order_mst ordering_writeback segment_distance reordered_intervals"
).split()


@pytest.mark.parametrize("name", STATELESS)
def test_no_states_are_written(spark, sf_dir, monkeypatch, name):
    shared = lakes.Lake(spark, sf_dir)
    monkeypatch.setattr(queries, "lake", lambda *_: shared)
    assert queries.QUERIES[name](spark, sf_dir).count() > 0
    assert not {"state", "closure"} & vars(shared).keys()
    if name in ("asof_recursive", "asof_tables"):
        assert "runs" not in vars(shared)


@pytest.mark.parametrize("dims,bits", [(16, 8), (8, 8), (2, 8), (1, 8), (3, 4)])
def test_hilbert_keys_of_all_rows_are_those_of_each(dims, bits):
    points = np.random.default_rng(0).integers(0, 1 << bits, (50, dims))
    assert hilbert_indexes(points, bits).tolist() == [hilbert_index(x, bits) >> max(0, dims * bits - 63) for x in points.tolist()]


def test_common_values_in_small_lots():
    rng = np.random.default_rng(0)
    a, b = ([rng.integers(0, 30, 12) for _ in range(n)] for n in (7, 9))
    assert ordering.common(a, b, most_pairs=1).tolist() == [[len(set(x.tolist()) & set(y.tolist())) for y in b] for x in a]


@pytest.mark.parametrize("cells", [0, None])
def test_orders_without_written_signatures_are_those_of_the_operators(spark, sf_dir, monkeypatch, cells):
    """All rooms by the DataFrame operators, or none."""
    if cells is not None:
        monkeypatch.setattr(rooms, "MOST_CELLS", cells)
    plain, t = queries.lake(spark, sf_dir), lakes.Lake(spark, sf_dir)
    monkeypatch.setattr(queries, "lake", lambda *_: t)
    for name in ("tsp", "msa"):
        same(t.ordered(name), ordering.by_segments(plain.segments, plain.ends_signed, name))
    for name, rows in {
        "segment_distance": segments.segment_distance(plain.segments, plain.hashes),
        "band_distance": segments.neighbour_distance(plain.hashes),
        "order_hilbert_folded": ordering.by_hilbert(plain.hashes, folded=True),
        "sections": segments.sections(plain.hashes),
    }.items():
        same(queries.QUERIES[name](spark, sf_dir), rows)
    orders = {"chronological": plain.hashes.selectExpr("room", "sg", "sg as ordering"), "branches": ordering.by_branches(plain.hashes, plain.branches), "hilbert": ordering.by_hilbert(plain.hashes)}
    orders |= {"mst": ordering.by_segments(plain.segments, plain.ends_signed, "mst")}
    wanted = {name: intervals.encode(plain.state, intervals.dense_index(order)).count() for name, order in orders.items()}
    found = t.counted(("mst",), queries.COLONY).groupBy("ordering").sum("intervals").collect()
    assert {r[0]: r[1] for r in found} == wanted
    assert not {"hashes", "ends_signed"} & vars(t).keys()
