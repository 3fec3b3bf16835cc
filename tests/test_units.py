import numpy as np
import pytest

from stratalog.functions import colors, hilbert
from stratalog.functions.signatures import hex8, jaccard, set_distance, tiered_distance
from stratalog.operators import intervals, resolve, segments, solvers
from stratalog.sources import files, histories


def test_reorder():
    nodes = list(range(101, 116))
    assert solvers.reorder(nodes, [(105, 110, 102), (110, 115, 107)]) == [101, 102, 105, 106, 107, 110, 111, 112, 113, 114, 108, 109, 103, 104, 115]
    assert solvers.reorder(nodes, []) == nodes
    with pytest.raises(ValueError):
        solvers.reorder(nodes, [(105, 110, 107)])


def test_travelling_is_near_the_best_path():
    from itertools import permutations

    for seed in range(8):
        d = np.random.default_rng(seed).integers(1, 50, (8, 8))
        best = min(solvers.path_length(d, [0, *p]) for p in permutations(range(1, 8)))
        assert solvers.path_length(d, solvers.travelling(d)) <= 1.05 * best


def test_spanning_tree_has_the_least_weight():
    from itertools import combinations

    for seed in range(10):
        d = np.random.default_rng(seed).integers(0, 9, (5, 5))
        w = np.minimum(d, d.T)
        every = list(combinations(range(5), 2))
        least = min(sum(w[a, b] for a, b in tree) for tree in combinations(every, 4) if _connected(tree, 5))
        assert sum(w[a, b] for a, b in solvers.minimum_spanning_tree(d)) == least


def _connected(edges, n):
    seen = {0}
    for _ in range(n):
        seen |= {x for e in edges if set(e) & seen for x in e}
    return len(seen) == n


def test_ants_take_the_next_id_where_all_is_lost_and_log_their_way():
    d = np.random.default_rng(3).integers(1, 30, (20, 20))
    log = []
    path, length = solvers.ant_colony(d, solvers.Colony(ants=10, iterations=15, next_id=True, symmetric=True, beta=200.0), log)
    assert sorted(path) == list(range(20)) and length == solvers.path_length(d, path, closed=True)
    assert [x[0] for x in log] == list(range(len(log))) and log[-1][2] == length
    assert all(a[2] >= b[2] for a, b in zip(log, log[1:]))


def test_ants_draw_in_proportion_to_the_pull_of_their_unvisited_nodes():
    rng = np.random.default_rng(5)
    pull = rng.random((4, 4)) + 0.1
    race = rng.standard_exponential(1 << 20, dtype=np.float32)
    tours = np.hstack([solvers._raced((1 / pull).astype(np.float32), np.full(1000, 2), rng, race) for _ in range(40)])
    assert (np.sort(tours, 0) == np.arange(4)[:, None]).all()
    free = [0, 1, 3]
    assert np.allclose(np.bincount(tours[1], minlength=4)[free] / 40000, pull[2, free] / pull[2, free].sum(), atol=0.02)
    second = tours[2][tours[1] == 0]
    assert np.isclose((second == 1).mean(), pull[0, 1] / (pull[0, 1] + pull[0, 3]), atol=0.02)


@pytest.mark.parametrize("n", [0, 1, 2, 7, 25])
def test_solvers_return_permutations(n):
    d = np.random.default_rng(n).integers(0, 9, (n, n))
    np.fill_diagonal(d, 0)
    for path in (solvers.greedy(d), solvers.travelling(d), solvers.arborescence_walk(d), solvers.tree_walk(d, solvers.minimum_spanning_tree(d)), solvers.tree_walk(d, solvers.minimum_spanning_tree(d), True), solvers.ant_colony(d, solvers.Colony(iterations=5))[0]):
        solvers.check_permutation(path, n)
    if n > 2:
        assert solvers.path_length(d, solvers.travelling(d)) <= solvers.path_length(d, solvers.greedy(d))


def test_arborescence_is_minimal():
    from itertools import product

    for seed in range(30):
        n = 5
        d = np.random.default_rng(seed).integers(1, 20, (n, n)).astype(float)
        parent = solvers.arborescence(d)
        cost = sum(d[p, i] for i, p in enumerate(parent) if p >= 0)
        best = np.inf
        for choice in product(range(n), repeat=n - 1):
            up = [-1, *choice]
            if all(_reaches(up, i) for i in range(n)):
                best = min(best, sum(d[p, i] for i, p in enumerate(up) if p >= 0))
        assert cost == best and all(_reaches(parent, i) for i in range(n))


def _reaches(up, i):
    for _ in range(len(up) + 1):
        if i == 0:
            return True
        i = up[i]
        if i < 0:
            return i == 0
    return False


def test_lost_nodes_raise():
    with pytest.raises(ValueError):
        solvers.check_permutation([0, 0, 2], 3)
    with pytest.raises(ValueError):
        solvers.topological([1, 2], [(1, 2), (2, 1)])
    assert solvers.topological([3, 1, 2], [(1, 3), (2, 1)]) == [3, 1, 2]


def test_hilbert_neighbours_touch():
    points = {hilbert.hilbert_index([x, y], 3): (x, y) for x in range(8) for y in range(8)}
    assert sorted(points) == list(range(64))
    assert all(abs(points[i][0] - points[i + 1][0]) + abs(points[i][1] - points[i + 1][1]) == 1 for i in range(63))


def test_hex_and_colours(spark):
    row = spark.sql("select -1 as a, 255 as b").select(hex8(__import__("pyspark").sql.functions.col("a")), hex8(__import__("pyspark").sql.functions.col("b"))).first()
    assert tuple(row) == ("ffffffff", "000000ff")
    assert colors.paint("ffffff00") == "\x1b[48;2;255;255;255m\x1b[38;2;0;0;0mffffff00\x1b[0m"
    assert colors.paint("00000000") == "\x1b[48;2;0;0;0m\x1b[38;2;255;255;255m00000000\x1b[0m"
    assert colors.HEX_WORD.findall("ffffff00 123 0123456789 DEADBEEF") == ["ffffff00", "DEADBEEF"]


def test_distances(spark):
    from pyspark.sql import functions as F

    a = lambda v: F.array(*map(F.lit, v))
    same, other = list(range(16)), [0, 1, 2, *range(100, 113)]
    m1, m2 = list(range(128)), [*range(40), *range(1000, 1088)]
    row = spark.range(1).select(
        tiered_distance(a(same), a(same), a(m1), a(m1)),
        tiered_distance(a(same), a(other), a(m1), a(m2)),
        tiered_distance(a(same), a(range(50, 66)), a(m1), a(m2)),
        tiered_distance(a(same), a(range(50, 66)), a(m1), a(range(500, 628))),
        set_distance(a([0] * 8), a([0] * 7 + [1])),
        jaccard(a([1, 2, 3, 4]), a([1, 3, 3, 5])),
    ).first()
    assert tuple(row) == (0, 104, 88, 128, 7, 0.5)


def test_encode_example(spark):
    sets = [{"a"}, {"a", "b"}, {"b"}, {"a", "b"}, {"a"}]
    members = spark.createDataFrame([("r", i, e) for i, s in enumerate(sets) for e in s], "room string, sg long, event string")
    index = intervals.chronological(members.select("room", "sg").distinct())
    runs = intervals.encode(members, index)
    assert {(r["event"], r["start_index"], r["end_index"]) for r in runs.collect()} == {("a", 0, 2), ("a", 3, None), ("b", 1, 4)}
    counts = {r["sg"]: (r["add_count"], r["gone_count"]) for r in intervals.churn(runs, index).collect()}
    assert counts == {0: (1, 0), 1: (1, 0), 2: (0, 1), 3: (1, 0), 4: (0, 1)}
    assert {(r["sg"], r["gone_count"]) for r in intervals.carried(intervals.churn(runs, index)).collect()} == {(0, 0), (1, 0), (3, 1)}


def _history(spark, groups, edges, deltas):
    return histories.History(
        spark.createDataFrame([("r", g) for g in groups], "room string, sg long"),
        spark.createDataFrame([("r", *e) for e in edges], "room string, sg long, prev long"),
        spark.createDataFrame([("r", *d) for d in deltas], "room string, sg long, type string, state_key string, event long"),
    )


def test_resolution_with_null_keys_forks_and_empty_deltas(spark):
    h = _history(spark, [1, 2, 3, 4], [(2, 1), (3, 2), (4, 2)], [(1, "m", None, 10), (1, "n", "x", 11), (3, "m", None, 12)])
    state = {(r["sg"], r["type"], r["state_key"]): r["event"] for r in resolve.full_state(h, resolve.closure(h)).collect()}
    assert state[(2, "m", None)] == 10 and state[(3, "m", None)] == 12 and state[(4, "n", "x")] == 11 and len(state) == 8
    assert {r["chunk"] for r in resolve.chunks(h).collect()} == {1}


def test_cycle_raises(spark):
    h = _history(spark, [1, 2], [(1, 2), (2, 1)], [(1, "m", "", 1)])
    with pytest.raises(ValueError):
        resolve.closure(h)


def test_sections_and_ranges(spark):
    rows = [("r", i, [i], [i], 20 if i in (0, 3) else 0, 0) for i in range(6)]
    hashes = spark.createDataFrame(rows, "room string, sg long, minhash array<int>, lsh_bands array<long>, add_count long, gone_count long")
    parts = segments.sections(hashes)
    assert {(r["section"], r["start_sg"], r["end_sg"]) for r in parts.collect()} == {(0, 0, 2), (1, 3, 5)}
    ranges = parts.withColumnRenamed("section", "segment").where("segment = 1")
    assert {(r["sg"], r["segment"]) for r in segments.range_assign(hashes.select("room", "sg"), ranges).collect()} == {(3, 1), (4, 1), (5, 1)}


def test_files(spark, tmp_path):
    (tmp_path / "m.txt").write_text("x|0| 0 3\nx|1|4 0 \n")
    assert {(r["i"], tuple(r["row"])) for r in files.read_matrix(spark, str(tmp_path / "m.txt")).collect()} == {(0, (0, 3)), (1, (4, 0))}
    (tmp_path / "s.txt").write_text("log segment #2 10 -> 14\nother\n")
    assert [tuple(r) for r in files.read_segments(spark, str(tmp_path / "s.txt")).collect()] == [(2, 10, 14)]
    df = spark.createDataFrame([(1, "a,b"), (2, None)], "id long, name string")
    for codec in ("none", "gzip"):
        files.write_csv(df, str(tmp_path / codec), codec)
        assert files.read_csv(spark, str(tmp_path / codec), df.schema).exceptAll(df).isEmpty()
    files.read_zstd_csv(files.write_zstd_csv(df, f"{tmp_path}/zstd"), df.schema).exceptAll(df).isEmpty()
    assert files.read_zstd_csv(files.write_zstd_csv(df, f"{tmp_path}/zstd"), df.schema).count() == 2
    matrix = spark.createDataFrame([(0, 0, 0), (0, 1, 3), (1, 0, 4), (1, 1, 0)], "i int, j int, distance int")
    files.write_matrix(matrix, str(tmp_path / "dump"))
    assert {(r["i"], tuple(r["row"])) for r in files.read_matrix(spark, str(tmp_path / "dump")).collect()} == {(0, (0, 3)), (1, (4, 0))}
    files.write_dot(spark.createDataFrame([(1, 2, 5), (3, 1, 7)], "u long, v long, weight long"), str(tmp_path / "dot"))
    text = "\n".join(r[0] for r in spark.read.text(str(tmp_path / "dot")).collect())
    assert '1 -> 2 [label="5"];' in text and '3 -> 1 [label="7" style="dotted"];' in text


def test_streaming_append(spark, tmp_path):
    from stratalog.streaming.append import append_runs

    sets = [[1], [1, 2], [2], [1, 2], [1]]
    schema = "room string, sg long, events array<long>"
    for part, rows in enumerate(([0, 1], [2, 3], [4])):
        spark.createDataFrame([("r", i, sets[i]) for i in rows], schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(part)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "in" / "*"))
    q = append_runs(stream).writeStream.format("memory").queryName("runs_out").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r)[1:] for r in spark.table("runs_out").collect()} == {(1, 0, 2), (2, 1, 4)}


def test_least_hashes_are_those_of_a_plain_loop():
    from stratalog.functions.signatures import PRIME, least_hashes, permutations

    a, b = permutations(16)
    sets = [[0, 5, PRIME - 1], [], [PRIME - 1], [3] * 4, []]
    found = least_hashes(np.array([x for s in sets for x in s], dtype=np.int64), np.array([len(s) for s in sets]), a, b)
    assert found.tolist() == [[min((x * h + y) % PRIME for h in s) if s else -1 for x, y in zip(a, b)] for s in sets]


def test_matrix_of_a_room_is_that_of_the_pairs(spark):
    from stratalog.operators import ordering, segments

    rng = np.random.default_rng(3)
    rows = [("a", i, rng.integers(0, 9, 128).tolist(), rng.integers(0, 30, 16).tolist()) for i in range(12)]
    rows += [("a", 12, list(range(100, 228)), list(range(100, 116)))]
    hashes = spark.createDataFrame(rows, "room string, sg long, minhash array<int>, lsh_bands array<long>")
    labelled = spark.createDataFrame([("a", i, i // 2) for i in range(13)], "room string, sg long, segment long")
    d = ordering.distance_matrix(segments.segment_signatures(labelled, hashes).toPandas().sort_values("segment", ignore_index=True))
    pairs = segments.segment_distance(labelled, hashes).collect()
    assert len(pairs) == d.size and all(d[r["i"], r["j"]] == r["distance"] for r in pairs)


def test_closure_of_a_forest_and_of_several_parents(spark):
    from stratalog.operators import resolve
    from stratalog.sources.histories import History

    groups = spark.createDataFrame([("a", i) for i in range(9)], "room string, sg long")
    deltas = spark.createDataFrame([("a", i, "t", str(i % 3), i) for i in range(9)], "room string, sg long, type string, state_key string, event long")
    for edges in ([(i, i - 1) for i in range(1, 9)], [(1, 0), (2, 0), (3, 1), (3, 2), (4, 3), (4, 0), (7, 4)]):
        h = History(groups, spark.createDataFrame([("a", *e) for e in edges], "room string, sg long, prev long"), deltas)
        depth = {}
        for sg in range(9):
            level, d = {sg}, 0
            while level:
                for x in level:
                    depth.setdefault((sg, x), d)
                level, d = {p for c, p in edges if c in level}, d + 1
        found = resolve.closure(h)
        assert sorted((r["sg"], r["anc"], r["depth"]) for r in found.collect()) == sorted((*k, v) for k, v in depth.items())
        best = {}
        for (sg, anc), d in depth.items():
            best[sg, str(anc % 3)] = max(best.get((sg, str(anc % 3)), (-99, -99)), (-d, anc))
        state = {(r["sg"], r["state_key"]): r["event"] for r in resolve.full_state(h, found).collect()}
        assert state == {k: anc for k, (_, anc) in best.items()}
        assert h.forest == (len({c for c, _ in edges}) == len(edges))
