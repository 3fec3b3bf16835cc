"""Orderings of a room's groups; each returns (room, sg, ordering), and only the relative order of (ordering, sg) counts.

Rooms are independent, so solvers run as one Arrow group a room.  A room's matrix is over its segments, not its groups.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hilbert import folded_key, hilbert_key
from ..schemas import PARAMS
from ..session import stage
from ..sources.histories import History
from . import solvers

SCHEMA = "room string, sg long, ordering long"


def _owned(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (value, owner), rising."""
    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.lexsort((owner, values))
    values, owner = values[order], owner[order]
    new = np.append(True, (values[1:] != values[:-1]) | (owner[1:] != owner[:-1]))[: len(values)]
    return values[new], owner[new]


def common(rows: list[np.ndarray], columns: list[np.ndarray], most_pairs: int = 1 << 20) -> np.ndarray:
    """How many distinct values each of ``rows`` shares with each of ``columns``; values that occur on one side only cost nothing."""
    n, m = len(rows), len(columns)
    (left, mine), (right, theirs) = _owned(rows), _owned(columns)
    low = np.searchsorted(right, left, "left")
    count = np.searchsorted(right, left, "right") - low
    out, total, begin = np.zeros(n * m, dtype=np.int16), np.cumsum(count), 0
    while begin < len(left):
        done = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, done + max(most_pairs, n * m), "right")))
        c = count[begin:end]
        at = np.repeat(low[begin:end] - (np.cumsum(c) - c), c) + np.arange(c.sum())
        out += np.bincount(np.repeat(mine[begin:end], c) * m + theirs[at], minlength=n * m).astype(np.int16)
        begin = end
    return out.reshape(n, m)


def distance_matrix(rows: pd.DataFrame, n: int = PARAMS.permutations, bands: int = PARAMS.bands) -> np.ndarray:
    """The matrix of ``segments.segment_distance`` from a room's ``segment_signatures``, in order of segments."""
    return distances(*(rows[x].tolist() for x in ("end_minhash", "end_bands", "start_minhash", "start_bands")), n, bands)


def distances(end_minhash, end_bands, start_minhash, start_bands, n: int = PARAMS.permutations, bands: int = PARAMS.bands) -> np.ndarray:
    """The matrix from the signatures of segments' ends and starts, one a row."""
    if not len(end_bands):
        return np.zeros((0, 0), dtype=np.int64)
    k = common(end_bands, start_bands)
    d = np.where(k > 0, (bands - k) * (n // bands), n - common(end_minhash, start_minhash)).astype(np.int64)
    np.fill_diagonal(d, 0)
    return d


def dealt(signed: DataFrame) -> DataFrame:
    """Rooms over all cores: they are few bytes and much work, so their number of partitions is not coalesced by size."""
    spark = signed.sparkSession
    return signed.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), "room")


def room_distances(signed: DataFrame) -> DataFrame:
    """``segments.segment_distance`` from ``segment_signatures``, a room's matrix at once."""

    def room(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("segment", ignore_index=True)
        d, names = distance_matrix(rows), rows["segment"].to_numpy()
        return pd.DataFrame({"room": rows["room"].iloc[0], "i": np.repeat(names, len(names)), "j": np.tile(names, len(names)), "distance": d.ravel()})

    return dealt(signed).groupBy("room").applyInPandas(room, "room string, i long, j long, distance long")


def solver_of(name: str, colony: solvers.Colony = solvers.Colony()) -> Callable[[np.ndarray], list[int]]:
    return {
        "greedy": solvers.greedy,
        "mst": lambda d: solvers.tree_walk(d, solvers.minimum_spanning_tree(d)),
        "dfs": lambda d: solvers.tree_walk(d, solvers.minimum_spanning_tree(d), depth_first=True),
        "msa": solvers.arborescence_walk,
        "tsp": solvers.travelling,
        "aco": lambda d: solvers.ant_colony(d, colony)[0],
    }[name]


def by_segments(labelled: DataFrame, signed: DataFrame, solver: str, colony: solvers.Colony = solvers.Colony()) -> DataFrame:
    """Solves each room's segment matrix and lays out the groups by segment rank; raises if a segment is lost.

    A room's segments travel as two signatures each (``signed``, of ``segment_signatures``) and become a matrix in its task.
    """
    solve = solver_of(solver, colony)

    def room(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("segment", ignore_index=True)
        n = len(rows)
        path = solvers.check_permutation(solve(distance_matrix(rows)), n)
        return pd.DataFrame({"room": rows["room"].iloc[0], "segment": rows["segment"].to_numpy()[path], "rank": range(n)})

    ranks = stage(dealt(signed).groupBy("room").applyInPandas(room, "room string, segment long, rank long"), "ranks")
    return labelled.join(ranks, ["room", "segment"]).select("room", "sg", F.col("rank").alias("ordering"))


def by_branches(hashes: DataFrame, found: DataFrame) -> DataFrame:
    """Moves each branch's run of groups behind its look-alike; a branch ends where the next one starts."""
    ends = found.withColumn("end", F.lead("start").over(Window.partitionBy("room").orderBy("start")))
    both = hashes.select("room", "sg", F.lit(None).cast("long").alias("end"), F.lit(None).cast("long").alias("branch"))
    both = both.unionByName(ends.select("room", F.col("start").alias("sg"), F.coalesce("end", F.lit((1 << 63) - 1)).alias("end"), "branch"))

    def room(rows: pd.DataFrame) -> pd.DataFrame:
        marks = rows[rows["branch"].notna()].sort_values("sg")
        moves = [(int(r.sg), int(r.end), int(r.branch)) for r in marks.itertuples()]
        nodes = sorted(int(x) for x in rows["sg"][rows["branch"].isna()])
        out = solvers.reorder(nodes, moves)
        if len(out) != len(nodes):
            raise ValueError("the ordering lost groups")
        return pd.DataFrame({"room": rows["room"].iloc[0], "sg": out, "ordering": range(len(out))})

    return both.groupBy("room").applyInPandas(room, SCHEMA)


def by_hilbert(hashes: DataFrame, bits: int = 8, folded: bool = False) -> DataFrame:
    key = folded_key(F.col("minhash"), bits=bits) if folded else hilbert_key(F.col("lsh_bands"), bits)
    return hashes.select("room", "sg", key.alias("ordering"))


def by_topology(history: History, chunk_of: DataFrame) -> DataFrame:
    """Chunks by their smallest group, topological inside each; the edges of a room must hold no cycle."""
    rows = history.groups.join(chunk_of, ["room", "sg"]).join(history.edges, ["room", "sg"], "left").select("room", "sg", "chunk", "prev")

    def chunk(part: pd.DataFrame) -> pd.DataFrame:
        nodes = sorted(set(part["sg"].tolist()))
        edges = [(int(a), int(b)) for a, b in zip(part["sg"], part["prev"]) if pd.notna(b)]
        out = solvers.topological(nodes, edges)
        return pd.DataFrame({"room": part["room"].iloc[0], "chunk": part["chunk"].iloc[0], "sg": out, "at": range(len(out))})

    placed = rows.groupBy("room", "chunk").applyInPandas(chunk, "room string, chunk long, sg long, at long")
    order = Window.partitionBy("room").orderBy("chunk", "at")
    return placed.select("room", "sg", (F.row_number().over(order) - 1).cast("long").alias("ordering"))


def by_ids(order: DataFrame) -> DataFrame:
    """Pairs ranks: the k-th group of the new order takes the k-th smallest group id as its ordering."""
    new = order.withColumn("k", F.row_number().over(Window.partitionBy("room").orderBy("ordering", "sg")))
    ids = order.select("room", F.col("sg").alias("id"), F.row_number().over(Window.partitionBy("room").orderBy("sg")).alias("k"))
    return new.join(ids, ["room", "k"]).select("room", "sg", F.col("id").alias("ordering"))
