"""Exact top-k inner products of integer vectors by MaxScore over shards."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

SHARD_ROWS = 8192
QUERY_ROWS = 2048

BLOB = "block int, n int, dims int, kind string, ids binary, values binary"
BLOB_NAMES = ("block", "n", "dims", "kind", "ids", "values")
LEAST_LONG, MOST_LONG = -(2**63), 2**63 - 1
HUGE = float(np.finfo(np.float64).max)


def vectors(embeddings: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and floor(scale * x) of every component, a whole number in a double; rows with a null id, vector or
    component, or one that is not finite, go.  Products beyond doubles count as the largest one.
    """
    v = F.col("embedding")
    good = F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.where(F.coalesce(good, F.lit(False)))

    def whole(x):
        y = F.greatest(F.least(x.cast("double") * scale, F.lit(HUGE)), F.lit(-HUGE))
        return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)  # larger doubles are whole

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, whole).alias("v"))


def blocks(rows: DataFrame, count: int) -> DataFrame:
    """Rows of about equal blocks, each as one row of bytes: ids, and the matrix, shorter vectors with zeros.

    Every row counts, also rows that share an id; they are dealt by their place in the written table ``rows``.  In a
    block the longest vectors come first.
    """

    def build(group: pd.DataFrame) -> pd.DataFrame:
        values = np.zeros((len(group), max(map(len, group["v"]))))
        for row, v in enumerate(group["v"]):
            values[row, : len(v)] = v
        with np.errstate(over="ignore"):
            order = np.lexsort((group["vec_id"], -(values**2).sum(1)))
        most = np.abs(values).max(initial=0)
        kind = "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<f8"
        ids, values = group["vec_id"].to_numpy(np.int64)[order], values[order].astype(kind)
        return pd.DataFrame({"block": group["block"].iloc[:1].to_numpy(), "n": [len(ids)], "dims": [values.shape[1]], "kind": [kind], "ids": [ids.tobytes()], "values": [values.tobytes()]})

    dealt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(count)).cast("int")
    return rows.withColumn("block", dealt).groupBy("block").applyInPandas(build, BLOB)


def max_score(queries: np.ndarray, query_ids: np.ndarray, shard: np.ndarray, ids: np.ndarray, k: int, seed_rows: int = 256):
    """(query row, shard row, score) of each query's ``k`` best of one shard, ties to smaller ids.

    A query's terms are its dimensions; a row's posting in a term is what it adds above the least that any row of the
    shard adds there, so postings are never negative and bounded by the term's width.  Whole scores of the first rows
    give the query's entry threshold.  Terms of small width whose widths, above the sum of all floors, stay under the
    threshold are non-essential: no row without an essential posting can enter.  Essential postings are traversed for
    all rows; the other terms are probed in falling order of width, and only for rows that can still reach the threshold.
    """
    big = int(np.abs(queries).max(initial=0)) * int(np.abs(shard).max(initial=0)) * max(1, shard.shape[1])
    # scores are whole numbers: floats hold them exactly below these sizes
    kind = np.float32 if big < 2**24 else np.float64 if big < 2**53 else np.int64 if big < 2**62 else object
    whole = np.vectorize(int, otypes=[object]) if kind is object else lambda m: m.astype(kind)
    q, x = whole(queries), np.ascontiguousarray(whole(shard).T)
    high, low = x.max(1), x.min(1)
    most = np.maximum(q * high, q * low)
    width = most - np.minimum(q * high, q * low)
    floors = most.sum(1) - width.sum(1)
    order = np.argsort(width, axis=1, kind="stable")
    seed = q @ x[:, :seed_rows]
    own = query_ids[:, None] == ids[None, :seed_rows]
    for i in range(len(q)):
        known = np.sort(seed[i][~own[i]])
        threshold = known[-k] if len(known) >= k else -np.inf
        if kind is object:  # scores count as longs: what is beyond them ties
            threshold = -np.inf if threshold <= LEAST_LONG else min(threshold, MOST_LONG)
        split = int(np.searchsorted(np.cumsum(width[i, order[i]]), threshold - floors[i], side="left"))
        light, heavy = order[i, :split][::-1], order[i, split:]
        rows, score, rest = np.arange(len(ids)), q[i, heavy] @ x[heavy], most[i, light].sum()
        for group in np.array_split(light, 4):
            alive = np.flatnonzero(score + rest >= threshold)
            rows, score = rows[alive], score[alive]
            score = score + q[i, group] @ x[np.ix_(group, rows)]
            rest = rest - most[i, group].sum()
        alive = np.flatnonzero((score >= threshold) & (ids[rows] != query_ids[i]))
        rows, score = rows[alive], score[alive]
        if kind is object:
            score = np.array([max(LEAST_LONG, min(MOST_LONG, s)) for s in score.tolist()], dtype=object)
        best = np.lexsort((ids[rows], -score))[:k]
        for r, s in zip(rows[best].tolist(), score[best].tolist()):
            yield i, r, int(s)


def search(embeddings: DataFrame, every: int = 20, k: int = 20, scale: int = 64, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """For each row whose vec_id is divisible by ``every``: query_id, rank, vec_id, score of its ``k`` best other rows.

    Exact; equal scores go to the smaller vec_id; all are returned if there are fewer than ``k``.  Every row is a
    candidate, also of rows that share a vec_id, but none of the query's own id; rows that ask under one id share its
    ranks.  A score beyond 64 bits counts as the nearest long.  Blocks of queries meet
    shards of rows on the pair of their numbers, one task row for each pair, and the shards' lists are merged by rank.
    Vectors of several lengths are compared with zeros appended.  Empty tables give no rows.
    """
    scratch = Scratch(embeddings.sparkSession, "topk")
    rows = scratch.write(vectors(embeddings, scale), "vectors")
    total = rows.count()
    shards = max(1, -(-total // shard_rows))
    query_blocks = max(1, -(-total // (every * query_rows)))
    index = blocks(rows, shards).withColumnsRenamed({c: f"s_{c}" for c in BLOB_NAMES})
    asked = blocks(rows.where(F.col("vec_id") % every == 0), query_blocks).withColumnsRenamed({c: f"q_{c}" for c in BLOB_NAMES})
    # the stated queries against all rows, in blocks: each block is copied once for each block of the other side
    index = index.withColumn("q_at", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    asked = asked.withColumn("s_at", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    pairs = index.join(asked, (F.col("s_block") == F.col("s_at")) & (F.col("q_block") == F.col("q_at")))

    def task(batches):
        for batch in batches:
            for r in batch.to_pylist():
                dims = max(r["s_dims"], r["q_dims"])
                sides = []
                for side in "sq":
                    values = np.frombuffer(r[f"{side}_values"], dtype=r[f"{side}_kind"]).astype(np.float64).reshape(r[f"{side}_n"], r[f"{side}_dims"])
                    sides += [np.pad(values, ((0, 0), (0, dims - values.shape[1]))), np.frombuffer(r[f"{side}_ids"], dtype=np.int64)]
                shard, ids, queries, query_ids = sides
                out = list(max_score(queries, query_ids, shard, ids, k))
                yield pa.RecordBatch.from_pydict(
                    {"query_id": query_ids[[x[0] for x in out]] if out else pa.array([], pa.int64()), "vec_id": ids[[x[1] for x in out]] if out else pa.array([], pa.int64()), "score": pa.array([x[2] for x in out], pa.int64())}
                )

    columns = [f"{side}_{c}" for side in "sq" for c in BLOB_NAMES[1:]]
    found = pairs.select(*columns).mapInArrow(task, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
