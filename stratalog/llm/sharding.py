"""Shards of near equal bytes by a histogram sort."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, free_name, text_of

TOP = 1 << 63  # keys are below


def sort_key(id_col: str, crc: Column) -> Column:
    """crc32 of the text, then 31 bits of the id's hash: equal texts are neighbours, yet can be split."""
    return F.shiftleft(crc, 31) + F.pmod(F.xxhash64(id_col, crc), F.lit(1 << 31))


def histogram(keys: DataFrame, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows below each of the sorted probes: every task counts, only sums are exchanged."""
    bounds = np.asarray(probes, dtype=np.int64)

    def task(batches):
        size, rows = np.zeros(len(bounds) + 1, dtype=np.int64), np.zeros(len(bounds) + 1, dtype=np.int64)
        for batch in batches:
            at = np.searchsorted(bounds, batch.column(0).to_numpy(), side="right")
            np.add.at(size, at, batch.column(1).to_numpy())
            rows += np.bincount(at, minlength=len(rows))
        full = np.flatnonzero(rows)
        yield pa.RecordBatch.from_pydict({"at": full.astype(np.int64), "size": size[full], "rows": rows[full]})

    counted = keys.select("key", "size").mapInArrow(task, "at long, size long, rows long")
    counted = counted.groupBy("at").agg(F.sum("size").alias("size"), F.sum("rows").alias("rows"))
    sums = np.zeros((len(bounds) + 1, 2), dtype=np.int64)
    for r in counted.collect():  # at most one row for each probe
        sums[r["at"]] = r["size"], r["rows"]
    below = np.cumsum(sums, axis=0)[:-1]
    return below[:, 0], below[:, 1]


def splitters(keys: DataFrame, shards: int, tolerance: float, probes: int = 128) -> list[int]:
    """Keys that cut all bytes into ``shards`` parts, each within ``tolerance`` of a part's size of its place.

    Between the nearest keys known below and above a goal the next probes are spread evenly, with half of them around
    where linear interpolation puts the goal.  Every round cuts what is open to a third at most, and it goes on until
    each goal is met or lies between neighbouring keys: then the nearer one is exact, since rows with one key stay together.
    """
    total = int(keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
    goals = np.array([total * i // shards for i in range(1, shards)], dtype=np.int64)
    low, at_low = np.zeros(len(goals), np.int64), np.zeros(len(goals), np.int64)
    high, at_high = np.full(len(goals), TOP - 1), np.full(len(goals), total)
    each = max(4, probes // max(1, len(goals)))
    steps = np.arange(1, each // 2 + 1)
    while True:
        open_ = (np.minimum(goals - at_low, at_high - goals) > tolerance * total / shards) & (high - low > 1)
        if not open_.any():
            break
        a, gap = low[open_], high[open_] - low[open_]
        guess = a + (gap * ((goals - at_low)[open_] / np.maximum(1, (at_high - at_low)[open_]))).astype(np.int64)
        wide = np.maximum(1, gap // (each * 8))
        even = a[:, None] + gap[:, None] // (len(steps) + 1) * steps + gap[:, None] % (len(steps) + 1) * steps // (len(steps) + 1)
        near = np.clip(guess[:, None] + wide[:, None] * (steps - 1 - each // 4), a[:, None] + 1, (a + gap - 1)[:, None])
        tried = np.unique(np.concatenate([even.ravel(), near.ravel()]))
        size, _ = histogram(keys, tried)
        # the last probe with at most the goal below it, and the first with at least the goal
        under, over = np.searchsorted(size, goals, side="right") - 1, np.searchsorted(size, goals, side="left")
        better = (under >= 0) & (tried[under] > low)
        low[better], at_low[better] = tried[under][better], size[under][better]
        better = over < len(tried)
        better[better] = tried[over[better]] < high[better]
        high[better], at_high[better] = tried[over[better]], size[over[better]]
    return np.where(goals - at_low <= at_high - goals, low, high).tolist()


def shard(docs: DataFrame, shards: int = 8, tolerance: float = 0.001, slice_bytes: int = 256 << 20, most_slices: int = 1 << 14) -> DataFrame:
    """All columns of ``docs`` and size, text_crc32, law, shard, slot, grown_shard; columns of these names are replaced.

    Law ``bytes``: the shards' bytes (UTF-8 of the text, null as none, plus 1 a row) are near equal.  Rows are ordered
    by ``sort_key``, so equal texts are neighbours and share a shard unless a boundary falls among them.  Only rows that
    agree in both id and text have the same key and stay together.  slot is the row's place in its shard, from 0.  Within
    a shard the same search cuts slices of about ``slice_bytes``, so that no task sorts a whole shard; beyond
    ``most_slices`` slices they grow with the input, which bounds the driver's lists.  Narrow (key, size) rows are
    probed; the rows themselves are exchanged once, by slice.  An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "sharding")
    text = text_of("text").cast("binary")
    own = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    kept = [c for c in docs.columns if c.lower() not in own]
    key, place, row = (free_name(docs, c) for c in ("shard_key", "shard_slice", "shard_row"))
    # one pass over the texts for the narrow rows; only these are probed
    crc = F.crc32(text)
    size = (F.octet_length(text) + 1).cast("long")
    rows = docs.select(*kept, size.alias("size"), crc.alias("text_crc32"), sort_key("doc_id", crc).alias(key))
    keys = scratch.write(rows.select(F.col(key).alias("key"), "size"), "keys")
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    slices = max(1, min(-(-total // (shards * slice_bytes)), most_slices // shards))
    coarse = splitters(keys, shards, tolerance)
    bounds = np.unique(np.array(coarse + (splitters(keys, shards * slices, 0.2, probes=16 * shards * slices) if slices > 1 else []), dtype=np.int64))
    below = np.concatenate([[0], histogram(keys, bounds)[1]]).tolist() if len(bounds) else [0]
    shard_of = np.searchsorted(np.sort(coarse), np.concatenate([[0], bounds]), side="right").tolist()
    first: dict[int, int] = {}
    for s, n in zip(shard_of, below):
        first.setdefault(s, n)
    if len(bounds) <= 64:
        at = sum(((F.col(key) >= b).cast("int") for b in bounds.tolist()), F.lit(0))
    else:
        at = F.pandas_udf(lambda key: pd.Series(np.searchsorted(bounds, key, side="right"), dtype="int32"), "int")(key)
    # one row for each slice
    names = [free_name(docs, c) for c in ("slice_number", "slice_shard", "slice_offset")]
    meta = [(i, s, n - first[s]) for i, (s, n) in enumerate(zip(shard_of, below))]
    meta = docs.sparkSession.createDataFrame(meta, f"{names[0]} int, {names[1]} int, {names[2]} long")
    window = Window.partitionBy(place).orderBy(key, "doc_id")
    out = rows.withColumn(place, at).withColumn(row, F.row_number().over(window) - 1)
    out = out.join(F.broadcast(meta), F.col(place) == F.col(names[0]))
    return out.select(
        *kept,
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col(names[1]).alias("shard"),
        (F.col(row) + F.col(names[2])).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
