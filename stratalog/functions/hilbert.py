"""Hilbert-curve keys of signatures."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def hilbert_index(point: list[int], bits: int) -> int:
    """Place of a point on the Hilbert curve through a cube of 2^bits a side, by Gray-code transposition."""
    x, n = list(point), len(point)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        mask = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= mask
            else:
                t = (x[0] ^ x[i]) & mask
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, top
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    key = 0
    for bit in range(bits - 1, -1, -1):
        for v in x:
            key = key << 1 | ((v ^ t) >> bit & 1)
    return key


def hilbert_indexes(points: np.ndarray, bits: int) -> np.ndarray:
    """The upper 63 bits of ``hilbert_index`` of each row of ``points``, all rows together."""
    x, n = [c.copy() for c in points.astype(np.int64).T], points.shape[1]
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        mask = q - 1
        for i in range(n):
            up = (x[i] & q) != 0
            t = np.where(up, 0, (x[0] ^ x[i]) & mask)
            x[0] ^= np.where(up, mask, t)
            x[i] ^= t
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros(len(points), dtype=np.int64)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
    key, left = np.zeros(len(points), dtype=np.int64), min(63, n * bits)
    for bit in range(bits - 1, -1, -1):
        for v in x:
            if left:
                key, left = key << 1 | ((v ^ t) >> bit & 1), left - 1
    return key


def folded_indexes(minhash: np.ndarray, dims: int = 8, bits: int = 8) -> np.ndarray:
    """The keys of ``folded_key``, a row a signature."""
    run = minhash.shape[1] // dims
    return hilbert_indexes(minhash[:, : run * dims].astype(np.int64).reshape(len(minhash), dims, run).sum(2) % (1 << bits), bits)


def _points(rows: pd.Series) -> np.ndarray | None:
    """Rows as a matrix; None if they differ in length or hold nulls."""
    try:
        found = np.stack([np.asarray(row) for row in rows])
    except (TypeError, ValueError):
        return None
    return found.astype(np.int64) if found.dtype.kind == "i" else None


def hilbert_key(values: Column, bits: int = 8) -> Column:
    """The upper 63 bits of the key of an array of numbers, each taken modulo 2^bits."""

    @F.pandas_udf("long")
    def key(rows: pd.Series) -> pd.Series:
        def one(row) -> int:
            full = len(row) * bits
            return hilbert_index([int(v) % (1 << bits) for v in row], bits) >> max(0, full - 63)

        points = _points(rows)
        return rows.map(one) if points is None else pd.Series(hilbert_indexes(points % (1 << bits), bits))

    return key(values)


def folded_key(minhash: Column, dims: int = 8, bits: int = 8) -> Column:
    """The key of ``dims`` sums of equal runs of a signature, one bit less than 64."""

    @F.pandas_udf("long")
    def key(rows: pd.Series) -> pd.Series:
        def one(row) -> int:
            run = len(row) // dims
            sums = [sum(int(v) for v in row[i * run : (i + 1) * run]) % (1 << bits) for i in range(dims)]
            return hilbert_index(sums, bits) >> max(0, dims * bits - 63)

        points = _points(rows)
        return rows.map(one) if points is None else pd.Series(folded_indexes(points, dims, bits))

    return key(minhash)
