"""MinHash signatures and what is computed from them, as column expressions."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import PARAMS

PRIME = (1 << 31) - 1


def permutations(n: int = PARAMS.permutations, seed: int = PARAMS.seed) -> tuple[list[int], list[int]]:
    """Constants a, b of the hash family (a * h + b) mod 2^31 - 1; products stay below 2^62."""
    rng = random.Random(seed)
    return [rng.randrange(1, PRIME) for _ in range(n)], [rng.randrange(PRIME) for _ in range(n)]


def md5_long(text: Column) -> Column:
    """The first 8 hex digits of the md5 as a number; any engine can compute it."""
    return F.conv(F.substring(F.md5(text.cast("string").cast("binary")), 1, 8), 16, 10).cast("long")


def least_hashes(flat: np.ndarray, lengths: np.ndarray, a: list[int], b: list[int]) -> np.ndarray:
    """For each set, laid out one after another in ``flat``, the least (a * h + b) mod 2^31 - 1 of each permutation; -1 for an empty set."""
    out = np.full((len(lengths), len(a)), -1, dtype=np.int32)
    some = np.flatnonzero(lengths)
    if len(some):
        starts = (np.cumsum(lengths) - lengths)[some]
        for i, (x, y) in enumerate(zip(a, b)):
            v = flat * x + y  # below 2^62 + 2^31
            v = (v & PRIME) + (v >> 31)
            v = (v & PRIME) + (v >> 31)
            out[some, i] = np.minimum.reduceat(np.where(v == PRIME, 0, v), starts)
    return out


def signatures(members: DataFrame, n: int = PARAMS.permutations, bands: int = PARAMS.bands) -> DataFrame:
    """(room, sg, minhash, lsh_bands) from (room, sg, member); null members count for nothing, a set of them has a signature of nulls.

    Array lambdas are interpreted for each member and permutation, so Arrow batches go through numpy instead.
    """
    a, b = permutations(n)
    hashed = members.groupBy("room", "sg").agg(F.array_distinct(F.collect_list(F.pmod(md5_long(F.col("member")), F.lit(PRIME)))).alias("h"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = batch.column("h")
            lengths = sets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            least = least_hashes(sets.flatten().to_numpy(zero_copy_only=False).astype(np.int64), lengths, a, b)
            values = pa.array(least.ravel(), mask=least.ravel() < 0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(least) + 1, dtype=np.int32) * n), values)
            yield pa.RecordBatch.from_arrays([batch.column("room"), batch.column("sg"), lists], ["room", "sg", "minhash"])

    kinds = members.schema
    schema = T.StructType([T.StructField("room", kinds["room"].dataType), T.StructField("sg", kinds["sg"].dataType), T.StructField("minhash", T.ArrayType(T.IntegerType()))])
    return hashed.mapInArrow(sign, schema).withColumn("lsh_bands", lsh_bands(F.col("minhash"), n, bands))


def lsh_bands(minhash: Column, n: int = PARAMS.permutations, bands: int = PARAMS.bands) -> Column:
    width = n // bands
    return F.array(*(md5_long(F.array_join(F.slice(minhash, width * k + 1, width).cast("array<string>"), ",")) for k in range(bands)))


def jaccard(a: Column, b: Column) -> Column:
    """Share of positions in which two signatures are equal, of the first one's length."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return same / F.size(a)


def placed(minhash: Column) -> Column:
    """The values of a signature with their places, as numbers: two signatures share as many of them as they have equal positions."""
    return F.array_compact(F.transform(minhash, lambda x, i: x.cast("long") + i.cast("long") * F.lit(1 << 31)))


def shared_bands(mine: Column, other: Column) -> Column:
    """How many of ``mine`` occur in ``other``, repeats counted."""
    return F.size(F.filter(mine, lambda x: F.array_contains(other, x)))


def set_distance(a: Column, b: Column) -> Column:
    """Length less the number of distinct common values."""
    return F.size(a) - F.size(F.array_intersect(a, b))


def tiered_distance(bands_a: Column, bands_b: Column, minhash_a: Column, minhash_b: Column, n: int = PARAMS.permutations, bands: int = PARAMS.bands) -> Column:
    """By common bands if there are any, else by common values, up to ``n``."""
    k = F.size(F.array_intersect(bands_a, bands_b))
    return F.when(k > 0, (bands - k) * (n // bands)).otherwise(n - F.size(F.array_intersect(minhash_a, minhash_b)))


def hex8(x: Column) -> Column:
    """Eight lower-case hex digits of the two's complement of a 32-bit number."""
    return F.lpad(F.lower(F.hex(F.pmod(x.cast("long"), F.lit(1 << 32)))), 8, "0")
