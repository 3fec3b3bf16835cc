"""Hashed word shingles of Arrow text columns, in numpy over the UTF-8 bytes."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa

WIDTH = 5
CHUNK = 1 << 16  # bytes hashed at a time; tables and passes over them stay in the cache
BASE = 0x9E3779B97F4A7C15
U = np.uint64


@lru_cache(maxsize=1)
def tables(size: int = CHUNK):
    """A random value for each byte, the powers of BASE, and those of its inverse, modulo 2^64."""
    rng = np.random.default_rng(20240229)
    of_byte = rng.integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
    lower = np.arange(256)
    lower[65:91] += 32
    of_byte = of_byte[lower]  # A to Z count as a to z
    space = np.zeros(256, dtype=bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    inverse = pow(BASE, -1, 1 << 64)
    powers, inverses = np.full(size + 1, U(BASE)), np.full(size + 1, U(inverse))
    powers[0] = inverses[0] = 1
    return of_byte, space, np.cumprod(powers), np.cumprod(inverses), rng.integers(1, 1 << 63, WIDTH, dtype=np.uint64) | U(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_spans(gap: np.ndarray, starts_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first byte of every word and of the byte after it; ``gap``: bytes that separate words.

    ``starts_at``: offsets at which a new text begins; no word goes on across them.
    """
    if len(gap) == 0 or gap.all():
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    first = ~gap
    first[1:] &= gap[:-1]
    new = starts_at[starts_at < len(gap)]
    first[new] = ~gap[new]
    last = ~gap
    last[:-1] &= gap[1:]
    before = new[new > 0] - 1
    last[before] = ~gap[before]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span of bytes, A to Z as a to z; spans rise and do not overlap."""
    of_byte, _, powers, inverses, _ = tables()
    out = np.empty(len(begins), dtype=U)
    at = 0
    while at < len(begins):
        low = begins[at]
        stop = int(np.searchsorted(ends, low + CHUNK, side="right"))
        if stop <= at:  # one word longer than a chunk: by a digest of its own
            raw = data[low : ends[at]].tobytes().lower()
            out[at] = U(int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little"))
            at += 1
            continue
        part = data[low : ends[stop - 1]]
        sums = np.zeros(len(part) + 1, dtype=U)
        np.cumsum(of_byte[part] * powers[: len(part)], out=sums[1:])
        b, e = begins[at:stop] - low, ends[at:stop] - low
        out[at:stop] = mixed((sums[e] - sums[b]) * inverses[b])
        at = stop
    return out


def word_hashes(data: np.ndarray, starts_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place of its first byte) of every word; ``starts_at``: offsets at which a new text begins."""
    begins, ends = word_spans(tables()[1][data], starts_at)
    return span_hashes(data, begins, ends), begins


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, nulls as empty, and its offsets, one more than rows."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, bounds - bounds[0]


def sets_of(column: pa.Array):
    """For each text its sorted distinct shingle hashes (63 bits).

    A shingle is five neighbouring words; a text of fewer words is one shingle, one without words has none.
    """
    *_, factors = tables()
    for at in range(0, len(column), 256):
        part = column.slice(at, 256)
        data, bounds = text_bytes(part)
        words, places = word_hashes(data, bounds[:-1])
        owners = np.searchsorted(places, bounds)
        full = np.zeros(max(0, len(words) - WIDTH + 1), dtype=U)
        for i in range(WIDTH if len(full) else 0):
            full += words[i : len(full) + i] * factors[i]
        full = mixed(full) >> U(1)
        for a, b in zip(owners[:-1].tolist(), owners[1:].tolist()):
            if b - a >= WIDTH:
                yield np.unique(full[a : b - WIDTH + 1])
            elif b > a:
                with np.errstate(over="ignore"):
                    one = (words[a:b] * factors[: b - a]).sum(dtype=U) + U(b - a)
                yield mixed(np.array([one], dtype=U)) >> U(1)
            else:
                yield np.zeros(0, dtype=U)


def digest(hashes: np.ndarray) -> int:
    """62 bits that identify a set."""
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little") >> 2


def packed(hashes: np.ndarray) -> bytes:
    """The upper 48 of 64 bits of each hash, sorted."""
    return np.ascontiguousarray((hashes << U(1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def sketch(hashes: np.ndarray) -> bytes:
    """Parities of the hashes by place in a bitmap of at least two bits a hash, a power of two in all.

    Two bitmaps, the longer one folded, differ in no more bits than their sets have unlike members.
    """
    bits = 1 << max(6, (2 * len(hashes) - 1).bit_length())
    parity = np.bincount((hashes & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").tobytes()


def unlike(a: bytes, b: bytes) -> int:
    """A lower bound of the number of members that only one of the two sets has."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())
