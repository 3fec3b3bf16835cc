"""Harmonic packing of token sequences into training sequences of one capacity."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_batches, trimmed
from .secrets import encoding

END_ID = 1
CAPACITY = 2048
BATCH = 512  # pieces of an output batch, 4 MB of ids at most

PIECE = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
    ]
)


@lru_cache(maxsize=1)
def tokenizer(path: str | None = None):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path or P.path("byte_bpe_50k.json"))


def token_ids(text: str) -> list[int]:
    """Ids of the tokenizers file, without special tokens added.

    The tiktoken form of the same vocabulary gives the same ids several times faster; only a text that spells a special
    token, which the tokenizers file maps to an id of its own, goes to the slower library.
    """
    if "<|endoftext|>" in text:
        return tokenizer().encode(text, add_special_tokens=False).ids
    return encoding().encode_ordinary(text)


def cuts(n: int, capacity: int = CAPACITY, slack: float = 0.03, least: int = 32) -> list[int]:
    """Piece lengths for ``n`` ids: whole sequences first, then each piece close to capacity / k for some k.

    A rest of r ids is in class k = capacity // r, whose bins take k pieces.  If r falls short of capacity // k by
    more than ``slack``, the largest capacity // (k + 1) is cut off it first.  Rests under ``least`` are left whole.
    """
    pieces = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        if rest < least or rest >= (1 - slack) * (capacity // k):
            pieces.append(rest)
            break
        pieces.append(capacity // (k + 1))
        rest -= pieces[-1]
    return pieces


class Packer:
    """Bins of one worker: class k's open bin is closed at k pieces; pieces of bins still open at the end are refilled."""

    def __init__(self, worker: int, capacity: int = CAPACITY):
        self.capacity, self.next_id = capacity, worker << 33
        self.open: dict[int, list] = {}

    def close(self, pieces: list) -> list[tuple]:
        offset, out = 0, []
        for doc_id, start, ids, total in pieces:
            out.append((doc_id, start, len(ids), ids.tobytes(), total, self.next_id, offset))
            offset += len(ids)
        self.next_id += 1
        return out

    def add(self, doc_id, start: int, ids: np.ndarray, total: int) -> list[tuple]:
        k = self.capacity // len(ids)
        bin_ = self.open.setdefault(k, [])
        bin_.append((doc_id, start, ids, total))
        return self.close(self.open.pop(k)) if len(bin_) == k else []

    def finish(self):
        """First fit in order of falling length over what is left, at most one open bin for each class."""
        bins: list[list] = []
        room: list[int] = []
        for piece in sorted((p for b in self.open.values() for p in b), key=lambda p: -len(p[2])):
            at = next((i for i, r in enumerate(room) if r >= len(piece[2])), None)
            if at is None:
                bins.append([])
                room.append(self.capacity)
                at = len(bins) - 1
            bins[at].append(piece)
            room[at] -= len(piece[2])
        for b in bins:
            yield self.close(b)


def pack(docs: DataFrame, capacity: int = CAPACITY, slack: float = 0.03, least: int = 32) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset.

    Every worker tokenizes and packs its own input partition in one pass and never exchanges rows; it holds at most one
    open bin for each class.  Null texts count as empty; an empty text is its end id alone.  Repeated rows are packed
    as often as they occur; a null doc_id stays null; an empty table gives no rows.  Of ``docs`` only doc_id and text
    are read.  A retried task packs the same rows in the same order into the same sequence ids.
    """

    def worker(batches):
        from pyspark import TaskContext

        packer = Packer(TaskContext.get().partitionId(), capacity)
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0), batch.column(1)):
                ids = np.array([*token_ids(text.as_py() or ""), END_ID], dtype="<u4")
                doc_id, start = i.as_py(), 0
                for length in cuts(len(ids), capacity, slack, least):
                    rows += packer.add(doc_id, start, ids[start : start + length], len(ids))
                    start += length
                if len(rows) >= BATCH:
                    yield as_batch(rows)
                    rows = []
            yield as_batch(rows)
        for rows in packer.finish():
            yield as_batch(rows)

    return in_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(trimmed(worker), PIECE)


ARROW = pa.schema([(f.name, pa.binary() if f.name == "ids" else pa.int64()) for f in PIECE.fields])


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in ARROW]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW)], schema=ARROW)
