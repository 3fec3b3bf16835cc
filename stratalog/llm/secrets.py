"""Secret scan: fixed patterns, and a token-efficiency test for random strings."""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
# runs are maximal, so asking for the length at once finds the same spans as dropping short runs afterwards
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST = 16  # the ratio finds 99.9 % of random [A-Za-z0-9] keys of this length; at 12, 45 words of sf0.01's 1,000 texts pass it too, at 16 none
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}(?![A-Za-z0-9+/_=-])" % LEAST)
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
DIGEST = re.compile(r"([0-9a-f]+|[0-9A-F]+)")
DIGEST_LENGTHS = frozenset((32, 40, 48, 56, 64, 96, 128))
SEPARATED = re.compile(r"[A-Za-z]{2,}\d{0,4}([_/=+-]+[A-Za-z]{2,}\d{0,4})*[_/=+-]*")
CASED_END = re.compile(r"[A-Z][a-z]{2,}\Z")
CASED_REST = re.compile(r"(\d{1,2}([A-Z][a-z]{2,}\d{0,2})*)?")

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"


@lru_cache(maxsize=1)
def encoding(path: str | None = None):
    """The public byte-level vocabulary as a tiktoken encoding without special tokens."""
    import public_tokenizers as P
    import tiktoken

    with open(path or P.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def is_identifier(string: str) -> bool:
    """Words with separators between, or letters that end in capitalised words, behind each of which a few digits may stand.

    Takes time in proportion to the string.
    """
    if SEPARATED.fullmatch(string):
        return True
    letters = re.match(r"[A-Za-z]*", string)[0]
    return bool(CASED_END.search(letters) and CASED_REST.fullmatch(string, len(letters)))


def looks_random(string: str, ratio: float, path: str | None = None) -> bool:
    """Fewer than ``ratio`` characters a token, and a letter.

    Known digests (hex of a usual length), UUIDs and identifiers, whose every word is token-efficient by itself, are no
    secrets.
    """
    if not re.search(r"[A-Za-z]", string) or len(string) >= ratio * tokens(string, path):
        return False
    if UUID.fullmatch(string) or DIGEST.fullmatch(string) and len(string) in DIGEST_LENGTHS:
        return False
    words = re.findall(r"[A-Za-z]+", string)
    return not (is_identifier(string) and all(len(w) >= ratio * tokens(w, path) for w in words))


def tokens(string: str, path: str | None = None) -> int:
    return len(encoding(path).encode_ordinary(string))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of sorted spans as sorted spans that do not meet."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def scan(text: str, ratio: float = 2.0, path: str | None = None) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of every span, sorted; offsets are code points, ends exclusive.

    Strings that may be random are looked for beside the spans of the fixed kinds, in one pass over both.
    """
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    taken, k = merged(sorted((a, b) for a, _, b in found)), 0
    for m in CANDIDATE.finditer(text):
        at = m.start()
        while k < len(taken) and taken[k][1] <= at:
            k += 1
        parts = []
        while k < len(taken) and taken[k][0] < m.end():
            parts.append((at, taken[k][0]))
            at = max(at, taken[k][1])
            if at >= m.end():
                break
            k += 1
        for a, b in [*parts, (at, m.end())]:
            if b - a >= LEAST and looks_random(text[a:b], ratio, path):
                found.append((a, 3, b))
    return sorted(found)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def find_secrets(docs: DataFrame, ratio: float = 2.0, vocabulary: str | None = None) -> DataFrame:
    """One row per row of ``docs``, repeated ones too: doc_id, a count for each kind, base_sha256 and all spans.

    Reads whole texts in one pass without a shuffle.  Null texts count as empty; a text without findings has zero
    counts, an empty list and the digest of the empty list.  Only doc_id and text are read of ``docs``.
    """

    def batches(found):
        for batch in found:
            rows = {name: [] for name in ("doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans")}
            for i, text in zip(batch.column(0), batch.column(1)):
                spans = scan(text.as_py() or "", ratio, vocabulary)
                rows["doc_id"].append(i.as_py())
                for kind, name in enumerate(KINDS):
                    rows[f"n_{name}"].append(sum(x[1] == kind for x in spans))
                base = listed([x for x in spans if x[1] < 3])
                rows["base_sha256"].append(hashlib.sha256(base.encode()).hexdigest())
                rows["spans"].append(listed(spans))
            yield pa.RecordBatch.from_pydict(rows, schema=ARROW)

    return in_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(batches, SCHEMA)


ARROW = pa.schema([("doc_id", pa.int64()), *((f"n_{kind}", pa.int64()) for kind in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])


def redact(docs: DataFrame, ratio: float = 2.0) -> DataFrame:
    """``docs`` with every span replaced by ``[kind]``, for use in a pipeline; null texts stay null."""
    fields = docs.columns

    def batches(found):
        for batch in found:
            texts = []
            for text in batch.column(fields.index("text")).to_pylist():
                end, parts = 0, []
                for a, kind, b in scan(text, ratio) if text else ():
                    if a >= end:
                        parts += [text[end:a], f"[{KINDS[kind]}]"]
                    end = max(end, b)
                texts.append(text if not parts else "".join(parts) + text[end:])
            at = fields.index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return in_batches(docs).mapInArrow(batches, docs.schema)
