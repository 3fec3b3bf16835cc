"""WARC archives: a writer, a streaming reader, and payload deduplication by revisit records."""

from __future__ import annotations

import gzip
import io
import uuid
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MOST_BROADCAST, Scratch, in_batches

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEAST = 100  # payloads of fewer bytes are never revisits

RECORD = "page_id long, record_type string, payload_digest string, payload_bytes long, intact boolean"
RECORD_ARROW = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("intact", pa.bool_())])
WRITTEN = ("page_id", "url", "payload", "digest", "record_type", "first_url")


def file_system(uri: str):
    """The file system of a URI and the path in it; any store that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else f"file://{uri}")


def one_line(text: str) -> str:
    return text.replace("\r", "%0D").replace("\n", "%0A")


def record_bytes(kind: str, fields: list[tuple[str, str]], block: bytes, date: str) -> bytes:
    """One record with a fresh header and an id of its own."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{uuid.uuid4().urn}>"), ("WARC-Date", date), *fields, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(row: dict, date: str) -> bytes:
    """A page's record.  A response holds an HTTP message, a revisit only the head of one and its payload's digest.

    X-Page-ID, an extension field, is the row's page_id.
    """
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    fields = [("WARC-Payload-Digest", f"sha256:{row['digest']}"), ("Content-Type", "application/http; msgtype=response")]
    if row["url"]:
        fields.append(("WARC-Target-URI", one_line(row["url"])))
    if row["page_id"] is not None:
        fields.append(("X-Page-ID", str(row["page_id"])))
    if row["record_type"] == "revisit":
        fields.append(("WARC-Profile", REVISIT_PROFILE))
        if row["first_url"]:
            fields.append(("WARC-Refers-To-Target-URI", one_line(row["first_url"])))
        return record_bytes("revisit", fields, f"{http}\r\n".encode(), date)
    payload = row["payload"] or b""
    return record_bytes("response", fields, f"{http}Content-Length: {len(payload)}\r\n\r\n".encode() + payload, date)


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Writes rows of the columns WRITTEN, one .warc.gz file for each task: a warcinfo record, then one for each row.

    Every record is a gzip member of its own.  A task streams its rows into a file named by itself and returns the name
    after closing it.  Only files of committed tasks are in the result, so a task that is retried or run twice leaves at
    most an unlisted file.  Rows of the result: file, records (of pages).
    """

    def task(batches):
        from pyspark import TaskContext

        fs, base = file_system(folder)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:8]}.warc.gz"
        date, count = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"), 0
        fs.create_dir(base, recursive=True)
        with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
            about = b"software: stratalog\r\nformat: WARC File Format 1.1\r\n"
            info = [("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
            out.write(gzip.compress(record_bytes("warcinfo", info, about, date), 4))
            for batch in batches:
                for row in batch.to_pylist():
                    out.write(gzip.compress(page_record(row, date), 4))
                    count += 1
        yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "records": [count]})

    return in_batches(records).select(*WRITTEN).mapInArrow(task, "file string, records long")


def parse(stream):
    """(header, payload) of every record of a decompressed stream, one at a time."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            if line.strip():
                raise ValueError(f"not a WARC record: {line[:40]!r}")
            continue
        header = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            key, _, value = line.decode("utf-8").rstrip("\r\n").partition(":")
            header[key.lower()] = value.strip()
        payload = stream.read(int(header["content-length"]))
        yield header, payload


def read_archives(files: DataFrame) -> DataFrame:
    """One row per response and revisit of the files named in ``files.file``: page_id, record_type, payload_digest, payload_bytes, intact.

    Of a response digest and size are those of the payload found, and intact tells whether the header's digest agrees.
    Of a revisit the digest is the header's and the size is null.
    """

    def task(batches):
        import hashlib

        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs, path = file_system(name)
                rows: list[tuple] = []
                with fs.open_input_stream(path, compression="gzip") as raw:
                    for h, block in parse(io.BufferedReader(raw, 1 << 18)):
                        kind, digest = h["warc-type"], h.get("warc-payload-digest", "").removeprefix("sha256:")
                        page = int(h["x-page-id"]) if "x-page-id" in h else None
                        if kind == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            found = hashlib.sha256(payload).hexdigest()
                            rows.append((page, kind, found, len(payload), found == digest))
                        elif kind == "revisit":
                            rows.append((page, kind, digest, None, True))
                        if len(rows) >= 10_000:
                            yield as_batch(rows)
                            rows = []
                yield as_batch(rows)

    return files.select("file").mapInArrow(task, RECORD)


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in RECORD_ARROW]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, RECORD_ARROW)], schema=RECORD_ARROW)


def decide(pages: DataFrame, scratch: Scratch, least: int = LEAST) -> DataFrame:
    """Rows of the columns WRITTEN for each page: of equal payloads the smallest page_id is the response.

    Only headers (digest, page_id, url) are shuffled, to find the responses and to join the others to them.  Payloads
    stay where they are read while the revisits are few enough for a broadcast, and are shuffled by page beyond that.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    heads = rows.where(F.octet_length("payload") >= least).groupBy("digest", "page_id").agg(F.min("url").alias("url"))
    heads = scratch.write(heads, "heads")
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")).alias("f")
    firsts = heads.groupBy("digest").agg(first, F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = scratch.write(firsts.select(F.col("digest").alias("of"), F.col("f.page_id").alias("first_id"), F.col("f.url").alias("first_url")), "responses")
    # both sides come from files, so that AQE can split a payload of very many pages
    others = heads.join(firsts, F.col("digest") == F.col("of")).where(~F.col("page_id").eqNullSafe(F.col("first_id")))
    others = scratch.write(others.select(F.col("page_id").alias("other_id"), "of", "first_url", F.lit(True).alias("revisit")), "revisits")
    few = F.broadcast(others) if others.count() <= MOST_BROADCAST else others
    rows = rows.join(few, F.col("page_id").eqNullSafe(F.col("other_id")) & (F.col("digest") == F.col("of")), "left")
    kind = F.when(F.col("revisit"), "revisit").otherwise("response")
    return rows.select("page_id", "url", F.when(F.col("revisit").isNull(), F.col("payload")).alias("payload"), "digest", kind.alias("record_type"), "first_url")


def resolve(records: DataFrame, scratch: Scratch, least: int = LEAST) -> DataFrame:
    """Joins every revisit with the response of its payload digest: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Headers are shuffled by digest; size and refers_to of a revisit are those of the response, of several the smallest
    page_id.  A revisit without its response keeps nulls.
    """
    whole = records.where((F.col("record_type") == "response") & F.col("intact") & (F.col("payload_bytes") >= least))
    whole = whole.groupBy(F.col("payload_digest").alias("of")).agg(F.min("page_id").alias("first_id"), F.max("payload_bytes").alias("full_bytes"))
    rows = records.join(scratch.write(whole, "whole"), F.col("payload_digest") == F.col("of"), "left")
    revisit = F.col("record_type") == "revisit"
    size = F.when(revisit, F.col("full_bytes")).otherwise(F.col("payload_bytes"))
    return rows.select("page_id", size.alias("payload_bytes"), "payload_digest", "record_type", F.when(revisit, F.col("first_id")).alias("refers_to"))


def archive(pages: DataFrame, folder: str | None = None, least: int = LEAST) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as deduplicated archives and reads them back.

    One row per row of ``pages``: page_id, payload_bytes, payload_digest, record_type, refers_to, as the archives hold
    them; a payload that does not have its header's digest raises.  Null html is an empty payload.  Of equal payloads of
    at least ``least`` bytes the smallest page_id is the response; rows that repeat it are responses too, a null page_id
    is one only where all copies have null ids.  An empty table writes no record.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    files = write_archives(decide(pages, scratch, least), folder or scratch.path("archives"))
    # written before it is read: the list of files is the commit
    return read_back(scratch.write(files, "files"), scratch, least)


def read_back(files: DataFrame, scratch: Scratch, least: int = LEAST) -> DataFrame:
    """The resolved records of the listed ``files``; a payload that does not have its header's digest raises ValueError."""
    records = scratch.write(read_archives(files.repartition(max(1, spark_slots(files.sparkSession)))), "records")
    damaged = records.where("not intact").select("page_id").limit(5).collect()
    if damaged:
        raise ValueError(f"payloads differ from their digests, of pages {[r[0] for r in damaged]} and perhaps more")
    return resolve(records, scratch, least)


def spark_slots(spark: SparkSession) -> int:
    return 2 * spark.sparkContext.defaultParallelism
