"""What the operators of this subpackage share: staged tables, word patterns and small column helpers."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as every contract here defines it.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


#: Narrow rows to a file of a staged table.
ROWS_EACH = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``.  Only a local session (one JVM) may run without it and then gets
    a temporary folder of its own; on a cluster a missing setting is an error, since no local folder is shared.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="stratalog-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Scratch:
    """Tables staged under one fresh folder of the shared directory.

    A staged table cuts the lineage: it survives lost executors, and what follows rereads it in place of recomputing.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """``rows``: a bound of the table's narrow rows, where known; so many files are written as these need."""
        schema = df.schema
        if rows is not None:
            df = df.coalesce(1 + rows // ROWS_EACH)
        df.write.parquet(self.path(name))
        return self.spark.read.schema(schema).parquet(self.path(name))

    def release(self) -> None:
        """Lets Spark delete the shuffle files of plans that are no longer referenced; it waits for the JVM's collector."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *names: str) -> None:
        """Deletes staged tables that nothing reads any more."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of the Arrow batches in which texts go to Python workers; Spark's default is 64 MB, which JVM and worker hold several times.
BATCH_BYTES = 2 << 20


def in_batches(docs: DataFrame) -> DataFrame:
    """``docs``, for mapInArrow over whole texts: from now on the session's Arrow batches end at BATCH_BYTES, if not before.

    A batch takes at least one row, however long, so no text is cut.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    conf = docs.sparkSession.conf
    now = conf.get(key)
    if not now.rstrip("b").isdigit() or not 0 < int(now.rstrip("b")) <= BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return docs


def trimmed(task, *caches):
    """A task for mapInArrow that empties ``caches`` and gives freed memory back when it ends; Python workers live on."""

    def run(batches):
        import ctypes

        import pyarrow as pa

        yield from task(batches)
        for cache in caches:
            cache.cache_clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return run


def text_of(column: Column | str) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores ahead as it takes to differ from all columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def word_count(column: Column | str) -> Column:
    """Number of maximal runs of other than ASCII white space; JVM-side."""
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


#: Rows of two small columns up to which a side is broadcast; beyond it both sides are shuffled.
MOST_BROADCAST = 1 << 20


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` that agree with no row of ``gone`` in its columns, nulls alike; ``gone`` is a written table.

    Texts move only if ``gone`` has too many rows for a broadcast.
    """
    names = {c: free_name(docs, f"gone_{c}") for c in gone.columns}
    gone = gone.withColumnsRenamed(names)
    if gone.count() <= MOST_BROADCAST:
        gone = F.broadcast(gone)
    on = [docs[c].eqNullSafe(F.col(other)) for c, other in names.items()]
    return docs.join(gone, on, "left_anti")


def parquet(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
