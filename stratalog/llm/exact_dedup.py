"""Exact dedup by a persistent digest index that is bucketed and sorted by hash."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, Scratch, free_name, shared_dir, text_of, without

BATCHES = 3  # in which a whole table is ingested
LEAST_BUCKETS = 8
BUCKET_ROWS = 1_000_000  # digests for which a new index gets one bucket more, about 50 MB


class DigestIndex:
    """Digests of all texts seen so far: digest, keep_id, copies, fresh, batch.

    The index is an external table in one folder a batch, bucketed and sorted by digest.  A batch is deduplicated by a
    sort-merge anti-join against the buckets of all other batches, which are read in place: only the batch is shuffled,
    into as many partitions as there are buckets.  Its digests that the index lacks are appended as fresh rows, one for
    each text; those that the index holds are appended as sightings, which add copies and may lower keep_id.

    A batch has an id and replaces its own folder, so a job that died and runs again counts nothing twice and loses
    nothing.  The files alone are the index: a session whose catalog lacks the table registers it again.  Only one batch
    may be ingested at a time.  ``buckets`` counts for a new index; without it the first batch's size decides.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.name = name or f"digest_index_{uuid.uuid4().hex[:12]}"
        self.path = path or f"{shared_dir(spark)}/{self.name}"
        self.buckets = buckets

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def exists(self) -> bool:
        """Whether there are files of an index; if so, its table is in the catalog after this."""
        found = self._fs().globStatus(self._path("_buckets=*"))
        if not found:
            return False
        self.buckets = int(found[0].getPath().getName().partition("=")[2])
        if not self.spark.catalog.tableExists(self.name):
            self.spark.sql(
                f"CREATE TABLE `{self.name}` (digest BINARY, keep_id BIGINT, copies BIGINT, fresh BOOLEAN, batch STRING) USING parquet"
                f" PARTITIONED BY (batch) CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
            )
            self.spark.catalog.recoverPartitions(self.name)
        return True

    def create(self, rows: int) -> None:
        if not self.exists():
            self.buckets = self.buckets or max(LEAST_BUCKETS, -(-rows // BUCKET_ROWS))
            self._fs().create(self._path(f"_buckets={self.buckets}"), True).close()
            self.exists()

    def entries(self) -> DataFrame:
        """digest, keep_id, group_size over all batches; no shuffle, since the index is bucketed by digest."""
        return self.spark.table(self.name).groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("copies").alias("group_size"))

    def ingest(self, docs: DataFrame, batch: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Deduplicates one batch against the index and itself, and appends it.

        Returns one row per distinct (id, text digest) of the batch: doc_id, keep_id, group_size, kept, text_sha256,
        copies (rows of this id and text), known (whether another batch holds the text).  Null texts count as empty.  Of
        equal texts of all batches so far the smallest id stays, and group_size counts them all.  Rows repeated with the
        same id and text return once, and count each in group_size; a null id stays only where all copies have null ids.
        An empty batch returns no rows.  Without a ``batch`` id the batch gets a new one.
        """
        scratch = Scratch(self.spark, "exact-dedup")
        digests = scratch.write(digests_of(docs, id_col, text_col), "digests")
        known = self.append(digests, batch or uuid.uuid4().hex, scratch)
        rows = self.report(digests, scratch)
        known = known.select("digest", F.lit(True).alias("known"))
        return rows.join(known, "digest", "left").drop("digest").withColumn("known", F.coalesce("known", F.lit(False)))

    def append(self, digests: DataFrame, batch: str, scratch: Scratch) -> DataFrame:
        """Adds rows (doc_id, digest, copies) as ``batch``; returns (written) those of its digests that other batches hold."""
        if not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError("a batch id has letters, digits, - and _ only")
        groups = digests.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.sum("copies").alias("copies"))
        groups = scratch.write(groups, f"groups-{batch}")
        self.create(groups.count())
        dealt = groups.repartition(self.buckets, "digest")
        seen = self.spark.table(self.name).where((F.col("batch") != batch) & F.col("fresh")).select("digest")
        known = scratch.write(dealt.join(seen.hint("merge"), "digest", "left_semi"), f"known-{batch}")
        fresh = dealt.join(seen.hint("merge"), "digest", "left_anti")
        rows = fresh.withColumn("fresh", F.lit(True)).unionByName(known.withColumn("fresh", F.lit(False)))
        rows = scratch.write(rows, f"fresh-{batch}")  # the index may not be read while its folder is replaced
        view = f"digest_batch_{uuid.uuid4().hex[:12]}"
        rows.repartition(self.buckets, "digest").createOrReplaceTempView(view)
        self.spark.sql(f"INSERT OVERWRITE TABLE `{self.name}` PARTITION (batch = '{batch}') SELECT digest, keep_id, copies, fresh FROM {view}")
        self.spark.catalog.dropTempView(view)
        return known

    def report(self, digests: DataFrame, scratch: Scratch) -> DataFrame:
        """Rows (doc_id, digest, copies) with keep_id, group_size, kept and text_sha256 as the index has them now."""
        # both sides come from files, so that AQE can split a digest with very many rows
        entries = scratch.write(self.entries(), "entries")
        return digests.join(entries, "digest").select(
            "doc_id",
            "keep_id",
            "group_size",
            F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
            "copies",
            "digest",
        )

    def drop(self) -> None:
        """Deletes the index with its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS `{self.name}`")
        self._fs().delete(self.spark._jvm.org.apache.hadoop.fs.Path(self.path), True)


def normal(text_col: str = "text"):
    return F.regexp_replace(text_of(text_col), SPACE + "+", " ")


def digests_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest, copies: only the id and 32 bytes go on; a hot (id, text) combines before the exchange."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(normal(text_col), 256)).alias("digest"))
    return rows.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("copies"))


def dedup(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """``docs`` dealt by id into ``batches`` of a new index, ingested one after the other; rows as of :meth:`DigestIndex.ingest`, without ``known``.

    The texts are read once, for their digests.  The index is deleted once its entries are staged.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    digests = scratch.write(digests_of(docs), "digests")
    index = DigestIndex(docs.sparkSession)
    for at in range(batches):
        index.append(digests.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == at), f"b{at}", scratch)
    rows = index.report(digests, scratch).drop("digest")
    index.drop()
    return rows


def drop_copies(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """The rows of ``docs`` that stay, all columns; of rows repeated with the same id and text, one stays."""
    scratch = Scratch(docs.sparkSession, "exact-dedup-keep")
    mark = free_name(docs, "digest")
    found = scratch.write(dedup(docs, batches).select("doc_id", F.col("text_sha256").alias(mark), "kept", "copies"), "found")
    gone = scratch.write(found.where("not kept").select("doc_id", mark), "gone")
    rows = without(docs.withColumn(mark, F.sha2(normal(), 256)), gone)
    if not found.where("kept and copies > 1").isEmpty():
        rows = rows.dropDuplicates(["doc_id", mark])
    return rows.select(*docs.columns)
