"""A cleaning pipeline over ``documents``: toxic texts go, copies and near copies go, sources are mixed, the mix is packed.

Every stage takes (spark, docs, sf_dir); ``run`` writes its rows as Parquet and gives the reread table to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm import exact_dedup, mixing, ngram_join, packing, toxicity
from stratalog.llm.common import Scratch, parquet

#: The first stage learns, which SQL can't express; tests hold the stages, and run() on edge cases, against brute force.
ORACLE_SQL = None


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows scored under 0.3 stay, unchanged; null and empty texts are scored like others.  Without labels of both kinds all stay, or, if all are toxic, none."""
    return toxicity.keep_clean(docs, toxicity.train(docs, parquet(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, white space aside, the smallest doc_id stays; null texts count as empty; of rows repeated with id and text one stays."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays, as keep_one says; texts without words and other texts of a dropped id stay."""
    return ngram_join.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, none, once or twice; texts without words once; a null source is a source."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a sequence; repeated rows are packed as often as they occur, an empty text as its end id."""
    return packing.pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", clean), ("exact_dedup", exact), ("ngram_join", near), ("mixing", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; empty tables give no rows, and columns beyond those of documents travel along."""
    scratch = Scratch(spark, "pipeline")
    docs = parquet(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
