"""File sources and sinks: CSV with a header, plain or zstd, dumped matrices and segment lists, graph files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_csv(df: DataFrame, path: str, compression: str = "none") -> None:
    df.write.mode("overwrite").option("header", True).option("compression", compression).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_table(df: DataFrame, path: str, room: str = "room") -> None:
    """Parquet by room, sorted within files, so that room and index filters prune."""
    order = [c for c in ("start_index", "sg") if c in df.columns]
    df.repartition(room).sortWithinPartitions(room, *order).write.mode("overwrite").partitionBy(room).option("compression", "zstd").parquet(path)


def write_matrix(distances: DataFrame, path: str) -> None:
    """``i|d d d`` lines of one room's (i, j, distance), in a folder of text files that :func:`read_matrix` reads."""
    cells = F.array_sort(F.collect_list(F.struct("j", "distance")))
    rows = distances.groupBy("i").agg(F.transform(cells, lambda c: c["distance"].cast("string")).alias("row"))
    rows.select(F.concat(F.col("i").cast("string"), F.lit("|"), F.array_join("row", " ")).alias("value")).write.mode("overwrite").text(path)


def write_zstd_csv(df: DataFrame, folder: str) -> DataFrame:
    """One zstd-compressed CSV file with a header for each partition, by Arrow, since Spark needs a native library for it.

    Returns the names of the files of committed tasks, which :func:`read_zstd_csv` reads.
    """

    def task(batches):
        import uuid

        import pyarrow as pa
        from pyarrow import csv, fs
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(folder if ":" in folder.split("/")[0] else f"file://{folder}")
        store.create_dir(base, recursive=True)
        name, writer = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:8]}.csv.zst", None
        with store.open_output_stream(f"{base}/{name}", compression="zstd") as out:
            for batch in batches:
                writer = writer or csv.CSVWriter(out, batch.schema)
                writer.write_batch(batch)
            if writer:
                writer.close()
        yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"] if writer else pa.array([], pa.string())})

    return df.sparkSession.createDataFrame(df.mapInArrow(task, "file string").collect(), "file string")


def read_zstd_csv(files: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows of the listed files (file), which are streamed; empty cells are nulls."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def task(batches):
        from pyarrow import csv, fs

        options = csv.ConvertOptions(column_types=arrow, strings_can_be_null=True, quoted_strings_can_be_null=False)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                store, path = fs.FileSystem.from_uri(name if ":" in name.split("/")[0] else f"file://{name}")
                with store.open_input_stream(path, compression="zstd") as raw:
                    yield from csv.open_csv(raw, convert_options=options)

    return files.repartition(max(1, files.sparkSession.sparkContext.defaultParallelism)).mapInArrow(task, schema)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(i, row) of a dump with one ``i|d d d`` line for each row; whatever stands before the last bar is the label."""
    lines = spark.read.text(path).where(F.col("value").contains("|"))
    label = F.regexp_extract("value", r"(\d+)\s*\|[^|]*$", 1).cast("int")
    cells = F.split(F.trim(F.regexp_replace("value", r"^.*\|", "")), r"\s+").cast("array<int>")
    return lines.select(label.alias("i"), cells.alias("row"))


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """(segment, start_sg, end_sg) of the lines that hold ``segment #i a -> b``."""
    pattern = r"segment #(\d+) (\d+) -> (\d+)"
    part = lambda i, kind: F.regexp_extract("value", pattern, i).cast(kind)
    lines = spark.read.text(path).where(F.col("value").rlike(pattern))
    return lines.select(part(1, "int").alias("segment"), part(2, "long").alias("start_sg"), part(3, "long").alias("end_sg"))


def dot_lines(edges: DataFrame, dotted_back: bool = True) -> DataFrame:
    """Graphviz lines for (u, v, weight); edges to smaller ids are dotted or left out."""
    back = F.col("v") < F.col("u")
    style = F.when(back, ' style="dotted"').otherwise("")
    rows = edges if dotted_back else edges.where(~back)
    return rows.select(F.format_string('  %d -> %d [label="%s"%s];', "u", "v", F.col("weight").cast("string"), style).alias("value"))


def write_dot(edges: DataFrame, path: str, dotted_back: bool = True) -> None:
    """A folder with one graph file; for graphs of segments, which are small."""
    spark = edges.sparkSession
    head, tail = (spark.createDataFrame([(t,)], "value string") for t in ("digraph {", "}"))
    head.unionByName(dot_lines(edges, dotted_back)).unionByName(tail).coalesce(1).write.mode("overwrite").text(path)
