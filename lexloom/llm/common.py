"""Shared helpers: the folder all machines see, written tables, and Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise, shared_dir, ship_package  # noqa: F401

def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``materialise`` wrote and nothing reads any more."""
    jvm = df.sparkSession._jvm
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/lexloom-" in path:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


#: Bytes of an Arrow batch at most (a longer row is a batch of its own).
BATCH_BYTES = 16 << 20


def arrow_rows(spark: SparkSession, rows: int, most: int = BATCH_BYTES) -> None:
    """Bound the rows and bytes of an Arrow batch, so that a batch of long texts fits a Python worker."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def numbered(rows: DataFrame, name: str, number: str) -> DataFrame:
    """``rows`` written once, with consecutive numbers from 0 in the order of partitions and of rows within them.

    Only one count a partition reaches the driver. As the table is written, a lost executor can't change the numbers.
    """
    spark = rows.sparkSession
    written = materialise(rows.withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33)
    sizes = written.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).orderBy("_part").collect()
    starts, at = [], 0
    for r in sizes:
        starts.append((r["_part"], at))
        at += r["n"]
    starts = spark.createDataFrame(starts, "_part long, _start long")  # a row a partition
    found = written.withColumn("_part", part).join(F.broadcast(starts), "_part")
    # monotonically_increasing_id keeps the row's place within its partition in the low 33 bits.
    return found.withColumn(number, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_start", "_at")


def packed(rows: pa.Table) -> bytes:
    """A table of bounded size as compressed bytes, to travel to the workers."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(rows)
    return sink.getvalue().to_pybytes()


def id_text(doc_id: Column) -> Column:
    """A document id as the bytes whose CRC-32 deals it to a fold (a null id counts as empty)."""
    return F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32(doc_id as text) mod ``folds``."""
    return F.crc32(id_text(doc_id)) % F.lit(folds)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(column: pa.Array) -> Iterator[str]:
    """Strings of an Arrow column one after another, null as empty."""
    for value in column:
        yield value.as_py() or ""
