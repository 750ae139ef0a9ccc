"""Keyed tables in bucketed Parquet, where an upsert shuffles the new rows alone and rewrites only buckets that change.

A bucket is a folder with the rows whose keys hash to it, the folder's number being the bucket's own. Spark reads
buckets as partitions of a join on the keys, so stored rows meet new ones without an exchange, and its dynamic overwrite
replaces the folders that get rows, leaving all others as they are.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import materialise
from .store import CollectionExists, CollectionMissing

#: Column that holds the bucket's number; tables may not have one of this name.
PART = "_bucket"


@contextmanager
def _replacing_folders(spark: SparkSession) -> Iterator[None]:
    name = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(name)
    spark.conf.set(name, "dynamic")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class BucketedTable:
    """A table under a folder, its rows known by ``keys``. Open an existing one by its folder, in any session.

    Rows have a column text_hash. A null in a key fails the job. The number of buckets is fixed when the table is made:
    about one for each GB it is to hold. Each change is one overwrite, whose new folders take the old ones' place when its job commits.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        if not self._exists(spark, self.path):
            raise CollectionMissing(f"no table at {path!r}")
        layout = spark.read.json(f"{self.path}/_layout").first()
        self.schema, self.keys, self.buckets = StructType.fromJson(json.loads(layout["schema"])), list(layout["keys"]), layout["buckets"]
        self.columns = self.schema.names
        self._name = f"lexloom_{hashlib.sha256(self.path.encode()).hexdigest()[:24]}"
        by = ", ".join(f"`{k}`" for k in self.keys)
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema)
        address = self.path.replace("'", "\\'")
        spark.sql(f"DROP TABLE IF EXISTS `{self._name}`")  # the entry alone; files outside the warehouse stay
        spark.sql(
            f"CREATE TABLE `{self._name}` ({columns}, `{PART}` int) USING parquet PARTITIONED BY (`{PART}`) "
            f"CLUSTERED BY ({by}) SORTED BY ({by}) INTO {self.buckets} BUCKETS LOCATION '{address}/data'"
        )
        spark.catalog.recoverPartitions(self._name)  # a folder for each bucket at most

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], buckets: int = 64) -> BucketedTable:
        """An empty table; CollectionExists if the folder holds one."""
        if cls._exists(spark, path):
            raise CollectionExists(f"a table exists at {path!r}")
        if missing := {*keys, "text_hash"} - set(schema.names):
            raise ValueError(f"columns missing: {sorted(missing)}")
        if PART in schema.names:
            raise ValueError(f"{PART!r} is the table's own column")
        data = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/data")
        data.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(data)
        layout = spark.createDataFrame([(schema.json(), list(keys), buckets)], "schema string, keys array<string>, buckets int")
        layout.coalesce(1).write.json(f"{path.rstrip('/')}/_layout")
        return cls(spark, path)

    @staticmethod
    def _exists(spark: SparkSession, path: str) -> bool:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_layout/_SUCCESS")
        return bool(folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder))

    def read(self) -> DataFrame:
        return self._stored().drop(PART)

    def _stored(self) -> DataFrame:
        return self.spark.read.table(self._name)

    def _part(self) -> Column:
        """The bucket that Spark deals a row to: its hash of the keys modulo the number of buckets."""
        return F.pmod(F.hash(*self.keys), F.lit(self.buckets))

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """``rows`` in the partitions of their buckets; the one exchange of an upsert."""
        whole = {k: F.coalesce(k, F.raise_error(F.lit(f"{k} is null")).cast(rows.schema[k].dataType)) for k in self.keys}
        return rows.withColumns(whole).repartition(self.buckets, *self.keys)

    def changes(self, rows: DataFrame) -> DataFrame:
        """The rows of ``rows`` whose key is unknown or whose text_hash differs from the stored one; of one key's rows the last by text_hash."""
        latest = Window.partitionBy(*self.keys).orderBy(F.desc("text_hash"))
        new = self._dealt(rows.select(self.columns)).withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n")
        known = self._stored().select(*self.keys, F.col("text_hash").alias("_old"), F.lit(True).alias("_known"))
        joined = new.join(known.hint("merge"), self.keys, "left")
        return joined.where(F.col("_known").isNull() | F.col("_old").isNull() | (F.col("_old") != F.col("text_hash"))).select(self.columns)

    def merged(self, written: DataFrame, parts: list[int]) -> DataFrame:
        """The rows of the buckets ``parts`` after ``written`` replaced those of its keys."""
        old = self._stored().where(F.col(PART).isin(parts)).drop(PART).alias("o")
        new = self._dealt(written).withColumn("_new", F.lit(True)).hint("merge").alias("n")
        both = old.join(new, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in self.keys], "full_outer")
        return both.select(*[F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in self.columns])

    def upsert(self, rows: DataFrame) -> int:
        """Write what is new or changed; returns how many rows that were. The same rows again write none."""
        written = materialise(self.changes(rows), "upsert")
        counts = written.groupBy(self._part().alias("part")).count().collect()  # a row for each bucket at most
        if counts:
            self._replace(self.merged(written, [r["part"] for r in counts]))
        return sum(r["count"] for r in counts)

    def delete(self, gone: DataFrame) -> int:
        """Delete the rows of these keys; returns how many went. Buckets without one of them stay as they are."""
        gone = materialise(gone.select(*self.keys).dropna().distinct(), "gone")
        mark = self._dealt(gone).withColumn("_gone", F.lit(True))
        held = self._stored().join(mark.hint("merge"), self.keys, "left")
        counts = held.groupBy(PART).agg(F.count("*").alias("all"), F.count("_gone").alias("gone")).where("gone > 0").collect()
        touched = [r[PART] for r in counts if r["gone"] < r["all"]]
        if touched:
            self._replace(self._stored().where(F.col(PART).isin(touched)).drop(PART).join(mark.hint("merge"), self.keys, "left_anti").select(self.columns))
        for r in counts:
            if r["gone"] == r["all"]:
                self._drop_bucket(r[PART])
        return sum(r["gone"] for r in counts)

    def _replace(self, rows: DataFrame) -> None:
        with _replacing_folders(self.spark):
            rows.withColumn(PART, self._part()).write.insertInto(self._name, overwrite=True)

    def _drop_bucket(self, part: int) -> None:
        self.spark.sql(f"ALTER TABLE `{self._name}` DROP PARTITION (`{PART}` = {part})")
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data/{PART}={part}")
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
