"""Collections of chunks as partitioned Parquet, and the set operations behind them.

Every operation on rows is a DataFrame -> DataFrame function; ``CollectionStore`` applies them to a folder
of any Hadoop file system. A logical collection is one partition (collection_id), so appends touch one
folder and reads of one collection never list the others.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class StoreError(Exception):
    """What a store refuses; ``status`` is the service's status code."""

    status = 500


class CollectionExists(StoreError):
    status = 409


class CollectionMissing(StoreError):
    status = 404


class IndexRequired(StoreError):
    status = 400


def store_error(status: int | None, message: str) -> StoreError:
    """The exception for a store's status code and message."""
    if status == 409 or "already exists" in message.lower():
        return CollectionExists(message)
    if status == 404 or "not found" in message.lower():
        return CollectionMissing(message)
    return IndexRequired(message) if "index required" in message.lower() else StoreError(message)


def equality_filter(**wanted) -> Column | None:
    """conjunction of column = value, or IN for lists; None values are left out."""
    out = None
    for name, value in wanted.items():
        if value is not None:
            test = F.col(name).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(name) == value
            out = test if out is None else out & test
    return out


def delete_where(rows: DataFrame, condition: Column | None) -> DataFrame:
    """The rows that stay. Without any criterion nothing may be deleted."""
    if condition is None:
        raise ValueError("refusing to delete without criteria")
    return rows.where(~F.coalesce(condition, F.lit(False)))


def hash_upsert(old: DataFrame, new: DataFrame, key: str | list[str] = "chunk_id") -> tuple[DataFrame, DataFrame]:
    """(merged rows, rows written): only new rows whose text hash is missing or differs are written.

    Both frames have the same columns, text_hash among them; null or equal hashes of ``new`` are computed
    by the caller. Rows of one key in ``new`` are reduced to one, the last by text_hash.
    """
    keys = [key] if isinstance(key, str) else key
    latest = Window.partitionBy(*keys).orderBy(F.desc("text_hash"))
    new = new.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n")
    known = old.select(*keys, F.col("text_hash").alias("_old"), F.lit(True).alias("_known"))
    joined = new.join(known, keys, "left")
    written = joined.where(F.col("_known").isNull() | F.col("_old").isNull() | (F.col("_old") != F.col("text_hash"))).select(new.columns)
    kept = old.join(written.select(*keys), keys, "left_anti")
    return kept.unionByName(written), written


def merge_properties(old: Column, new: Column) -> Column:
    """Map merge, new values win; a null map changes nothing."""
    o, n = F.coalesce(old, F.create_map().cast("map<string,string>")), F.coalesce(new, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(o, lambda k, _: ~F.coalesce(F.map_contains_key(n, k), F.lit(False))), n)


def upsert_times(old: DataFrame, new: DataFrame, key: str, now: Column) -> DataFrame:
    """Full merge by key: created_at of the old row stays, updated_at is ``now`` for written rows.

    Columns other than the key and the two times come from the new row, else from the old one.
    """
    values = [c for c in new.columns if c != key]
    o, n = old.alias("o"), new.withColumn("_new", F.lit(True)).alias("n")
    merged = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    written = F.coalesce(F.col("n._new"), F.lit(False))
    return merged.select(
        F.coalesce(f"n.{key}", f"o.{key}").alias(key),
        *[F.when(written, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in values],
        F.coalesce(F.col("o.created_at"), now).alias("created_at"),
        F.when(written, now).otherwise(F.col("o.updated_at")).alias("updated_at"),
    )


def set_flag(rows: DataFrame, flag: str, condition: Column) -> DataFrame:
    """The flag is true where the condition holds, unchanged elsewhere."""
    before = F.col(flag) if flag in rows.columns else F.lit(False)
    return rows.withColumn(flag, F.when(F.coalesce(condition, F.lit(False)), True).otherwise(before))


def scroll(rows: DataFrame, key: str, limit: int, after=None, where: Column | None = None, columns: list[str] | None = None) -> DataFrame:
    """One keyset page: the next ``limit`` rows behind ``after``; no offset is ever counted off."""
    page = rows if where is None else rows.where(where)
    page = page if after is None else page.where(F.col(key) > F.lit(after))
    page = page.orderBy(key).limit(limit)
    return page if columns is None else page.select(*columns)


def scroll_state(rows: DataFrame, page: DataFrame, key: str, limit: int) -> DataFrame:
    """(total, returned, next_offset, has_more) for a page."""
    total = rows.agg(F.count("*").alias("total"), F.max(key).alias("_end"))
    seen = page.agg(F.count("*").alias("returned"), F.max(key).alias("_last"))
    more = F.coalesce(F.col("_last") < F.col("_end"), F.lit(False))
    return total.join(seen).select("total", "returned", F.when(more, F.col("_last")).alias("next_offset"), more.alias("has_more"))  # one row each


def page_of(rows: DataFrame, order: list[Column], page: int, size: int = 25) -> DataFrame:
    """Page ``page`` (from 1) of the ordered rows."""
    return rows.orderBy(*order).offset((page - 1) * size).limit(size)


def collection_files(chunks: DataFrame) -> DataFrame:
    """A1: files of collections: chunk count and first indexing time; rows without a file aren't files."""
    return chunks.where("file_id IS NOT NULL").groupBy("collection_id", "file_id").agg(F.count("*").alias("chunk_count"), F.min("indexed_at").alias("indexed_at"))


def collection_status(chunks: DataFrame) -> DataFrame:
    """A1: totals of collections; chunks without a file count as chunks."""
    return chunks.groupBy("collection_id").agg(F.count_distinct("file_id").alias("total_files"), F.count("*").alias("total_chunks"))


def file_status(requested: DataFrame, chunks: DataFrame, found: str = "INDEXED", missing: str = "NOT_FOUND") -> DataFrame:
    """A2/A3: status and chunk count of each requested (collection_id, file_id)."""
    counts = chunks.groupBy("collection_id", "file_id").agg(F.count("*").alias("n"))
    joined = requested.join(counts, ["collection_id", "file_id"], "left")
    return joined.select("collection_id", "file_id", F.when(F.col("n") > 0, found).otherwise(missing).alias("status"), F.coalesce("n", F.lit(0)).alias("chunk_count"))


def unit_status(chunks: Column, failed: Column) -> Column:
    """A3: READY with chunks, ERROR without chunks after a failure, else PROCESSING."""
    return F.when(chunks > 0, "READY").when(F.coalesce(failed, F.lit(False)), "ERROR").otherwise("PROCESSING")


#: Characters of a piece that containment is looked up by; strings that hold a piece, from which it is dealt to lanes.
GRAM, HOT = 8, 10_000


def contained(short: DataFrame, long: DataFrame) -> DataFrame:
    """(short, long) pairs of distinct strings where ``short`` (s) is a part of ``long`` (t), by equi-join on one piece of s.

    The piece is that of GRAM characters which the fewest strings of ``long`` hold (a shorter s is its own piece); every t
    that holds s holds it too. A piece that no t holds ends the search for its s. Where even the rarest piece is held by
    more than HOT strings, these are dealt to lanes and s is sent to each. Pieces of ``long`` are its substrings of GRAM
    characters, and of those lengths below that some s has.
    """
    spark = short.sparkSession
    filled = short.where("s <> ''").select("s", F.least(F.length("s"), F.lit(GRAM)).alias("size"))
    sizes = sorted(r["size"] for r in filled.select("size").distinct().collect())  # GRAM rows at most

    def pieces(column: str, size) -> Column:
        starts = F.sequence(F.lit(1), F.length(column) - F.lit(size) + 1)
        return F.when(F.length(column) >= F.lit(size), F.transform(starts, lambda i: F.substring(F.col(column), i, F.lit(size))))

    if not sizes:
        held = long.select("t", F.lit("").alias("piece")).limit(0)
    else:
        held = long.select("t", F.explode(F.array_distinct(F.flatten(F.filter(F.array(*[pieces("t", n) for n in sizes]), lambda x: x.isNotNull())))).alias("piece"))
    frequency = held.groupBy("piece").agg(F.count("*").alias("n"))
    own = filled.select("s", F.explode(F.when(F.col("size") < GRAM, F.array("s")).otherwise(F.array_distinct(pieces("s", GRAM)))).alias("piece"))
    rarest = own.join(frequency, "piece", "left").groupBy("s").agg(F.min_by("piece", F.struct("n", "piece")).alias("piece"), F.min("n").alias("n"), F.count("*").alias("all"), F.count("n").alias("known"))
    rarest = rarest.where("all = known").select("s", "piece", "n")
    cold = rarest.where(F.col("n") <= HOT).select("s", "piece").join(held, "piece")
    lanes = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot = rarest.where(F.col("n") > HOT).select("s", "piece", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"))
    hot = hot.join(held.withColumn("lane", F.pmod(F.xxhash64("t"), F.lit(lanes)).cast("int")), ["piece", "lane"])
    found = cold.select("s", "t").unionByName(hot.select("s", "t")).where(F.contains("t", F.col("s")))
    # An empty string is a part of every string; there is at most one among distinct strings.
    return found.unionByName(long.select("t").join(short.where("s = ''").limit(1), how="inner").select("s", "t"))


def new_and_indexed(candidates: DataFrame, indexed: DataFrame, name: str = "name") -> DataFrame:
    """Candidates with a flag whether an indexed name contains theirs or the other way; new ones first, then by name.

    Names are compared in lower case; a null name is new.
    """
    low = candidates.where(F.col(name).isNotNull()).select(F.lower(name).alias("s")).distinct()
    other = indexed.where(F.col(name).isNotNull()).select(F.lower(name).alias("t")).distinct()
    inside = contained(low, other).select(F.col("s").alias("_low"))
    around = contained(other.withColumnRenamed("t", "s"), low.withColumnRenamed("s", "t")).select(F.col("t").alias("_low"))
    hit = inside.unionByName(around).distinct().withColumn("is_indexed", F.lit(True))
    out = candidates.withColumn("_low", F.lower(name)).join(hit, "_low", "left").drop("_low")
    return out.withColumn("is_indexed", F.coalesce("is_indexed", F.lit(False))).orderBy("is_indexed", name)


#: Bytes of a row group: small, as lookups skip whole groups.
ROW_GROUP = 16 << 20
#: Keys that may travel to all workers; more are joined by a shuffle.
SENT_KEYS = 200_000


def _sized(keys: DataFrame, n: int) -> DataFrame:
    """``n`` rows of keys as the side of a join. Spark would judge by the files' size, of which millions of rows that compress well have little."""
    return F.broadcast(keys) if n <= SENT_KEYS else keys.hint("merge")


class CollectionStore:
    """Named physical collections under one folder; each is a Parquet table partitioned by collection_id."""

    def __init__(self, spark: SparkSession, root: str, dim: int | None = None):
        self.spark, self.root, self.dim = spark, root.rstrip("/"), dim

    def _fs(self):
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(conf), jvm.org.apache.hadoop.fs.Path

    def _path(self, name: str) -> str:
        if not name or "/" in name or name.startswith((".", "_")):
            raise ValueError(f"not a collection name: {name!r}")
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        fs, path = self._fs()
        return bool(fs.exists(path(self._path(name))))

    def list(self) -> list[str]:
        fs, path = self._fs()
        if not fs.exists(path(self.root)):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(path(self.root)) if not s.getPath().getName().startswith("_"))

    def create(self, name: str, schema: StructType) -> bool:
        """An empty collection; False if it exists."""
        if self.exists(name):
            return False
        self._write(self.spark.createDataFrame([], schema), name, "overwrite")
        return True

    def ensure_indexes(self, name: str) -> list[str]:
        """The columns that the layout serves: partitions, then what files are sorted by and filter by (see _files). Nothing is built, so calling it again is harmless."""
        if not self.exists(name):
            raise CollectionMissing(f"collection {name!r} not found")
        return ["collection_id", *[c for c in ("file_id", "chunk_id", "content_type") if c in self.read(name).columns]]

    def drop(self, name: str) -> bool:
        """W4; False if it is missing."""
        fs, path = self._fs()
        return bool(self.exists(name) and fs.delete(path(self._path(name)), True))

    def flush(self) -> int:
        """Drop every collection; returns how many."""
        return sum(self.drop(n) for n in self.list())

    def read(self, name: str) -> DataFrame:
        path = self._path(name)
        schema = self.spark.read.json(f"{path}/_schema").first()[0]
        return self.spark.read.schema(StructType.fromJson(__import__("json").loads(schema))).parquet(f"{path}/data")

    def append(self, name: str, rows: DataFrame) -> None:
        """Rows with (dim set) vectors of the collection's dimension; a wrong one fails the job."""
        self._write(self._checked(rows), name, "append")

    def upsert(self, name: str, rows: DataFrame, key: str = "chunk_id", files: DataFrame | None = None) -> int:
        """Returns how many rows were written; ingesting the same rows again writes none.

        Rows are known by (collection_id, key). ``files`` (collection_id, file_id) are being replaced: their stored rows
        that ``rows`` doesn't hold go. Only the partitions of collections that change are written,
        and rows are appended to them if none that is stored changes; where all are new, the files they were staged in are the ones that stay.
        """
        keys = ["collection_id", key]
        stage, old = f"{self.root}/_stage-{uuid.uuid4().hex}", self.read(name)
        self._files(self._checked(rows), "errorifexists").parquet(f"{stage}/rows")  # laid out as the collection is: see _adopt
        staged = self.spark.read.schema(rows.schema).parquet(f"{stage}/rows")
        # What changes is told by keys and hashes alone; whole rows are moved only where they must be.
        latest = staged.groupBy(*keys).agg(F.count("*").alias("n"), F.max("text_hash").alias("text_hash"))
        known = old.select(*keys, F.col("text_hash").alias("_old"), F.lit(True).alias("_known")).hint("merge")  # see _sized
        differs = F.col("_known").isNull() | F.col("_old").isNull() | (F.col("_old") != F.col("text_hash"))
        is_known, is_written = F.col("_known").isNotNull(), F.coalesce(differs, F.lit(False))
        seen = latest.join(known, keys, "left").agg(
            F.sum("n").alias("rows"), F.count("*").alias("keys"), F.count_if(is_written).alias("written"), F.count_if(is_written & is_known).alias("replaced")
        ).first()
        gone = old.select(*keys).limit(0)
        if files is not None:
            held = old.join(files.select("collection_id", "file_id").distinct(), ["collection_id", "file_id"], "left_semi")
            gone = held.join(_sized(staged.select(*keys), seen["rows"] or 0), keys, "left_anti").select(*keys)
        gone.write.parquet(f"{stage}/gone")
        gone = self.spark.read.schema(gone.schema).parquet(f"{stage}/gone")
        n, n_gone = seen["written"], gone.count()
        written, whole = staged, bool(n) and seen["rows"] == seen["keys"] == n
        if n and not whole:  # some rows repeat a key or are stored as they are
            hash_upsert(old.hint("merge"), staged, keys)[1].write.parquet(f"{stage}/written")
            written = self.spark.read.schema(rows.schema).parquet(f"{stage}/written")
        elif not n:
            written = staged.limit(0)
        if seen["replaced"] or n_gone:
            changed = written.select(*keys).unionByName(gone)
            self._rewrite(name, changed.select("collection_id").distinct(), lambda touched: touched.join(_sized(changed, n + n_gone), keys, "left_anti").unionByName(written))
        elif whole:
            self._adopt(name, f"{stage}/rows")
        elif n:
            self._write(written, name, "append")
        fs, path = self._fs()
        fs.delete(path(stage), True)
        return n

    def delete(self, name: str, **criteria) -> None:
        """Delete rows by equality criteria; rewrites what stays of the collections that hold some."""
        where = equality_filter(**criteria)
        rows = self.read(name)
        delete_where(rows, where)  # refuses an empty criterion
        self._rewrite(name, rows.where(where).select("collection_id").distinct(), lambda touched: delete_where(touched, where))

    def delete_files(self, name: str, files: DataFrame) -> None:
        """Delete the rows of files (collection_id, file_id); however many, they are joined, not listed."""
        files = files.select("collection_id", "file_id").distinct()
        held = self.read(name).join(files, ["collection_id", "file_id"], "left_semi")
        self._rewrite(name, held.select("collection_id").distinct(), lambda touched: touched.join(files, ["collection_id", "file_id"], "left_anti"))

    def _checked(self, rows: DataFrame) -> DataFrame:
        if self.dim is None:
            return rows
        checked = F.when(F.size("embedding") == self.dim, F.col("embedding")).otherwise(F.raise_error(F.lit(f"vectors need {self.dim} dimensions")).cast(rows.schema["embedding"].dataType))
        return rows.withColumn("embedding", checked)

    def _write(self, rows: DataFrame, name: str, mode: str) -> None:
        path = self._path(name)
        if mode == "overwrite":
            self.spark.createDataFrame([(rows.schema.json(),)], "schema string").coalesce(1).write.mode("overwrite").json(f"{path}/_schema")
        self._files(rows, mode).parquet(f"{path}/data")

    def _adopt(self, name: str, staged: str) -> None:
        """Append rows by moving the files that ``_files`` wrote into the collection's folders; their names hold the writing job's id."""
        fs, path = self._fs()
        data = path(f"{self._path(name)}/data")
        for folder in (s.getPath() for s in fs.listStatus(path(staged)) if s.isDirectory()):
            into = path(data, folder.getName())
            moves = [(s.getPath(), path(into, s.getPath().getName())) for s in fs.listStatus(folder)] if fs.exists(into) else [(folder, into)]
            for source, target in moves:
                if not fs.rename(source, target):
                    raise OSError(f"could not move {source} to {name!r}")

    def _files(self, rows: DataFrame, mode: str):
        """A writer of files sorted by collection, file and chunk, with Bloom filters on the two ids.

        A lookup of a file or chunk opens its collection's partition and skips row groups and pages by their bounds, and row groups by their filters.
        """
        ids = [c for c in ("file_id", "chunk_id") if c in rows.columns]
        writer = rows.sortWithinPartitions("collection_id", *ids).write.mode(mode).partitionBy("collection_id")
        for c in ids:
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.candidates.number#{c}", "8")
        # For all columns: named by column this setting does nothing, and every filter has a megabyte.
        writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true")
        # Neighbouring chunks share their overlap, which zstd finds across a page.
        return writer.option("parquet.block.size", ROW_GROUP).option("compression", "zstd")

    def lookup(self, name: str, collection_id: str, **ids) -> DataFrame:
        """The rows of a collection by file_id or chunk_id; reads the row groups that can hold them."""
        if not ids.keys() <= {"file_id", "chunk_id"} or not ids:
            raise IndexRequired(f"index required for one of {sorted(ids)}")
        return self.read(name).where(equality_filter(collection_id=collection_id, **ids))

    def _rewrite(self, name: str, collections: DataFrame, change) -> None:
        """Replace the partitions of ``collections`` (distinct collection_id) by change(their rows); others stay untouched.

        New files are written beside and take the place of a partition's old ones when the job commits. A partition
        without rows afterwards is removed. If the job fails before it commits, the old files are all there; if it fails before the
        last partitions are removed, deleting the same rows again removes them. The ids are those of folders, which Spark lists on the driver anyway.
        """
        ids = [r[0] for r in collections.collect()]
        if not ids:
            return
        wanted = F.col("collection_id").isin([i for i in ids if i is not None])
        wanted = F.coalesce(wanted, F.lit(False)) | F.col("collection_id").isNull() if None in ids else wanted
        data = f"{self._path(name)}/data"
        rows = change(self.read(name).where(wanted))  # the old files stay readable until the job commits
        left = {r[0] for r in rows.select("collection_id").distinct().collect()}
        self._files(rows, "overwrite").option("partitionOverwriteMode", "dynamic").parquet(data)
        fs, path = self._fs()
        folder = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
        for i in ids:
            if i not in left and not fs.delete(path(f"{data}/{folder('collection_id', i)}"), True):
                raise OSError(f"could not remove the empty partition {i!r} of {name!r}")


def append_feedback(rows: DataFrame, path: str) -> None:
    """Append rows to a JSON-lines log."""
    rows.write.mode("append").json(path)


def to_documents_json(acts: DataFrame, path: str) -> None:
    """Nested documents as JSON lines; read back by sources.parsed_acts."""
    acts.write.mode("overwrite").json(path)


def indexed(rows: DataFrame, columns: Mapping[str, Column] | None = None, now: Column | None = None) -> DataFrame:
    """The payload columns that a chunk is stored with: hash, lower-case type, indexing time (Q29/Q30)."""
    now = F.current_timestamp() if now is None else now
    return rows.withColumns({"text_hash": F.sha2("text", 256), "chunk_type": F.lower("chunk_type"), "indexed_at": now, **(columns or {})})
