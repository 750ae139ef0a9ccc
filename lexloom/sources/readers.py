"""Readers: every source becomes a frame; bad inputs become rows with an error, never a failed job."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx

ACT = (
    "name string, year int, act_number string, preamble string, document_type string, total_chapters int, total_sections int, "
    "chapters array<struct<number:string,title:string,section_numbers:array<string>>>, "
    "sections array<struct<number:string,title:string,content:string,chapter_number:string,chapter_title:string,has_proviso:boolean,has_explanation:boolean,cross_references:array<string>>>, "
    "schedules array<struct<number:string,content:string>>, metadata map<string,string>, _corrupt_record string"
)
BNS = "total_sections int, total_chapters int, chunks array<struct<chunk_id:string,text:string,section_number:string,section_title:string,chapter_number:string,page_start:int,page_end:int>>"
FEEDBACK = "query string, q_vec array<double>, doc_ids array<string>, label int, collection string, timestamp string"
ARTICLES = "Articles string"


def parsed_acts(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Parsed acts of a folder, with _source_file; files that don't parse have _corrupt_record."""
    reader = spark.read.schema(ACT).option("multiLine", multi_line).option("mode", "PERMISSIVE").option("pathGlobFilter", "*.json")
    return reader.json(path).withColumn("_source_file", F.col("_metadata.file_name"))


def act_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of a code file with totals, one row each."""
    rows = spark.read.schema(BNS).option("multiLine", True).json(path)
    return rows.select("total_sections", "total_chapters", F.inline("chunks"))


def article_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a constitution file."""
    return spark.read.schema(ARTICLES).option("multiLine", True).json(path).select(F.col("Articles").alias("entry")).where("entry IS NOT NULL")


def feedback_log(spark: SparkSession, path: str) -> DataFrame:
    """The feedback log; blank lines are skipped, a line that doesn't parse is a row with its text as ``_corrupt_record``."""
    parsed = F.from_json("value", f"{FEEDBACK}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return spark.read.text(path).where(F.length(tx.strip(F.col("value"))) > 0).select(parsed.alias("r")).select("r.*")


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length, modificationTime, content) of files of any Hadoop file system."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


def text_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files as (path, text)."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def resolve(items: DataFrame) -> DataFrame:
    """Items (item_type, url, storage_url) with source, source_type and error.

    web and youtube items need a url, file and image items a storage_url; percent escapes are decoded
    (a plus stays a plus). Unsupported or empty sources have an error and no type.
    """
    by_url = F.col("item_type").isin("web", "youtube")
    raw = F.when(by_url, F.col("url")).when(F.col("item_type").isin("file", "image"), F.col("storage_url"))
    source = F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))
    source = F.when(by_url, raw).otherwise(F.coalesce(source, raw))
    kind = F.when(F.col("item_type") == "youtube", F.when(tx.video_id(F.col("source")).isNotNull(), "youtube")).otherwise(tx.source_type(tx_path(F.col("source"))))
    error = (
        F.when(~F.col("item_type").isin("web", "youtube", "file", "image") | F.col("item_type").isNull(), "unknown item type")
        .when(F.coalesce(F.length(F.trim("source")), F.lit(0)) == 0, F.when(by_url, "url is required").otherwise("storage_url is required"))
        .when(F.col("source_type").isNull(), "unsupported source")
    )
    return items.withColumn("source", source).withColumn("source_type", kind).withColumn("error", error).withColumn("source_type", F.when(F.col("error").isNull(), F.col("source_type")))


def tx_path(source: Column) -> Column:
    """A local:// source as its path; other sources unchanged."""
    return F.regexp_replace(source, "^local://", "")


class Parsers:
    """Registry of parsers by source type, each DataFrame -> DataFrame."""

    def __init__(self) -> None:
        self._parsers: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def register(self, source_type: str, parser: Callable[[DataFrame], DataFrame]) -> None:
        self._parsers[source_type] = parser

    def available(self) -> list[str]:
        return sorted(self._parsers)

    def parse(self, items: DataFrame, columns: list[str]) -> DataFrame:
        """Every item by its parser; items of unregistered types come back with an error."""
        out = None
        for kind in self.available():
            part = self._parsers[kind](items.where(F.col("source_type") == kind)).select(*columns, F.lit(None).cast("string").alias("error"))
            out = part if out is None else out.unionByName(part)
        rest = items.where(~F.coalesce(F.col("source_type").isin(self.available()), F.lit(False)))
        failed = rest.select(*[F.col(c) if c in items.columns else F.lit(None).alias(c) for c in columns], F.lit("no parser").alias("error"))
        return failed if out is None else out.unionByName(failed)


class Files:
    """Byte files of any Hadoop file system below one root; ``local://`` names are paths below it."""

    BLOCK = 8192

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, name: str):
        plain = name.removeprefix("local://").lstrip("/")
        if ".." in plain.split("/"):
            raise ValueError(f"not below the root: {name!r}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{plain}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def write(self, name: str, content: bytes) -> str:
        """Write a file, its folders included; returns its full address."""
        fs, path = self._at(name)
        out = fs.create(path, True)
        try:
            out.write(bytearray(content))
        finally:
            out.close()
        return str(path)

    def exists(self, name: str) -> bool:
        fs, path = self._at(name)
        return bool(fs.exists(path))

    def size(self, name: str) -> int:
        fs, path = self._at(name)
        return int(fs.getFileStatus(path).getLen())

    def delete(self, name: str) -> bool:
        fs, path = self._at(name)
        return bool(fs.delete(path, False))

    def blocks(self, name: str) -> Iterator[bytes]:
        """The file's bytes in blocks, one held at a time."""
        fs, path = self._at(name)
        stream = fs.open(path)
        try:
            while block := bytes(stream.readNBytes(self.BLOCK)):
                yield block
        finally:
            stream.close()

    def read(self, name: str) -> bytes:
        return b"".join(self.blocks(name))
