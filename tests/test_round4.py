"""What the fourth review found: each test fails on the code before."""

from __future__ import annotations

from pathlib import Path

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from lexloom.llm import collocations
from lexloom.operators import store


def _rows(spark, n, collection="c"):
    """``n`` rows of one text, so that millions of them are a small file."""
    return spark.range(n).select(
        F.lit(collection).alias("collection_id"), F.col("id").cast("string").alias("file_id"), F.concat(F.col("id").cast("string"), F.lit("_chunk_1")).alias("chunk_id"),
        F.lit("One sentence.").alias("text"), F.sha2(F.lit("One sentence."), 256).alias("text_hash"),
    )


def _store(spark, tmp_path, rows):
    s = store.CollectionStore(spark, f"file://{tmp_path}/store")
    s.create("x", rows.schema)
    return s


def test_keys_are_sent_to_all_workers_by_their_number(spark, tmp_path, monkeypatch):
    """sizes of files decided, so millions of keys that compress well went through the driver to all workers."""
    plans, write = [], DataFrameWriter.parquet

    def watched(self, path, *a, **k):
        plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return write(self, path, *a, **k)

    monkeypatch.setattr(DataFrameWriter, "parquet", watched)
    monkeypatch.setattr(store, "SENT_KEYS", 1000, raising=False)
    rows = _rows(spark, 5000)
    s, files = _store(spark, tmp_path, rows), rows.select("collection_id", "file_id")
    s.upsert("x", rows, files=files)
    changed = rows.withColumn("text_hash", F.when(F.col("file_id") < "3", F.sha2("file_id", 256)).otherwise(F.col("text_hash")))
    assert s.upsert("x", changed.where("file_id < '7'"), files=files) == rows.where("file_id < '3'").count()
    got = s.read("x").select("file_id", "text_hash").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, changed.where("file_id < '7'").select("file_id", "text_hash").collect()))
    joins = [p for p in plans if "LeftAnti" in p]
    assert joins and not any("BroadcastHashJoin [collection_id" in p and "LeftAnti" in p.split("BroadcastHashJoin", 1)[1].split("\n", 1)[0] for p in joins)


def test_new_rows_are_written_once(spark, tmp_path, monkeypatch):
    """staged files become the collection's where all rows are new."""
    monkeypatch.setattr(store.CollectionStore, "_write", lambda self, rows, name, mode, f=store.CollectionStore._write: f(self, rows, name, mode if mode == "overwrite" else None))
    rows = _rows(spark, 50).unionByName(_rows(spark, 20, "d é/1"))
    s = _store(spark, tmp_path, rows)
    assert s.upsert("x", rows) == 70
    more = rows.withColumn("chunk_id", F.concat("chunk_id", F.lit("b")))
    assert s.upsert("x", more.unionByName(_rows(spark, 5).withColumn("collection_id", F.lit(None).cast("string")))) == 75
    assert s.read("x").count() == 145 and s.lookup("x", "d é/1", chunk_id="7_chunk_1b").count() == 1
    assert s.read("x").where("collection_id IS NULL").count() == 5 and s.upsert("x", rows.unionByName(more)) == 0
    assert [p.name for p in Path(tmp_path, "store").iterdir()] == ["x"]


def test_filters_of_small_files_are_small(spark, tmp_path):
    """each file had two Bloom filters of a megabyte, whatever it held."""
    rows = _rows(spark, 100)
    s = _store(spark, tmp_path, rows)
    s.append("x", rows)
    files = list(Path(tmp_path, "store/x/data").rglob("*.parquet"))
    assert files and all(f.stat().st_size < 100_000 for f in files)
    assert s.lookup("x", "c", file_id="42").count() == 1 and s.lookup("x", "c", file_id="no").count() == 0


def test_rows_of_the_corpus_are_short(spark):
    """Spark reads 4,096 rows at once, which were 128 KB each; a task took half a GB a column."""
    texts = spark.range(64).select(F.lit("en").alias("lang"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(40_000)), lambda i: F.concat_ws(" ", F.lit("a b"), F.when(i % 7 == 0, "rare!"))), " ").alias("text"))
    level = spark.createDataFrame([(0, "en", "a"), (1, "en", "b")], "id long, lang string, phrase string").repartition(1)
    collocations.arrow_rows(spark, 1000, 4 << 20)
    got = collocations.encoded(texts, level, collocations._of_words, ["lang", "phrase"])
    longest, all_bytes = got.agg(F.max(F.length("ids")), F.sum(F.length("ids"))).first()
    assert longest * int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 64 << 20 < all_bytes * 2
    assert all_bytes > 64 * 80_000 * 8


def test_tables_of_earlier_levels_are_let_go_of():
    """a worker kept the words' dictionary while it counted pairs."""
    table = pa.table({"id": [0, 1], "lang": ["en", "en"], "phrase": ["a", "b"]})
    batch = pa.record_batch([["en"], ["a b a"]], names=["lang", "text"])
    collocations._of_words(batch, collocations.packed(table))
    assert collocations._word_table.cache_info().currsize == 1
    assert list(collocations._count_pairs(iter([]))) == [] and collocations._word_table.cache_info().currsize == 0
