"""Snapshots against the rows they were taken of, and lookups that skip row groups."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lexloom.operators import pages, store

SCHEMA = "id long, name string"


def _scan_rows(df) -> int:
    """Rows that the file scan of a collected frame gave out."""
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    leaf = plan.collectLeaves().apply(0)
    return leaf.metrics().apply("numOutputRows").value()


def test_pages_put_together_are_the_table_while_rows_are_added(spark, tmp_path):
    rows = [(i // 3, f"n{i}") for i in range(100)] + [(7, "hot")] * 40 + [(None, "no key")]
    source = f"{tmp_path}/source"
    spark.createDataFrame(rows, SCHEMA).write.parquet(source)
    taken = pages.take(spark.read.parquet(source), "id", f"{tmp_path}/s", range_rows=15)
    seen, offset, sizes = [], 0, []
    while offset is not None:
        page = taken.page(17, offset)
        spark.createDataFrame([(0, "later"), (50, "later")], SCHEMA).write.mode("append").parquet(source)
        got = [tuple(r) for r in page.rows.collect()]
        assert len(got) == page.returned and page.total == 140 and page.has_more == (offset + 17 < 140)
        seen, offset, sizes = seen + got, page.next_offset, [*sizes, page.returned]
    assert sorted(seen) == sorted(r for r in rows if r[0] is not None)
    assert [k for k, _ in seen] == sorted(k for k, _ in seen)
    assert sizes == [17] * 8 + [4]
    assert taken.directory.count() > 5 and taken.directory.agg(F.max("n")).first()[0] <= 60
    again = pages.Snapshot(spark, f"{tmp_path}/s")  # as another session would open it
    assert [tuple(r) for r in again.page(200).rows.collect()] == seen
    for key in (-1, 0, 7, 20, 33, 99):
        assert again.offset_after(key) == sum(k <= key for k, _ in seen)
    assert "PartitionFilters: [isnotnull(_range" in again.page(3, 20).rows._jdf.queryExecution().toString()
    assert again.drop()


def test_empty_snapshots_and_pages_beyond_the_end(spark, tmp_path):
    empty = pages.take(spark.createDataFrame([(None, "x")], SCHEMA), "id", f"{tmp_path}/e")
    page = empty.page(5)
    assert (page.rows.collect(), page.total, page.returned, page.next_offset, page.has_more) == ([], 0, 0, None, False)
    assert empty.offset_after(3) == 0
    one = pages.take(spark.createDataFrame([(1, None)], SCHEMA), "id", f"{tmp_path}/o")
    page = one.page(5, 1, ["name"])
    assert (page.rows.collect(), page.total, page.returned, page.has_more) == ([], 1, 0, False)
    assert [tuple(r) for r in one.page(5, 0, ["name"]).rows.collect()] == [(None,)]
    with pytest.raises(ValueError):
        one.page(0)


def test_lookups_skip_row_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "ROW_GROUP", 64 << 10)
    rows = spark.range(40_000).select(
        F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("collection_id"), F.concat(F.lit("f"), F.col("id") % 500).alias("file_id"), F.concat(F.lit("c"), "id").alias("chunk_id"), F.sha2(F.col("id").cast("string"), 512).alias("text")
    )
    s = store.CollectionStore(spark, str(tmp_path))
    s.create("x", rows.schema)
    s.append("x", rows.coalesce(1))
    found = s.lookup("x", "b", file_id="f77")
    assert sorted(r.chunk_id for r in found.collect()) == sorted(f"c{i}" for i in range(77, 40_000, 500))
    assert 80 <= _scan_rows(found) < 10_000
    chunk = s.lookup("x", "b", chunk_id="c1077")  # not what files are sorted by: bounds rarely help, filters do
    assert [r.file_id for r in chunk.collect()] == ["f77"]
    assert _scan_rows(chunk) < 15_000
    assert s.lookup("x", "a", chunk_id="c1077").collect() == []
    with pytest.raises(store.IndexRequired):
        s.lookup("x", "a", text="t")
