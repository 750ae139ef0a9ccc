"""Bucketed tables against a plain dictionary, their plans, and the files that a change leaves alone."""

from __future__ import annotations

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lexloom.operators import store
from lexloom.operators.buckets import PART, BucketedTable

SCHEMA = "collection_id string, chunk_id long, text string, text_hash string"


def rows(spark, data):
    return spark.createDataFrame([(c, i, t) for (c, i), t in data], "collection_id string, chunk_id long, text string").withColumn("text_hash", F.sha2("text", 256))


def made(spark, tmp_path, buckets=8):
    schema = spark.createDataFrame([], SCHEMA).schema
    return BucketedTable.create(spark, f"file://{tmp_path}/t", schema, ["collection_id", "chunk_id"], buckets)


def held(table):
    return {(r.collection_id, r.chunk_id): r.text for r in table.read().collect()}


def files(tmp_path):
    return {str(f): f.stat().st_mtime_ns for f in Path(tmp_path).glob("t/data/*/*.parquet")}


def test_upsert_and_delete_equal_a_dictionary(spark, tmp_path):
    table, plain = made(spark, tmp_path), {}
    first = {(f"c{i % 3}", i): f"text {i}" for i in range(200)}
    second = {**{(f"c{i % 3}", i): f"text {i}" + "!" * (i % 5 == 0) for i in range(50, 150)}, **{("new", i): "x" for i in range(20)}}
    for data in (first, second):
        changed = sum(plain.get(k) != t for k, t in data.items())
        assert table.upsert(rows(spark, data.items())) == changed
        plain.update(data)
        assert held(table) == plain
        assert table.upsert(rows(spark, data.items())) == 0
    gone = [k for k in plain if k[1] % 4 == 0] + [("none", 1)]
    assert table.delete(spark.createDataFrame([*gone, (None, 1)], "collection_id string, chunk_id long")) == len(gone) - 1
    plain = {k: t for k, t in plain.items() if k[1] % 4}
    assert held(BucketedTable(spark, table.path)) == plain


def test_one_changed_row_rewrites_one_bucket(spark, tmp_path):
    table = made(spark, tmp_path)
    table.upsert(rows(spark, [(("c", i), f"t{i}") for i in range(300)]))
    before = files(tmp_path)
    assert len(before) == 8  # one file a bucket
    assert table.upsert(rows(spark, [(("c", 7), "other"), (("c", 8), "t8")])) == 1
    after = files(tmp_path)
    assert len(after) == 8 and len(before.keys() & after.keys()) == 7
    assert all(before[f] == after[f] for f in before.keys() & after.keys())
    assert table.delete(spark.createDataFrame([("c", 9)], "collection_id string, chunk_id long")) == 1
    assert len(files(tmp_path).keys() & after.keys()) == 7


def test_stored_rows_are_not_shuffled(spark, tmp_path):
    table = made(spark, tmp_path)
    table.upsert(rows(spark, [(("c", i), f"t{i}") for i in range(300)]))
    new = rows(spark, [(("c", 1), "a")])
    for plan in (table.changes(new), table.merged(new, [0, 1])):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"Exchange ", text)) == 1 and "hashpartitioning" in text  # the new rows'
        assert "Bucketed: true" in text


def test_repeated_null_and_missing(spark, tmp_path):
    table = made(spark, tmp_path, 2)
    assert table.upsert(rows(spark, [])) == 0 and held(table) == {}
    assert table.upsert(rows(spark, [(("c", 1), "a"), (("c", 1), "a"), (("c", 1), "b")])) == 1
    last = max("ab", key=lambda t: __import__("hashlib").sha256(t.encode()).hexdigest())
    assert held(table) == {("c", 1): last}
    # A stored row without a hash is written again; a new one without a hash replaces nothing that has one.
    assert table.upsert(rows(spark, [(("c", 2), None)])) == 1
    assert table.upsert(rows(spark, [(("c", 2), "x")])) == 1 and held(table)[("c", 2)] == "x"
    with pytest.raises(Exception, match="chunk_id is null"):
        table.upsert(rows(spark, [(("c", None), "a")]))
    assert table.delete(spark.createDataFrame([("c", 1), ("c", 2)], "collection_id string, chunk_id long")) == 2
    assert held(table) == {} and files(tmp_path) == {}
    with pytest.raises(store.CollectionExists):
        made(spark, tmp_path)
    with pytest.raises(store.CollectionMissing):
        BucketedTable(spark, f"file://{tmp_path}/other")
    with pytest.raises(ValueError, match=PART):
        BucketedTable.create(spark, f"file://{tmp_path}/u", spark.createDataFrame([], f"{SCHEMA}, {PART} int").schema, ["chunk_id"])
