"""The inverted file against the exact search: recall, pruning, odd rows; and ids that repeat."""

from __future__ import annotations

import numpy as np
import pytest

from lexloom.operators import ann, retrieve

SF = "/root/testdata/sf0.01"


def test_recall_and_pruning_on_the_tables(spark, tmp_path):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").selectExpr("vec_id AS id", "embedding", "label")
    queries = vectors.where("id % 50 = 0").selectExpr("id AS query_id", "embedding")
    ann.build(vectors, f"{tmp_path}/i")
    found = ann.search(spark, f"{tmp_path}/i", queries, 10)
    near, exact = ({(r.query_id, r.id): r.score for r in f.collect()} for f in (found, retrieve.vector_topk(vectors, queries, 10)))
    hit = near.keys() & exact.keys()
    assert len(hit) >= 0.9 * len(exact), f"recall {len(hit) / len(exact):.3f}"
    assert all(near[x] == exact[x] for x in hit)
    one = ann.search(spark, f"{tmp_path}/i", queries.limit(1), 10, probes=1)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(list" in plan or "PartitionFilters: [list" in plan or "(list#" in plan.split("PartitionFilters")[1][:60]
    assert ann.stored(spark, f"{tmp_path}/i").count() == vectors.count()


def test_index_of_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).tolist(), f"p{i}") for i in range(60)] + [(100, [0.0] * 4, "zero"), (101, None, "none"), (None, [1.0] * 4, "no id"), (102, [1.0, 2.0], "short"), (103, [2.0, 4.0], "short"), (7, [9.0, 9.0, 9.0, 9.0], "again")]
    chunks = spark.createDataFrame(rows, "id long, embedding array<double>, name string")
    queries = spark.createDataFrame([(1, rows[3][1]), (2, [1.0, 2.1]), (3, None), (None, [1.0] * 4)], "query_id long, embedding array<double>")
    ann.build(chunks, f"{tmp_path}/i", lists=6)
    exact = retrieve.vector_topk(chunks, queries, 3).orderBy("query_id", "rank").collect()
    assert [tuple(r[c] for c in ("query_id", "rank", "id", "name", "score")) for r in ann.search(spark, f"{tmp_path}/i", queries, 3, probes=6).orderBy("query_id", "rank").collect()] == [tuple(r[c] for c in ("query_id", "rank", "id", "name", "score")) for r in exact]
    assert {r.id for r in exact if r.query_id == 2} == {102, 103}
    ann.build(chunks.limit(0), f"{tmp_path}/empty")
    assert ann.search(spark, f"{tmp_path}/empty", queries, 3).collect() == []


@pytest.mark.parametrize("exclude_self", [False, True])
def test_ids_that_repeat_fill_one_place(spark, exclude_self):
    chunks = spark.createDataFrame([(1, [1.0, 0.0], "b"), (1, [1.0, 0.0], "a"), (2, [0.9, 0.1], "c"), (1, [1.0, 0.0], "a")], "id long, embedding array<double>, name string")
    queries = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, embedding array<double>")
    rows = retrieve.vector_topk(chunks, queries, 2, exclude_self=exclude_self).orderBy("rank").collect()
    assert [(r.rank, r.id, r.name) for r in rows] == [(1, 1, "a"), (2, 2, "c")]
