"""Cuts that a review found: each test fails on the code that had the cut."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lexloom.operators import retrieve


def test_top_k_answers_any_number_of_queries(spark):
    matrix = np.random.default_rng(1).normal(size=(9000, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(matrix)] + [(9001, None), (9002, [1.0]), (9003, [2.0])]
    chunks = spark.createDataFrame(rows, "id long, embedding array<double>")
    queries = chunks.where("id % 2 = 0").select(F.col("id").alias("query_id"), "embedding")
    got: dict[int, list] = {}
    for r in retrieve.vector_topk(chunks, queries, 3, exclude_self=True).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.score))
    assert got.pop(9002) == [(9003, 1.0)]
    assert sorted(got) == list(range(0, 9000, 2))
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    for q, hits in got.items():
        scores = unit @ unit[q]
        scores[q] = -2
        assert np.allclose([s for _, s in hits], np.sort(scores)[::-1][:3], atol=2e-6)
        assert np.allclose([s for _, s in hits], scores[[i for i, _ in hits]], atol=2e-6)
