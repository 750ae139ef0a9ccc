"""Similar feedback: blocks that bounds skip lose no pair."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.operators import retrieve

FEEDBACK, QUERY = "feedback_id long, collection string, q_vec array<double>", "query_id long, collection string, q_vec array<double>"


def _plain(feedback, query, least):
    out = {}
    for q, qc, qv in query:
        for f, fc, fv in feedback:
            if qc is None or qc != fc or qv is None or fv is None or len(qv) != len(fv):
                continue
            bottom = np.linalg.norm(qv) * np.linalg.norm(fv)
            score = round(float(np.dot(qv, fv) / bottom), 6) if bottom > 0 else 0.0
            if score >= least:
                out[q, f] = score
    return out


def _clusters(rng, n, first, spread):
    centres = rng.normal(size=(12, 8))
    return [(first + i, "hot" if i % 3 else "cold", (centres[i % 12] + spread * rng.normal(size=8)).tolist()) for i in range(n)]


@pytest.mark.parametrize("least", [0.8, 0.3, 0.0, -1.0])
def test_blocks_lose_no_pair(spark, least):
    feedback = _clusters(np.random.default_rng(3), 400, 0, 0.1)
    feedback += [(1000, "hot", [0.0] * 8), (1001, "hot", None), (1002, None, [1.0] * 8), (1003, "hot", [1.0, 2.0]), (1004, "new", [3.0] * 8), (1005, "hot", feedback[1][2])]
    query = _clusters(np.random.default_rng(3), 60, 0, 0.1)
    query += [(900, "hot", [0.0] * 8), (901, "hot", [2.0, 4.0]), (902, "hot", None), (903, None, [1.0] * 8), (904, "gone", [1.0] * 8), (905, "new", [1.0] * 8)]
    rows, blocks = retrieve.similar_and_blocks(spark.createDataFrame(feedback, FEEDBACK), spark.createDataFrame(query, QUERY), least, query_block=8, chunk_block=30)
    got = {(r.query_id, r.feedback_id): r.similarity for r in rows.collect()}
    want = _plain(feedback, query, least)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) <= 1e-6 for k in got)
    assert rows.count() == len(got)
    skipped, total = blocks.agg(F.count_if(~F.col("meets")), F.count("*")).first()
    if least == 0.8:
        assert skipped >= total / 2, f"{skipped} of {total} pairs of blocks skipped"
    if least == -1.0:
        assert skipped == 0


def test_no_feedback_and_no_queries(spark):
    feedback, query = spark.createDataFrame(_clusters(np.random.default_rng(1), 9, 0, 0.1), FEEDBACK), spark.createDataFrame([(1, "hot", [1.0] * 8)], QUERY)
    assert retrieve.similar_feedback(feedback.limit(0), query).collect() == []
    assert retrieve.similar_feedback(feedback, query.limit(0)).collect() == []
