"""Scans over blocks: equal to windows over whole documents, and a long document is many tasks."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lexloom.operators import legal, media, segments


@pytest.mark.parametrize("size", [1, 3, 10_000])
def test_scans_equal_windows(spark, size):
    rng = random.Random(size)
    rows = [(d, p, rng.choice([None, None, rng.randint(0, 9)]), f"v{p}") for d in (1, 2, 3) for p in sorted(rng.sample(range(60), 25 if d < 3 else 1))] + [(None, 1, 2, "x")]
    frame = segments.blocked(spark.createDataFrame(rows, "d int, pos long, n int, v string").repartition(3), size=size)
    got = segments.running(segments.ahead(frame, ["d"], ["pos"], F.col("n"), 4), ["d"], ["pos"], {"total": F.col("n")}, {"seen": F.col("n")})
    w = Window.partitionBy("d").orderBy("pos")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = frame.where("d IS NOT NULL").withColumns({"total": F.sum(F.coalesce("n", F.lit(0))).over(upto), "seen": F.last("n", ignorenulls=True).over(upto), "_ahead": F.collect_list(F.struct(F.col("n").alias("v"))).over(w.rowsBetween(1, 4))})
    columns = ["d", "pos", "n", "v", "total", "seen", "_ahead"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def _statute(n):
    rng, lines = random.Random(8), ["CHAPTER I", "CONTENTS OF IT"]
    for i in range(n):
        if i % 40 == 0:
            lines += [f"CHAPTER {i + 1}", *[""] * rng.randint(0, 2), "GENERAL MATTERS", ""]
        lines += [f"{rng.randint(1, n)}. Title of {i}", *[rng.choice(["words here", "", "Provided that it may", "2. ins. by Act"]) for _ in range(rng.randint(0, 6))]]
    return lines


def test_a_long_document_is_many_tasks(spark, monkeypatch):
    """The same sections and chapters whatever the blocks; one document's lines lie in many partitions."""
    rows = [(1, i, t) for i, t in enumerate(_statute(200))] + [(2, i, t) for i, t in enumerate(_statute(5))] + [(3, 0, ""), (4, 0, None)]
    lines = spark.createDataFrame(rows, "doc_id int, pos int, line string")
    found = {}
    for size in (100_000, 7):
        monkeypatch.setattr(segments, "BLOCK", size)
        chapters, sections = legal.chapters_and_sections(lines)
        found[size] = sorted(map(str, sections.collect())), sorted(map(str, chapters.collect()))
    assert found[7] == found[100_000] and len(found[7][0]) > 80
    placed = segments.running(segments.blocked(lines), ["doc_id"], ["pos"], {"n": F.lit(1)}).where("doc_id = 1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert placed.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_medians_without_lists(spark):
    rng = random.Random(3)
    rows = [(g, rng.choice([None, 1.5, 2.0, 7.25])) for g in "aab" * 40] + [("c", None), ("d", 4.0), (None, 1.0)]
    frame = spark.createDataFrame(rows, "g string, x double")
    found = media.upper_median(frame, ["g"], F.col("x"))
    assert "collect_list" not in found._jdf.queryExecution().executedPlan().toString()
    by = {}
    for g, x in rows:
        if x is not None:
            by.setdefault(g, []).append(x)
    assert dict(map(tuple, found.collect())) == {g: sorted(v)[len(v) // 2] for g, v in by.items()}


def test_repeated_sections_keep_their_rows(spark):
    sections = spark.createDataFrame([(1, 5, "a"), (1, 5, "a"), (1, 50, "b"), (2, 5, "c"), (1, None, "d")], "doc_id int, pos int, number string")
    chapters = spark.createDataFrame([(1, 0, 10, "I"), (1, 4, 6, "II")], "doc_id int, start int, end int, number string")
    got = sorted(map(str, (tuple(r) for r in legal.chapter_by_position(sections, chapters).collect())))
    assert got == sorted(map(str, [(1, 5, "a", "I"), (1, 5, "a", "I"), (1, 50, "b", None), (2, 5, "c", None), (1, None, "d", None)]))


def _walked(near, lengths, threshold, least, most):
    starts = [0]
    for gap in range(len(near)):
        upto = lengths[starts[-1] : gap + 2]
        size = sum(upto) + len(upto) - 1  # with the next sentence
        if size > least and (near[gap] < threshold or size > most):
            starts.append(gap + 1)
    last = lengths[starts[-1] :]
    return starts[:-1] if len(starts) > 2 and sum(last) + len(last) - 1 < least else starts


def test_split_points_equal_a_walk():
    import random

    from lexloom.operators import chunking

    rng = random.Random(5)
    for _ in range(3000):
        lengths = [rng.randint(11, 400) for _ in range(rng.randint(1, 40))]
        near = [rng.random() for _ in lengths[1:]]
        least, most = rng.choice([(200, 1500), (30, 500), (100, 100), (0, 50)])
        assert chunking.split_points(near, lengths, 0.5, least, most) == _walked(near, lengths, 0.5, least, most)
