"""The written graph against frames, over sessions and failed batches; containment by the rarest piece."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lexloom.operators import graph, graphstore, store

NODES, EDGES = graphstore.NODES, graphstore.EDGES


def _rows(frame):
    return sorted(tuple(sorted(v.items()) if isinstance(v, dict) else v for v in r) for r in frame.collect())


def test_merges_and_deletes_equal_frames(spark, tmp_path):
    rng = random.Random(6)
    written = graphstore.GraphStore(spark, f"file://{tmp_path}/g")
    frames = graph.Graph(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES))
    assert written.nodes().collect() == [] and written.edges().collect() == []
    for step in range(4):
        nodes = spark.createDataFrame([(f"n{rng.randint(0, 20)}", rng.choice(["Chunk", "Type", "Document"]), rng.choice([None, {}, {"a": str(rng.randint(0, 9))}, {"b": "x", "file_id": "n1"}])) for _ in range(15)], NODES)
        edges = spark.createDataFrame([(f"n{rng.randint(0, 20)}", f"n{rng.randint(0, 20)}", rng.choice(["HAS_CHUNK", "MENTIONS"])) for _ in range(20)], EDGES)
        odd = spark.createDataFrame([(None, "n1", "MENTIONS"), ("n1", None, "MENTIONS")], EDGES)
        written.merge(nodes, edges.unionByName(odd).unionByName(edges))
        frames = graph.Graph(graph.merge_nodes(frames.nodes, nodes), graph.merge_edges(frames.edges, edges))
        if step in (1, 2):
            files = spark.createDataFrame([(f"n{step}",), (None,)], "id string")
            written.cascade_files(files)
            frames = graph.cascade_file(frames, files.where("id IS NOT NULL"))
        if step == 2:
            before = len(written.batches())
            written.compact()
            assert len(written.batches()) == 1 < before and written.vacuum() == before
        again = graphstore.GraphStore(spark, f"file://{tmp_path}/g")
        assert _rows(again.nodes()) == [(*r[:2], r[2] or []) if r[2] is None else r for r in _rows(frames.nodes.withColumn("props", F.coalesce("props", F.create_map().cast("map<string,string>"))))]
        assert _rows(again.edges("dst")) == _rows(again.edges("src")) == _rows(frames.edges)
    # a batch without its marker isn't there
    spark.createDataFrame([("half", "Type", {})], NODES).write.parquet(f"{tmp_path}/g/nodes/{written._next()}")
    assert "half" not in {r.id for r in written.nodes().collect()}
    with pytest.raises(Exception, match="exist"):
        written._commit(written.batches()[-1]["n"], written.batches()[-1]["kind"])


def test_names_that_share_their_beginning(spark, monkeypatch):
    """Their first characters no longer decide the work: every name is looked up by a rarer piece."""
    rng = random.Random(2)
    names = sorted({"The same beginning of " + "".join(rng.choice("abc") for _ in range(6)) for _ in range(120)})
    long = sorted({n + rng.choice(["", " (revised)", " act"]) for n in names} | {"x" * 30, "", "abc"})
    short = sorted({*names[:60], "", "abc", "The", "same beginning of", "zzz", "The same beginning of nothing", "x" * 9})
    want = sorted((s, t) for s in short for t in long if s in t)
    frames = [spark.createDataFrame([(x,) for x in xs], f"{c} string") for xs, c in ((short, "s"), (long, "t"))]
    for hot in (10_000, 3):
        monkeypatch.setattr(store, "HOT", hot)
        got = store.contained(*frames)
        assert sorted(map(tuple, got.select("s", "t").collect())) == want
    assert store.contained(frames[0].where("s = ''"), frames[1]).count() == len(long)
    assert store.contained(frames[0].limit(0), frames[1]).collect() == []
