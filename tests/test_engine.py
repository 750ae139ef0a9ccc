"""The engine's calls, the store, streams and readers on small data."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lexloom.engine import Engine, user_collection
from lexloom.operators import graph, ingest, store
from lexloom.sources import readers
from lexloom.streaming import incremental

DOCS = [
    ("c1", "f1", "Force is a push. What is force? Newton gave three laws of motion.", "file", "book"),
    ("c1", "f2", "Tea grows on hills. It is picked by hand.", "web", "news"),
    ("c2", "f3", "Force equals mass times acceleration.", "file", "book"),
    ("c2", "f4", "  ", "file", "book"),
]
COLUMNS = "collection_id string, file_id string, text string, source_type string, content_type string"


def test_life_of_a_collection(spark, tmp_path):
    engine, name = Engine(spark, f"file://{tmp_path}/db"), user_collection("7")
    assert engine.create(name) and not engine.create(name) and engine.store.list() == ["user_7"]
    docs = spark.createDataFrame(DOCS, COLUMNS)
    got = {r.file_id: (r.status, r.chunk_count) for r in engine.link_content(name, docs).collect()}
    assert got == {"f1": ("SUCCESS", 1), "f2": ("SUCCESS", 1), "f3": ("SUCCESS", 1), "f4": ("FAILED", 0)}
    chunks = ingest.ingest(docs)
    assert engine.store.upsert(name, chunks.select(engine.store.read(name).columns)) == 0  # the same again
    hits = engine.retrieve(name, ["force equals mass", "tea grows"], k=2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.file_id) for r in hits if r["rank"] == 1 and r.score > 0] == [(0, "f3"), (1, "f2")]
    only = engine.retrieve(name, ["force"], k=5, collection_ids=["c1"], content_type="book").collect()
    assert [r.file_id for r in only] == ["f1"]
    answer = engine.query(name, ["force equals mass", "zzz qqq"]).orderBy("query_id").collect()
    assert answer[0].is_relevant and "acceleration" in answer[0].answer and answer[1].answer == "Context not found"
    assert {(r.collection_id, r.total_files) for r in engine.status(name).collect()} == {("c1", 2), ("c2", 1)}
    assert [r.chunk_id for r in engine.chunks(name, 1, after="f1_chunk_1").collect()] == ["f2_chunk_1"]
    engine.delete_files(name, "c1", ["f1"])
    status = {r.file_id: r.status for r in engine.files_status(name, "c1", ["f1", "f2"]).collect()}
    assert status == {"f1": "NOT_FOUND", "f2": "INDEXED"}
    assert engine.delete_collection(name, "c2") and engine.status(name).count() == 1
    assert engine.delete_collection(name) and not engine.delete_collection(name)


def test_wrong_vectors_and_empty_criteria_are_refused(spark, tmp_path):
    s = store.CollectionStore(spark, f"file://{tmp_path}/db", dim=3)
    rows = spark.createDataFrame([("c", "k", [1.0, 2.0])], "collection_id string, chunk_id string, embedding array<float>")
    s.create("x", rows.schema)
    with pytest.raises(Exception, match="3 dimensions"):
        s.append("x", rows)
    with pytest.raises(ValueError):
        s.delete("x")
    with pytest.raises(ValueError):
        s.create("../up", rows.schema)


def test_streamed_ingest_is_idempotent(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/db")
    engine.create("s")
    docs = spark.createDataFrame(DOCS, COLUMNS)
    docs.write.parquet(f"{tmp_path}/in")
    prepare = lambda rows: ingest.ingest(rows).select(engine.store.read("s").columns)
    for n in ("a", "b"):  # a second stream replays everything
        stream = spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/in")
        incremental.ingest_stream(stream, engine.store, "s", f"{tmp_path}/cp_{n}", prepare=prepare).awaitTermination(120)
    assert engine.store.read("s").count() == 3


def test_streamed_segments_close_when_full(spark, tmp_path):
    rows = [(1, 0.0, 100.0, "a"), (1, 1.0, 10.0, "b"), (1, 2.0, 50.0, "c"), (1, 3.0, 40.0, "d"), (1, 4.0, 1.0, "e"), (2, 0.0, 5.0, "x")]
    df = spark.createDataFrame(rows, "video_id long, start double, duration double, text string")
    df.write.parquet(f"{tmp_path}/t")
    stream = incremental.segment_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/t"))
    q = stream.writeStream.format("memory").queryName("segments").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.video_id, r.start, r.text) for r in spark.table("segments").collect()) == [(1, 0.0, "a b"), (1, 2.0, "c d")]


def test_readers(spark, tmp_path):
    good = {"name": "The X Act", "year": 1990, "sections": [{"number": "1", "title": "T", "content": "c"}], "metadata": {"source_file": "x", "text_length": 5}}
    (tmp_path / "acts").mkdir()
    (tmp_path / "acts/a.json").write_text(json.dumps(good, indent=1))
    (tmp_path / "acts/b.json").write_text("{broken")
    acts = {r._source_file: r for r in readers.parsed_acts(spark, str(tmp_path / "acts")).collect()}
    assert acts["a.json"].sections[0].title == "T" and acts["a.json"].metadata["text_length"] == "5" and acts["b.json"].name is None
    log = spark.createDataFrame([("q", [1.0], ["d"], 1, "c", "2020-01-01T00:00:00Z")], readers.FEEDBACK)
    store.append_feedback(log, str(tmp_path / "log"))
    store.append_feedback(log, str(tmp_path / "log"))
    assert readers.feedback_log(spark, str(tmp_path / "log")).count() == 2
    assert readers.files(spark, str(tmp_path / "acts"), "*.json").count() == 2
    parsers = readers.Parsers()
    parsers.register("web", lambda df: df.withColumn("text", F.lit("t")))
    items = spark.createDataFrame([("i1", "web"), ("i2", "tape")], "id string, source_type string")
    assert {(r.id, r.error) for r in parsers.parse(items, ["id", "text"]).collect()} == {("i1", None), ("i2", "no parser")}


def test_graph_upserts_and_cascades(spark):
    node = "id string, label string, props map<string,string>"
    old = spark.createDataFrame([("a", "Document", {"x": "1", "y": "1"})], node)
    new = spark.createDataFrame([("a", "Document", {"y": "2"}), ("b", "Chunk", None)], node)
    merged = {r.id: r.props for r in graph.merge_nodes(old, new).collect()}
    assert merged == {"a": {"x": "1", "y": "2"}, "b": {}}
    edge = "src string, dst string, label string"
    g = graph.Graph(
        spark.createDataFrame([("f", "Document", {}), ("g", "Document", {}), ("c1", "Chunk", {}), ("e1", "Person", {"file_id": "f"}), ("e2", "Person", {"file_id": "g"})], node),
        spark.createDataFrame([("f", "c1", "HAS_CHUNK"), ("c1", "e2", "MENTIONS"), ("g", "e2", "HAS")], edge),
    )
    left = graph.cascade_file(g, g.scan("Document", F.col("id") == "f"))
    assert {r.id for r in left.nodes.collect()} == {"g", "e2"} and left.edges.count() == 1


def test_reingests_replace_what_a_file_had(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/db")
    engine.create("r")
    long = " ".join(f"Sentence number {i} of a text that goes on and on for a while." for i in range(120))
    row = lambda c, f, t: (c, f, t, "file", "legal")
    schema = "collection_id string, file_id string, text string, source_type string, content_type string"
    frame = lambda *rows: spark.createDataFrame([row(*r) for r in rows], schema)
    chunks = lambda: {(r.collection_id, r.file_id): r["count"] for r in engine.store.read("r").groupBy("collection_id", "file_id").count().collect()}
    first = {(r.collection_id, r.file_id): (r.status, r.chunk_count) for r in engine.link_content("r", frame(("a", "f", long), ("b", "f", "Other text of the same file id."), ("a", "g", "Short text."))).collect()}
    assert first["a", "f"][0] == "SUCCESS" and first["a", "f"][1] > 5 and first["b", "f"] == ("SUCCESS", 1)
    before = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "db/r/data/collection_id=b").glob("*.parquet")}
    engine.link_content("r", frame(("a", "f", "One sentence.")))  # shrinks
    assert chunks() == {("a", "f"): 1, ("b", "f"): 1, ("a", "g"): 1}
    assert before == {p.name: p.stat().st_mtime_ns for p in (tmp_path / "db/r/data/collection_id=b").glob("*.parquet")}
    blank = engine.link_content("r", frame(("b", "f", "  "), ("a", "g", "Short text."))).collect()
    assert {(r.collection_id, r.file_id): (r.status, r.chunk_count) for r in blank} == {("b", "f"): ("FAILED", 0), ("a", "g"): ("SUCCESS", 1)}
    assert chunks() == {("a", "f"): 1, ("a", "g"): 1} and not (tmp_path / "db/r/data/collection_id=b").exists()
    assert engine.list() == ["r"] and engine.health()["store"] == "ok"


def test_repeated_new_nodes_merge_their_properties(spark):
    node = "id string, label string, props map<string,string>"
    old = spark.createDataFrame([("a", "D", {"w": "0", "x": "0"})], node)
    new = spark.createDataFrame([("a", "D", {"x": "1"}), ("a", "D", {"y": "2"}), ("a", "D", {"z": "3", "y": "1"}), ("b", "D", None), ("b", "D", {})], node)
    assert {r.id: r.props for r in graph.merge_nodes(old, new).collect()} == {"a": {"w": "0", "x": "1", "y": "2", "z": "3"}, "b": {}}


def test_filters_and_command_line(capsys):
    from lexloom import __main__ as cli
    from lexloom.engine import filters_of

    assert filters_of({"collection_ids": "c", "file_ids": [], "content_type": "BOOK", "top_k": 3}) == {"collection_ids": ["c"], "content_type": "book"}
    assert filters_of({}) == {}
    assert cli.main(["list"]) == 0 and "vector_topk" in capsys.readouterr().out.split()
    assert cli.main(["sql", "vector_topk"]) == 0 and "SELECT" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["run", "nothing", "/tmp"])
