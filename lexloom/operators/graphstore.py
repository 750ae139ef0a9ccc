"""A property graph that lasts: node and edge tables under one folder, written in batches, deletes as recorded id sets.

Edges are kept twice, sorted by source and by target, so that a traversal in either direction reads files whose statistics
tell where its nodes are. A merge appends a batch and rewrites nothing; a delete appends the ids that go, which hide what
earlier batches hold of them when the graph is read. ``compact`` writes what is visible as one batch. A batch counts once its
marker file is there, so a job that fails halfway leaves nothing visible and a new session sees the same graph.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import Graph, gone_with

NODES, EDGES = "id string, label string, props map<string,string>", "src string, dst string, label string"


class GraphStore:
    """Batches are numbered; the newest base (a compacted batch) and those behind it are the graph."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def batches(self) -> list[dict]:
        """Markers {n, kind} of the batches that count, in order: the newest base first, then merges and deletes."""
        fs, path = self._fs()
        folder = path(f"{self.root}/_batches")
        if not fs.exists(folder):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(folder))
        marks = [dict(zip(("n", "kind"), name.removesuffix(".json").split("-"))) for name in names if name.endswith(".json")]
        last = max((i for i, m in enumerate(marks) if m["kind"] == "base"), default=0)
        return marks[last:]

    def _commit(self, n: str, kind: str) -> None:
        fs, path = self._fs()
        out = fs.create(path(f"{self.root}/_batches/{n}-{kind}.json"), False)  # another writer's batch of this number fails here
        out.write(bytearray(json.dumps({"n": n, "kind": kind}).encode()))
        out.close()

    def _next(self) -> str:
        marks = self.batches()
        return f"{int(marks[-1]['n']) + 1 if marks else 0:09d}"

    def _write(self, n: str, kind: str, nodes: DataFrame, edges: DataFrame) -> None:
        nodes = nodes.select("id", "label", "props").where("id IS NOT NULL AND label IS NOT NULL")
        edges = edges.select("src", "dst", "label").where("src IS NOT NULL AND dst IS NOT NULL").distinct()
        into = lambda rows, name, by: rows.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite").parquet(f"{self.root}/{name}/{n}")
        into(nodes, "nodes", ["id", "label"])
        into(edges, "edges_out", ["src", "dst"])
        into(edges, "edges_in", ["dst", "src"])
        self._commit(n, kind)

    def merge(self, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> None:
        """Nodes by (id, label), whose properties win over older ones; edges are a set. Rows without ids are left out."""
        empty = self.spark.createDataFrame
        self._write(self._next(), "merge", empty([], NODES) if nodes is None else nodes, empty([], EDGES) if edges is None else edges)

    def delete(self, ids: DataFrame) -> None:
        """Nodes of these ids (id) and their edges go; a node that is merged later is a new one."""
        n = self._next()
        ids.select("id").where("id IS NOT NULL").distinct().write.mode("overwrite").parquet(f"{self.root}/gone/{n}")
        self._commit(n, "gone")

    def _visible(self, name: str, schema: str, keys: list[str]) -> DataFrame:
        marks = self.batches()
        own = [m["n"] for m in marks if m["kind"] != "gone"]
        if not own:
            return self.spark.createDataFrame([], schema).withColumn("batch", F.lit(0))
        number = lambda: F.regexp_extract(F.col("_metadata.file_path"), r"/(\d{9})/[^/]*$", 1).cast("int")
        rows = self.spark.read.schema(schema).parquet(*[f"{self.root}/{name}/{n}" for n in own]).withColumn("batch", number())
        gone = [m["n"] for m in marks if m["kind"] == "gone"]
        if not gone:
            return rows
        hidden = self.spark.read.schema("id string").parquet(*[f"{self.root}/gone/{n}" for n in gone]).withColumn("until", number()).groupBy("id").agg(F.max("until").alias("until"))
        for key in keys:
            rows = rows.join(hidden.select(F.col("id").alias(key), "until"), key, "left").where("until IS NULL OR batch > until").drop("until")
        return rows

    def nodes(self, where: Column | None = None) -> DataFrame:
        """(id, label, props), one row a node; a property has its newest value. ``where`` tests id and label and reaches the files."""
        rows = self._visible("nodes", NODES, ["id"])
        rows = rows if where is None else rows.where(where)
        each = rows.select("id", "label", "batch", F.explode_outer("props").alias("k", "v"))
        # Of one batch's repeated rows the greatest value counts, as in graph.merge_nodes.
        last = each.groupBy("id", "label", "k").agg(F.max(F.struct("batch", "v"))["v"].alias("v"))
        entry = F.when(F.col("k").isNotNull(), F.struct("k", "v"))
        return last.groupBy("id", "label").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("props"))

    def edges(self, by: str = "src", where: Column | None = None) -> DataFrame:
        """(src, dst, label), from the files that are sorted by ``by``."""
        rows = self._visible({"src": "edges_out", "dst": "edges_in"}[by], EDGES, ["src", "dst"])
        rows = rows if where is None else rows.where(where)
        return rows.select("src", "dst", "label").distinct()

    def graph(self) -> Graph:
        return Graph(self.nodes(), self.edges())

    def neighbours(self, starts: DataFrame, label: str | None = None, reverse: bool = False) -> DataFrame:
        """(start, id): nodes one edge away from the starts (id), against the edges' direction with ``reverse``."""
        here, there = ("dst", "src") if reverse else ("src", "dst")
        edges = self.edges(here, None if label is None else F.col("label") == label)
        return starts.select(F.col("id").alias(here)).distinct().join(edges, here).select(F.col(here).alias("start"), F.col(there).alias("id")).distinct()

    def cascade_files(self, files: DataFrame) -> None:
        """Without the files (id), their chunks, and entities whose file_id is theirs."""
        self.delete(gone_with(self.graph(), files.select("id").distinct()))

    def cascade_collections(self, collections: DataFrame) -> None:
        """Without the collections (id), their documents, chunks and the documents' own entities."""
        ids = collections.select("id").distinct()
        files = self.neighbours(ids, "CONTAINS").select("id").distinct()
        self.delete(gone_with(self.graph(), files, ids))

    def compact(self) -> None:
        """Write what is visible as a base batch; older batches no longer count and may be removed by ``vacuum``."""
        self._write(self._next(), "base", self.nodes(), self.edges())

    def vacuum(self) -> int:
        """Remove the files of batches that no longer count, and of none that counts; how many batches went."""
        fs, path = self._fs()
        kept, gone = {m["n"] for m in self.batches()}, set()
        for name in ("nodes", "edges_out", "edges_in", "gone"):
            if fs.exists(path(f"{self.root}/{name}")):
                for s in fs.listStatus(path(f"{self.root}/{name}")):
                    if (n := s.getPath().getName()) not in kept and n < min(kept, default=""):
                        fs.delete(s.getPath(), True)
                        gone.add(n)
        return len(gone)
