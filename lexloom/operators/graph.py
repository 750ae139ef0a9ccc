"""The property graph as frames: nodes(id, label, props) and edges(src, dst, label).

Upserts are set operations by key, traversals are equi-joins, existence tests are semi joins, and a
cascade delete is an id set that is anti-joined from every table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .store import merge_properties


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame

    def scan(self, label: str, where: Column | None = None) -> DataFrame:
        """Nodes of a label."""
        found = self.nodes.where(F.col("label") == label)
        return found if where is None else found.where(where)


def merge_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """One node per (id, label); properties merge, new ones win.

    Repeated new rows all count: a property that several of them give takes the greatest value. Null ids or labels join nothing.
    """
    joined = old.alias("o").join(_one(new).alias("n"), ["id", "label"], "full_outer")
    return joined.select("id", "label", merge_properties(F.col("o.props"), F.col("n.props")).alias("props"))


def _one(nodes: DataFrame) -> DataFrame:
    """One row per (id, label) with the properties of all its rows."""
    each = nodes.select("id", "label", F.explode_outer("props").alias("k", "v")).groupBy("id", "label", "k").agg(F.max("v").alias("v"))
    entry = F.when(F.col("k").isNotNull(), F.struct("k", "v"))
    return each.groupBy("id", "label").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("props"))


def merge_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges are a set."""
    return old.select("src", "dst", "label").unionByName(new.select("src", "dst", "label")).distinct()


def entity_rows(file_id: Column, name: Column, kind: Column) -> Column:
    """An entity's node, its id prefixed by the file's."""
    return F.struct(F.concat_ws("_", file_id, name).alias("id"), kind.alias("label"), F.create_map(F.lit("name"), name, F.lit("file_id"), file_id).alias("props"))


def link(chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """MENTIONS edges from (chunk_id, entity_ids array) to known entities; each once."""
    pairs = chunks.select("chunk_id", F.explode(F.array_distinct("entity_ids")).alias("id"))
    return pairs.join(entities.select("id"), "id").select(F.col("chunk_id").alias("src"), F.col("id").alias("dst"), F.lit("MENTIONS").alias("label")).distinct()


def two_hops(edges: DataFrame, first: str, second: str) -> DataFrame:
    """(src, mid, dst) along two edge labels."""
    a = edges.where(F.col("label") == first).select("src", F.col("dst").alias("mid"))
    b = edges.where(F.col("label") == second).select(F.col("src").alias("mid"), "dst")
    return a.join(b, "mid").select("src", "mid", "dst")


def chunks_where_collection(chunks: DataFrame, edges: DataFrame, collections: DataFrame) -> DataFrame:
    """Chunks for which one of ``collections`` (id) EXISTS over CONTAINS and HAS_CHUNK."""
    owned = edges.where("label = 'CONTAINS'").join(collections.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("src"))
    reached = edges.where("label = 'HAS_CHUNK'").join(owned, "src", "left_semi").select(F.col("dst").alias("id"))
    return chunks.join(reached, "id", "left_semi")


def chunks_where(graph: Graph, collection_ids: list[str] | None = None, file_ids: list[str] | None = None, content_type: str | None = None, subcategory: str | None = None) -> DataFrame:
    """Chunk nodes under all given clauses; those that are None are left out.

    Collections and files are properties of a chunk. The content type is that of a collection that CONTAINS a
    document that HAS the chunk, the subcategory that of such a document: both are semi joins.
    """
    prop = lambda name: F.try_element_at("props", F.lit(name))
    rows = graph.scan("Chunk")
    if collection_ids:
        rows = rows.where(prop("collection_id").isin(collection_ids))
    if file_ids:
        rows = rows.where(prop("file_id").isin(file_ids))
    if content_type:
        rows = chunks_where_collection(rows, graph.edges, graph.scan("Collection", prop("content_type") == content_type))
    if subcategory:
        documents = graph.scan("Document", prop("news_subcategory") == subcategory).select(F.col("id").alias("src"))
        reached = graph.edges.where("label = 'HAS_CHUNK'").join(documents, "src", "left_semi").select(F.col("dst").alias("id"))
        rows = rows.join(reached, "id", "left_semi")
    return rows


def newest_statutes(nodes: DataFrame, limit: int | None = None) -> DataFrame:
    """(id, name, year, sections, indexed_at, doc_type) of statutes, newest first; those without a time lead, as a descending order has it."""
    prop = lambda name: F.try_element_at("props", F.lit(name))
    rows = nodes.where("label = 'Statute'").select("id", prop("name").alias("name"), prop("year").alias("year"), prop("total_sections").alias("sections"), prop("indexed_at").alias("indexed_at"), prop("document_type").alias("doc_type"))
    ordered = rows.orderBy(F.desc_nulls_first("indexed_at"), "id")
    return ordered if limit is None else ordered.limit(limit)


def cascade_file(graph: Graph, files: DataFrame) -> Graph:
    """Without the files (id), their chunks, and entities whose file_id is theirs."""
    return _cascade(graph, files.select("id").distinct())


def cascade_collection(graph: Graph, collections: DataFrame) -> Graph:
    """Without the collections (id), their documents, chunks and the documents' own entities."""
    ids = collections.select("id").distinct()
    files = graph.edges.where("label = 'CONTAINS'").join(ids.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
    return _cascade(graph, files, ids)


def gone_with(graph: Graph, files: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """(id) of the files, their chunks and their own entities, and of ``more``; each once."""
    chunks = graph.edges.where("label = 'HAS_CHUNK'").join(files.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"))
    owner = F.try_element_at("props", F.lit("file_id"))
    own = graph.nodes.where(~F.col("label").isin("Document", "Chunk", "Collection")).withColumn("_f", owner).join(files.select(F.col("id").alias("_f")), "_f", "left_semi").select("id")
    gone = files.unionByName(chunks).unionByName(own)
    return (gone if more is None else gone.unionByName(more)).distinct()


def _cascade(graph: Graph, files: DataFrame, more: DataFrame | None = None) -> Graph:
    # Three anti joins read the ids, so they are found once.
    gone = materialise(gone_with(graph, files, more), "gone")
    nodes = graph.nodes.join(gone, "id", "left_anti")
    edges = graph.edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti")
    return Graph(nodes, edges.select("src", "dst", "label"))


def cleanup_prefix(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    """Rows whose value doesn't start with the prefix (nulls stay)."""
    return rows.where(~F.coalesce(F.startswith(F.col(column), F.lit(prefix)), F.lit(False)))


def cleanup_statute(graph: Graph, statutes: DataFrame) -> Graph:
    """Without the statutes' chapters, sections and chunks; the statute nodes stay."""
    ids = statutes.select(F.col("id").alias("src")).distinct()
    below = graph.edges.where("label IN ('HAS_CHAPTER', 'HAS_SECTION', 'HAS_CHUNK')").join(ids, "src", "left_semi").select(F.col("dst").alias("id"))
    deeper = graph.edges.where("label = 'CONTAINS_SECTION'").join(below.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"))
    gone = below.unionByName(deeper).distinct()
    edges = graph.edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti")
    return Graph(graph.nodes.join(gone, "id", "left_anti"), edges.select("src", "dst", "label"))


def ingest_stats(chunks: DataFrame) -> DataFrame:
    """Chunks, distinct chapters and distinct sections."""
    return chunks.agg(F.count("*").alias("chunks"), F.count_distinct("chapter_number").alias("chapters"), F.count_distinct("section_number").alias("sections"))


def statute_graph(acts: DataFrame) -> Graph:
    """Statute, chapter and section nodes with their edges, from parsed acts (act_id, name, year, chapters, sections).

    N6: of chapters with one number a later one wins only if it has sections. J10: a section hangs on the
    chapter with its number if there is one, always on the statute.
    """
    text = lambda c: F.col(c).cast("string")
    statutes = acts.select(F.col("act_id").alias("id"), F.lit("Statute").alias("label"), F.create_map(F.lit("name"), text("name"), F.lit("year"), text("year")).alias("props"))
    chapter = acts.select("act_id", F.posexplode("chapters").alias("pos", "c")).select("act_id", "pos", "c.*")
    has = F.size("section_numbers") > 0
    best = Window.partitionBy("act_id", "number").orderBy(has.cast("int").desc(), F.when(has, -F.col("pos")).otherwise(F.col("pos")))
    chapter = chapter.withColumn("_n", F.row_number().over(best)).where("_n = 1").withColumn("id", F.concat_ws("_ch_", "act_id", "number"))
    section = acts.select("act_id", F.posexplode("sections").alias("pos", "s")).select("act_id", "pos", "s.*").withColumn("id", F.concat_ws("_sec_", "act_id", "number"))
    first = Window.partitionBy("id").orderBy("pos")
    section = section.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    nodes = statutes.unionByName(chapter.select("id", F.lit("Chapter").alias("label"), F.create_map(F.lit("number"), text("number"), F.lit("title"), text("title")).alias("props")))
    nodes = nodes.unionByName(section.select("id", F.lit("Section").alias("label"), F.create_map(F.lit("number"), text("number"), F.lit("title"), text("title")).alias("props")))
    inside = section.join(chapter.select("act_id", F.col("number").alias("chapter_number"), F.col("id").alias("chapter_id")), ["act_id", "chapter_number"])
    edges = chapter.select(F.col("act_id").alias("src"), F.col("id").alias("dst"), F.lit("HAS_CHAPTER").alias("label"))
    edges = edges.unionByName(section.select(F.col("act_id").alias("src"), F.col("id").alias("dst"), F.lit("HAS_SECTION").alias("label")))
    edges = edges.unionByName(inside.select(F.col("chapter_id").alias("src"), F.col("id").alias("dst"), F.lit("CONTAINS_SECTION").alias("label")))
    return Graph(nodes, edges)
