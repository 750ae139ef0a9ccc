"""Queries through the engine, the store's files and the readers; each run has a folder of its own in the shared one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..engine import Engine
from ..operators import graphstore, ingest, store
from ..session import scratch
from ..sources import readers
from .book import Book, table
from .chunks import _FOLD

book = Book()
_PACKED = _FOLD.format(name="e", key="doc_id", size=800, overlap=100, source="documents")


@book.query(f"""WITH {_PACKED}, n AS (SELECT source, doc_id, CASE WHEN doc_id % 3 = 0 THEN 1 WHEN doc_id % 3 = 1 AND doc_id % 2 = 0 THEN 0 ELSE coalesce(len(chunks), 0) END AS n FROM documents LEFT JOIN folded_e USING (doc_id))
SELECT source AS collection_id, count(*)::BIGINT AS total_files, sum(n)::BIGINT AS total_chunks FROM n WHERE n > 0 GROUP BY 1""")
def engine_status(spark, sf_dir):
    """Ingest every document, then shorter versions of a third and blank ones of a sixth; the status of the collections."""
    engine = Engine(spark, scratch(spark, "store"))
    engine.create("library")
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("collection_id"), F.col("doc_id").cast("string").alias("file_id"), "doc_id", "text", F.lit("web").alias("source_type"), F.lit("legal").alias("content_type"))
    engine.link_content("library", docs.drop("doc_id"))
    changed = docs.where("doc_id % 3 = 0 OR (doc_id % 3 = 1 AND doc_id % 2 = 0)")
    engine.link_content("library", changed.withColumn("text", F.when(F.col("doc_id") % 3 == 0, "One sentence.").otherwise(" ")).drop("doc_id"))
    return engine.status("library")


@book.query(f"""WITH {_PACKED} SELECT source AS collection_id, doc_id::VARCHAR AS file_id, CASE WHEN len(chunks) > 0 THEN 'SUCCESS' ELSE 'FAILED' END AS status, coalesce(len(chunks), 0)::BIGINT AS chunk_count FROM documents LEFT JOIN folded_e USING (doc_id)""")
def engine_outcomes(spark, sf_dir):
    """One outcome for each document of a batch; every file id occurs in a second collection too."""
    engine = Engine(spark, scratch(spark, "store"))
    engine.create("library")
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("collection_id"), F.col("doc_id").cast("string").alias("file_id"), "text", F.lit("web").alias("source_type"), F.lit("legal").alias("content_type"))
    engine.link_content("library", docs.withColumn("collection_id", F.lit("other")).withColumn("text", F.lit("One sentence.")))
    return engine.link_content("library", docs).select("collection_id", "file_id", "status", "chunk_count")


@book.query("""SELECT p_brand AS name, (1900 + max(p_size))::INTEGER AS year, count(*)::INTEGER AS sections, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) AS numbers FROM part GROUP BY 1""")
def acts_round_trip(spark, sf_dir):
    """Acts written as JSON lines and read back as parsed acts."""
    section = F.struct(F.col("p_partkey").cast("string").alias("number"), F.col("p_name").alias("title"), F.col("p_type").alias("content"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", section.alias("s")))), lambda x: x["s"])
    acts = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name")).agg((F.max("p_size") + 1900).cast("int").alias("year"), listed.alias("sections"))
    path = scratch(spark, "acts")
    store.to_documents_json(acts, path)
    read = readers.parsed_acts(spark, path, multi_line=False).where("_corrupt_record IS NULL")
    return read.select("name", "year", F.size("sections").alias("sections"), F.array_join(F.transform("sections", lambda s: s["number"]), ",").alias("numbers"))


@book.query("""SELECT quality AS label, count(*)::BIGINT AS n, 0::BIGINT AS broken FROM labels GROUP BY 1 UNION ALL SELECT NULL, 3, 3""")
def feedback_round_trip(spark, sf_dir):
    """Feedback appended in two parts with broken lines between; those are rows, blank lines are not."""
    path = scratch(spark, "feedback")
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("query"), F.array(F.lit(1.0)).alias("q_vec"), F.array(F.col("doc_id").cast("string")).alias("doc_ids"), F.col("quality").cast("int").alias("label"), F.lit("c").alias("collection"), F.lit("2020").alias("timestamp"), "doc_id")
    store.append_feedback(rows.where("doc_id % 2 = 0").drop("doc_id"), path)
    spark.createDataFrame([("{broken",), ("",), ("no json",), ('{"label": [}',)], "value string").write.mode("append").text(path)
    store.append_feedback(rows.where("doc_id % 2 <> 0").drop("doc_id"), path)
    read = readers.feedback_log(spark, path)
    return read.groupBy("label").agg(F.count("*").alias("n"), F.count("_corrupt_record").alias("broken")).select(F.col("label").cast("long").alias("label"), "n", "broken")


@book.query("SELECT s_suppkey::VARCHAR AS chunk_id, s_name AS text, s_nationkey::VARCHAR AS section_number, (SELECT count(*) FROM supplier)::INTEGER AS total_sections FROM supplier")
def code_round_trip(spark, sf_dir):
    """A code's file, read as chunks with its totals."""
    s = table(spark, sf_dir, "supplier")
    chunk = F.struct(F.col("s_suppkey").cast("string").alias("chunk_id"), F.col("s_name").alias("text"), F.col("s_nationkey").cast("string").alias("section_number"))
    path = scratch(spark, "code")
    total = s.agg(F.count("*").cast("int").alias("total_sections"), F.lit(1).alias("total_chapters"))
    # A file for each nation's suppliers, dealt to parts of bounded length, all read as one folder.
    part = F.floor(F.col("s_suppkey") / 1000)
    codes = s.withColumn("chunk", chunk).groupBy("s_nationkey", part.alias("part")).agg(F.collect_list("chunk").alias("chunks"))
    codes.join(F.broadcast(total)).select("total_sections", "total_chapters", "chunks").write.option("maxRecordsPerFile", 1).json(path)  # total is one row
    return readers.act_chunks(spark, path).select("chunk_id", "text", "section_number", "total_sections")


@book.query("SELECT p_partkey || '. ' || p_name AS entry FROM part")
def entries_round_trip(spark, sf_dir):
    """Entries of many files of a few hundred each, written by the workers and read as one folder."""
    path = scratch(spark, "entries")
    entry = F.struct(F.concat_ws(". ", F.col("p_partkey").cast("string"), "p_name").alias("Articles"))
    listed = table(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / 500).alias("file")).agg(F.to_json(F.collect_list(entry)).alias("value"))
    listed.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return readers.article_entries(spark, path)


def _letters(text: str) -> list[float]:
    """A model that SQL can restate: how often each of eight letters occurs."""
    return [float(text.count(c)) for c in "abcdeirs"]


def _parts(spark, sf_dir) -> tuple[Engine, DataFrame]:
    """An engine that holds a file for each part, in collections by brand, and a query for every 50th part: two words of its name."""
    engine = Engine(spark, scratch(spark, "store"), _letters, 8)
    engine.create("parts")
    p = table(spark, sf_dir, "part")
    engine.link_content("parts", p.select(F.col("p_brand").alias("collection_id"), F.col("p_partkey").cast("string").alias("file_id"), F.col("p_name").alias("text"), F.lit("web").alias("source_type"), F.lower(F.split("p_type", " ")[0]).alias("content_type")))
    asked = p.where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("query_id"), F.array_join(F.slice(F.split("p_name", " "), 1, 2), " ").alias("query"))
    return engine, asked


_HITS = """v AS (SELECT p_partkey, p_brand AS collection_id, p_partkey || '_chunk_1' AS chunk_id, lower(string_split(p_type, ' ')[1]) AS content_type, p_name AS text, list_transform(['a', 'b', 'c', 'd', 'e', 'i', 'r', 's'], lambda c: (length(p_name) - length(replace(p_name, c, '')))::DOUBLE) AS e FROM part),
q AS (SELECT p_partkey AS query_id, array_to_string(string_split(p_name, ' ')[1:2], ' ') AS query FROM part WHERE p_partkey % 50 = 0),
qv AS (SELECT *, list_transform(['a', 'b', 'c', 'd', 'e', 'i', 'r', 's'], lambda c: (length(query) - length(replace(query, c, '')))::DOUBLE) AS e FROM q),
s AS (SELECT query_id, query, v.* EXCLUDE e, round(CASE WHEN list_sum(list_transform(qv.e, lambda x: x * x)) * list_sum(list_transform(v.e, lambda x: x * x)) > 0 THEN list_cosine_similarity(qv.e, v.e) ELSE 0 END, 6) AS score FROM qv, v),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, collection_id, chunk_id) AS rank FROM s QUALIFY rank <= {k})"""


@book.query(f"WITH {_HITS.format(k=10)}, f AS (SELECT * FROM h WHERE content_type IN ('promo', 'standard')) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank)::INTEGER AS rank, collection_id, chunk_id, score FROM f")
def engine_retrieve(spark, sf_dir):
    """Ten hits of each query, of which those of two content types stay."""
    engine, asked = _parts(spark, sf_dir)
    return engine.retrieve("parts", asked, 10, content_type=["promo", "standard"]).select("query_id", "rank", "collection_id", "chunk_id", "score")


@book.query(rf"""WITH {_HITS.format(k=8)},
w AS (SELECT *, list_distinct(list_filter(string_split_regex(lower(query), '\W+'), lambda x: x <> '')) AS qw, string_split_regex(lower(text), '\W+') AS tw FROM h),
o AS (SELECT *, len(list_filter(qw, lambda x: list_contains(tw, x))) / len(qw) AS rr FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rr DESC, rank) AS rr_rank FROM o QUALIFY rr_rank <= 5),
f AS (SELECT *, round(0.45 * score + 0.35 * rr + 0.20 * 0.5, 6) AS final FROM r),
g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, rr_rank) AS final_rank FROM f),
t AS (SELECT * FROM g WHERE final >= 0.4), d AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY query_id, text ORDER BY final_rank) = 1),
a AS (SELECT query_id, arg_min(text, final_rank) AS answer, max(final) AS confidence, count(*) AS n FROM d GROUP BY 1)
SELECT query_id, coalesce(answer, 'Context not found') AS answer, coalesce(confidence, 0) AS confidence, answer IS NOT NULL AS is_relevant, coalesce(n, 0)::BIGINT AS n_chunks FROM q LEFT JOIN a USING (query_id)""")
def engine_query(spark, sf_dir):
    """E5: answers of all queries: retrieval, reranking, blending, threshold, dedupe, response."""
    engine, asked = _parts(spark, sf_dir)
    return engine.query("parts", asked, k=8).select("query_id", "answer", "confidence", "is_relevant", "n_chunks")


@book.query("SELECT p_brand AS collection_id, p_partkey::VARCHAR AS file_id, p_partkey || '_chunk_1' AS chunk_id, p_name AS text FROM part WHERE p_brand <> 'Brand#11' AND p_partkey || '_chunk_1' > '15' ORDER BY chunk_id LIMIT 400")
def engine_chunks(spark, sf_dir):
    """A page of 400 chunks of all collections but one, behind a given chunk."""
    engine, _ = _parts(spark, sf_dir)
    engine.delete_collection("parts", "Brand#11")
    return engine.chunks("parts", 400, after="15").select("collection_id", "file_id", "chunk_id", "text")


@book.query("""SELECT p_brand AS collection_id, p_partkey::VARCHAR AS file_id, CASE WHEN p_size <= 10 THEN 'NOT_FOUND' ELSE 'INDEXED' END AS status, (p_size > 10)::BIGINT AS chunk_count FROM part
UNION ALL SELECT p_brand, '-' || p_partkey, 'NOT_FOUND', 0 FROM part WHERE p_size > 40""")
def engine_files_status(spark, sf_dir):
    """A batch of files, some of whose texts were replaced by blank ones, some never ingested."""
    engine, _ = _parts(spark, sf_dir)
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("collection_id"), F.col("p_partkey").cast("string").alias("file_id"), "p_size")
    engine.link_content("parts", p.where("p_size <= 10").select("collection_id", "file_id", F.lit(" ").alias("text"), F.lit("web").alias("source_type"), F.lit("book").alias("content_type")))
    never = p.where("p_size > 40").select("collection_id", F.concat(F.lit("-"), "file_id").alias("file_id"))
    return engine.files_status("parts", None, p.select("collection_id", "file_id").unionByName(never))


@book.query("""SELECT p_brand AS collection_id, count(*)::BIGINT AS total_files, count(*)::BIGINT AS total_chunks, (SELECT count(*) FROM part WHERE p_brand <> 'Brand#12' AND p_partkey % 25 <> 3)::BIGINT AS documents_in_graph
FROM part WHERE p_brand <> 'Brand#12' AND p_partkey % 25 <> 3 GROUP BY 1""")
def engine_delete(spark, sf_dir):
    """Files of all collections, then one collection, are deleted in the store and in the graph."""
    engine, _ = _parts(spark, sf_dir)
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("collection_id"), F.col("p_partkey").cast("string").alias("file_id"), "p_partkey")
    engine.graph = _library(spark, sf_dir).graph()
    engine.delete_files("parts", None, p.where("p_partkey % 25 = 3"))
    engine.delete_collection("parts", "Brand#12")
    n = engine.graph.scan("Document").agg(F.count("*").alias("documents_in_graph"))
    return engine.status("parts").join(n)  # one row


def _library(spark, sf_dir) -> graphstore.GraphStore:
    """Brands as collections, parts as documents with a chunk and an entity each, written in two batches."""
    written, p = graphstore.GraphStore(spark, scratch(spark, "graph")), table(spark, sf_dir, "part")
    file, none = F.col("p_partkey").cast("string"), F.create_map().cast("map<string,string>")
    node = lambda i, label, props: p.select(i.alias("id"), F.lit(label).alias("label"), props.alias("props")).dropDuplicates(["id"])
    edge = lambda a, b, label: p.select(a.alias("src"), b.alias("dst"), F.lit(label).alias("label"))
    chunk, entity = F.concat(file, F.lit("_chunk_1")), F.concat(file, F.lit("_"), F.col("p_type"))
    owner = F.create_map(F.lit("file_id"), file, F.lit("name"), F.col("p_type"))
    written.merge(p.select(F.col("p_brand").alias("id"), F.lit("Collection").alias("label"), F.lit(None).cast("map<string,string>").alias("props")).dropDuplicates(["id"]), edge(F.col("p_brand"), file, "CONTAINS"))
    documents = node(file, "Document", F.create_map(F.lit("size"), F.col("p_size").cast("string")))
    chunks, entities = p.select(chunk.alias("id"), F.lit("Chunk").alias("label"), none.alias("props")), p.select(entity.alias("id"), F.lit("Type").alias("label"), owner.alias("props"))
    written.merge(documents.unionByName(chunks).unionByName(entities), edge(file, chunk, "HAS_CHUNK").unionByName(edge(chunk, entity, "MENTIONS")))
    return written


@book.query("""SELECT label, count(*)::BIGINT AS n, min(id) AS least, sum(CASE WHEN label = 'Document' THEN size END)::BIGINT AS sizes FROM (
SELECT p_partkey::VARCHAR AS id, 'Document' AS label, CASE WHEN p_partkey % 3 = 1 THEN 1000 ELSE p_size END AS size FROM part WHERE p_brand <> 'Brand#13' AND p_partkey % 10 <> 7
UNION ALL SELECT p_partkey || '_chunk_1', 'Chunk', NULL FROM part WHERE p_brand <> 'Brand#13' AND p_partkey % 10 <> 7
UNION ALL SELECT p_partkey || '_' || p_type, 'Type', NULL FROM part WHERE p_brand <> 'Brand#13' AND p_partkey % 10 <> 7
UNION ALL SELECT DISTINCT p_brand, 'Collection', NULL FROM part WHERE p_brand <> 'Brand#13') GROUP BY 1""")
def graph_store_cascade(spark, sf_dir):
    """W9/W13/W14 over the written graph: properties merged by a later batch, files and a collection deleted with what is theirs, then compacted and read anew."""
    written, p = _library(spark, sf_dir), table(spark, sf_dir, "part")
    larger = p.where("p_partkey % 3 = 1").select(F.col("p_partkey").cast("string").alias("id"), F.lit("Document").alias("label"), F.create_map(F.lit("size"), F.lit("1000")).alias("props"))
    written.merge(larger)
    written.cascade_files(p.where("p_partkey % 10 = 7").select(F.col("p_partkey").cast("string").alias("id")))
    written.cascade_collections(spark.createDataFrame([("Brand#13",)], "id string"))
    written.compact()
    written.vacuum()
    nodes = graphstore.GraphStore(spark, written.root).nodes()
    size = F.when(F.col("label") == "Document", F.try_element_at("props", F.lit("size")).cast("long"))
    return nodes.groupBy("label").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.sum(size).alias("sizes"))


@book.query("""SELECT p_brand AS collection, p_partkey || '_' || p_type AS entity FROM part WHERE p_partkey % 4 <> 2""")
def graph_store_paths(spark, sf_dir):
    """Collection to document to chunk to entity and back, after some documents were deleted with their chunks."""
    written, p = _library(spark, sf_dir), table(spark, sf_dir, "part")
    written.cascade_files(p.where("p_partkey % 4 = 2").select(F.col("p_partkey").cast("string").alias("id")))
    entities = written.nodes(F.col("label") == "Type").select("id")
    chunks = written.neighbours(entities, "MENTIONS", reverse=True)
    files = written.neighbours(chunks.select("id"), "HAS_CHUNK", reverse=True)
    collections = written.neighbours(files.select("id"), "CONTAINS", reverse=True)
    step = lambda rows, a, b: rows.select(F.col("start").alias(a), F.col("id").alias(b))
    return step(chunks, "entity", "chunk").join(step(files, "chunk", "file"), "chunk").join(step(collections, "file", "collection"), "file").select("collection", "entity")


@book.query("SELECT vec_id::VARCHAR AS chunk_id, CASE WHEN vec_id % 7 = 0 THEN 'FAILED' WHEN vec_id % 5 = 0 THEN 'EMPTY' ELSE 'SUCCESS' END AS status FROM embeddings")
def embedding_status(spark, sf_dir):
    """Vectors with a status: no text is EMPTY, a model that keeps failing FAILED; both have the zero vector."""
    text = F.when(F.col("vec_id") % 7 == 0, "boom").when(F.col("vec_id") % 5 == 0, "").otherwise(F.concat(F.lit("text "), F.col("vec_id").cast("string")))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), text.alias("text"))

    def model(text: str):
        if text == "boom":
            raise RuntimeError(text)
        return [float(len(text))] * 8

    return ingest.embed_with_status(rows, model, 8).select("chunk_id", "status")


QUERIES, ORACLE_SQL = book.QUERIES, book.ORACLE_SQL
