"""Ingest queries: sources, outcomes and the whole plan from documents to stored chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking, graph, ingest, store
from ..sources import readers
from .book import Book, table
from .chunks import _FOLD

book = Book()

_ITEMS = "CASE page_id % 6 WHEN 0 THEN 'web' WHEN 1 THEN 'file' WHEN 2 THEN 'image' WHEN 3 THEN 'youtube' WHEN 4 THEN 'file' ELSE 'tape' END"


@book.query(f"""WITH i AS (SELECT page_id, {_ITEMS} AS t, url FROM pages)
SELECT page_id, CASE t WHEN 'web' THEN 'web' WHEN 'file' THEN CASE WHEN page_id % 6 = 1 THEN 'pdf' END WHEN 'image' THEN 'image' END AS source_type,
  CASE t WHEN 'tape' THEN 'unknown item type' WHEN 'youtube' THEN 'unsupported source' WHEN 'file' THEN CASE WHEN page_id % 6 = 4 THEN 'storage_url is required' END END AS error,
  CASE t WHEN 'web' THEN url WHEN 'youtube' THEN url WHEN 'image' THEN 'local://p+' || page_id || ' a.png' WHEN 'file' THEN CASE WHEN page_id % 6 = 1 THEN 'x/' || page_id || ' b.pdf' END END AS source FROM i""")
def source_resolve(spark, sf_dir):
    n = F.col("page_id").cast("string")
    stored = F.when(F.col("page_id") % 6 == 1, F.concat(F.lit("x/"), n, F.lit("%20b.pdf"))).when(F.col("page_id") % 6 == 2, F.concat(F.lit("local://p+"), n, F.lit("%20a.png")))
    items = table(spark, sf_dir, "pages").select("page_id", F.expr(_ITEMS).alias("item_type"), "url", stored.alias("storage_url"))
    return readers.resolve(items).select("page_id", "source_type", "error", "source")


_PACKED = _FOLD.format(name="d", key="doc_id", size=800, overlap=100, source="(SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN ' ' ELSE text END AS text FROM documents)")


def _documents(spark, sf_dir):
    text = F.when(F.col("doc_id") % 10 == 0, " ").otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select(F.col("source").alias("collection_id"), F.col("doc_id").alias("file_id"), F.lit("web").alias("source_type"), F.col("lang").alias("content_type"), text.alias("text"))


@book.query(f"WITH {_PACKED} SELECT doc_id AS file_id, CASE WHEN len(chunks) > 0 THEN 'SUCCESS' ELSE 'FAILED' END AS status, coalesce(len(chunks), 0)::BIGINT AS chunk_count, CASE WHEN coalesce(len(chunks), 0) = 0 THEN 'no text' END AS error FROM documents LEFT JOIN folded_d USING (doc_id)")
def ingest_outcomes(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    return ingest.outcomes(docs, chunking.chunk_text(docs.select("file_id", "text")))


@book.query(f"WITH {_PACKED} SELECT source AS collection_id, doc_id || '_chunk_' || i AS chunk_id, 'Part ' || i AS section_num, 'Content Part ' || i AS section_title, sha256(chunks[i]) AS text_hash, 'concept' AS chunk_type, 64 AS dim, len(list_filter(string_split_regex(chunks[i], '\\s+'), lambda w: w <> '')) > 0 AS has_vector FROM folded_d JOIN documents USING (doc_id), range(1, len(chunks) + 1) t(i)")
def ingest_chunks(spark, sf_dir):
    chunks = ingest.ingest(_documents(spark, sf_dir), now=F.lit(0))
    has = F.exists("embedding", lambda x: x != 0)
    return chunks.select("collection_id", "chunk_id", "section_num", "section_title", "text_hash", "chunk_type", F.size("embedding").alias("dim"), has.alias("has_vector"))


def _log(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    return line.select(F.col("l_linenumber").alias("chapters"), F.col("l_quantity").cast("int").alias("sections"), F.col("l_suppkey").alias("chunks"), F.when(F.col("l_tax") == 0, F.col("l_returnflag")).alias("error"))


@book.query("""SELECT count_if(l_tax > 0)::BIGINT AS acts, sum(l_linenumber)::BIGINT AS chapters, sum(l_quantity::INTEGER)::BIGINT AS sections, sum(l_suppkey)::BIGINT AS chunks, count_if(l_tax = 0)::BIGINT AS failed, count(DISTINCT l_returnflag) FILTER (l_tax = 0)::BIGINT AS kinds_of_error FROM lineitem""")
def run_totals(spark, sf_dir):
    return ingest.run_totals(_log(spark, sf_dir))


@book.query("SELECT l_returnflag AS error, count(*)::BIGINT AS n FROM lineitem WHERE l_tax = 0 GROUP BY 1")
def run_errors(spark, sf_dir):
    return ingest.run_errors(_log(spark, sf_dir))


@book.query("""WITH c AS (SELECT p_brand AS act, p_type AS number, min(p_partkey) FILTER (p_size > 25) AS with_sections, min(p_partkey) AS first FROM part GROUP BY ALL)
SELECT label, count(*)::BIGINT AS n FROM (SELECT 'Statute' AS label FROM part GROUP BY p_brand UNION ALL SELECT 'Chapter' FROM c UNION ALL SELECT 'Section' FROM (SELECT DISTINCT p_brand, p_size FROM part)
UNION ALL SELECT 'edge HAS_CHAPTER' FROM c UNION ALL SELECT 'edge HAS_SECTION' FROM (SELECT DISTINCT p_brand, p_size FROM part)
UNION ALL SELECT 'edge CONTAINS_SECTION' FROM (SELECT arg_min(p_type, p_partkey) FROM part GROUP BY p_brand, p_size)) GROUP BY 1""")
def statute_graph(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    ordered = lambda s: F.array_sort(F.collect_list(s))
    ids = F.when(F.col("p_size") > 25, F.array(F.col("p_size").cast("string"))).otherwise(F.array().cast("array<string>"))
    chapter = F.struct("p_partkey", F.col("p_type").alias("number"), F.col("p_name").alias("title"), ids.alias("section_numbers"))
    section = F.struct("p_partkey", F.col("p_size").cast("string").alias("number"), F.col("p_name").alias("title"), F.col("p_type").alias("chapter_number"))
    acts = part.groupBy(F.col("p_brand").alias("act_id")).agg(F.min("p_name").alias("name"), F.lit(1950).alias("year"), ordered(chapter).alias("chapters"), ordered(section).alias("sections"))
    g = graph.statute_graph(acts)
    names = g.nodes.select("label").unionByName(g.edges.select(F.concat(F.lit("edge "), "label").alias("label")))
    return names.groupBy("label").agg(F.count("*").alias("n"))


QUERIES, ORACLE_SQL = book.QUERIES, book.ORACLE_SQL
