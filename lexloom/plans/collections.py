"""Collection, graph and analytics queries. documents: source is the collection, doc_id the file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, pages, store
from ..operators.buckets import BucketedTable
from ..session import scratch
from .book import Book, table

book = Book()


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as chunks; every 17th document has no file id."""
    lines = table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return lines.select(
        F.col("source").alias("collection_id"), F.when(F.col("doc_id") % 17 != 0, F.col("doc_id")).alias("file_id"),
        F.concat_ws("_", F.col("doc_id").cast("string"), F.col("pos").cast("string")).alias("chunk_id"), "pos", "text", (F.col("doc_id") % 31 + F.col("pos")).alias("indexed_at"),
    )


_CHUNKS = "c AS (SELECT source AS collection_id, CASE WHEN doc_id % 17 <> 0 THEN doc_id END AS file_id, doc_id || '_' || (i - 1) AS chunk_id, (i - 1)::INTEGER AS pos, l[i] AS text, doc_id % 31 + i - 1 AS indexed_at FROM (SELECT *, string_split(text, chr(10)) AS l FROM documents), range(1, len(l) + 1) t(i))"


@book.query(f"WITH {_CHUNKS} SELECT collection_id, count(DISTINCT file_id)::BIGINT AS total_files, count(*)::BIGINT AS total_chunks FROM c GROUP BY 1")
def collection_status(spark, sf_dir):
    return store.collection_status(_chunks(spark, sf_dir))


@book.query(f"WITH {_CHUNKS} SELECT collection_id, file_id, count(*)::BIGINT AS chunk_count, min(indexed_at)::BIGINT AS indexed_at FROM c WHERE file_id IS NOT NULL GROUP BY 1, 2")
def collection_files(spark, sf_dir):
    return store.collection_files(_chunks(spark, sf_dir))


@book.query(f"""WITH {_CHUNKS}, q AS (SELECT DISTINCT source AS collection_id, unnest([doc_id, doc_id + 1000000]) AS file_id FROM documents)
SELECT q.collection_id, q.file_id, CASE WHEN count(c.chunk_id) > 0 THEN 'INDEXED' ELSE 'NOT_FOUND' END AS status, count(c.chunk_id)::BIGINT AS chunk_count FROM q LEFT JOIN c USING (collection_id, file_id) GROUP BY ALL""")
def file_status(spark, sf_dir):
    wanted = table(spark, sf_dir, "documents").select(F.col("source").alias("collection_id"), F.explode(F.array("doc_id", F.col("doc_id") + 1000000)).alias("file_id")).distinct()
    return store.file_status(wanted, _chunks(spark, sf_dir))


@book.query("""SELECT c_custkey, CASE WHEN n > 0 THEN 'READY' WHEN c_acctbal < 0 THEN 'ERROR' ELSE 'PROCESSING' END AS status
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def unit_status(spark, sf_dir):
    """Customers as units, their orders as chunks; a negative balance is a failure."""
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    units = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").join(n, "c_custkey", "left")
    return units.select("c_custkey", store.unit_status(F.col("n"), F.col("c_acctbal") < 0).alias("status"))


@book.query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey > 1000 AND o_orderpriority IN ('1-URGENT', '2-HIGH') ORDER BY o_orderkey LIMIT 100")
def scroll_page(spark, sf_dir):
    """A keyset page behind order 1000; the page size is the feature."""
    keep = store.equality_filter(o_orderpriority=["1-URGENT", "2-HIGH"], o_orderstatus=None)
    return store.scroll(table(spark, sf_dir, "orders"), "o_orderkey", 100, after=1000, where=keep, columns=["o_orderkey", "o_custkey", "o_totalprice"])


@book.query("SELECT (SELECT count(*) FROM orders)::BIGINT AS total, count(*)::BIGINT AS returned, CASE WHEN max(o_orderkey) < (SELECT max(o_orderkey) FROM orders) THEN max(o_orderkey) END AS next_offset, max(o_orderkey) < (SELECT max(o_orderkey) FROM orders) AS has_more FROM (SELECT o_orderkey FROM orders WHERE o_orderkey > 500 ORDER BY 1 LIMIT 100)")
def scroll_state(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return store.scroll_state(orders, store.scroll(orders, "o_orderkey", 100, after=500), "o_orderkey", 100)


@book.query("""WITH p AS (SELECT l_orderkey, row_number() OVER (ORDER BY l_orderkey) - 1 AS pos, count(*) OVER () AS n FROM lineitem)
SELECT pos // 100 AS page, min(l_orderkey) AS first_key, max(l_orderkey) AS last_key, count(*)::BIGINT AS returned, CASE WHEN max(pos) + 1 < any_value(n) THEN max(pos) + 1 END AS next_offset FROM p GROUP BY 1""")
def scroll_snapshot(spark, sf_dir):
    """Every page of a hundred lines; keys repeat, so a page may end within a key."""
    taken = pages.take(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey", scratch(spark, "scroll"))
    end = F.max("position") + 1
    listed = taken.positions().groupBy(F.floor(F.col("position") / 100).alias("page"))
    return listed.agg(F.min("l_orderkey").alias("first_key"), F.max("l_orderkey").alias("last_key"), F.count("*").alias("returned"), F.when(end < F.lit(taken.total()), end).alias("next_offset"))


@book.query("SELECT p_partkey, p_name FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25 OFFSET 50")
def page_three(spark, sf_dir):
    return store.page_of(table(spark, sf_dir, "part"), [F.desc("p_retailprice"), F.asc("p_partkey")], 3).select("p_partkey", "p_name")


@book.query(f"WITH {_CHUNKS} SELECT collection_id, count(*)::BIGINT AS chunks FROM c WHERE NOT coalesce(file_id % 3 = 0 AND collection_id = 'src0', false) GROUP BY 1")
def delete_file(spark, sf_dir):
    rows = store.delete_where(_chunks(spark, sf_dir), (F.col("file_id") % 3 == 0) & (F.col("collection_id") == "src0"))
    return rows.groupBy("collection_id").agg(F.count("*").alias("chunks"))


@book.query(f"WITH {_CHUNKS} SELECT collection_id, file_id, count(*)::BIGINT AS chunks FROM c WHERE collection_id NOT IN ('src1', 'src2') GROUP BY 1, 2")
def delete_collection(spark, sf_dir):
    rows = store.delete_where(_chunks(spark, sf_dir), store.equality_filter(collection_id=["src1", "src2"]))
    return rows.groupBy("collection_id", "file_id").agg(F.count("*").alias("chunks"))


_UPSERT = f"""WITH {_CHUNKS}, o AS (SELECT chunk_id, pos, CASE WHEN pos % 7 = 3 THEN NULL ELSE sha256(text) END AS text_hash FROM c WHERE pos % 3 <> 2),
n AS (SELECT chunk_id, pos, sha256(CASE WHEN pos % 5 = 0 THEN text || '!' ELSE text END) AS text_hash FROM c WHERE pos % 4 <> 1),
w AS (SELECT n.* FROM n LEFT JOIN o USING (chunk_id) WHERE o.chunk_id IS NULL OR o.text_hash IS NULL OR o.text_hash <> n.text_hash)"""


_UPSERTED = _UPSERT + " SELECT chunk_id, text_hash, true AS written FROM w UNION ALL SELECT chunk_id, text_hash, false FROM o WHERE chunk_id NOT IN (SELECT chunk_id FROM w)"


def _upsert_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = _chunks(spark, sf_dir)
    old = c.where("pos % 3 <> 2").select("chunk_id", "pos", F.when(F.col("pos") % 7 != 3, F.sha2("text", 256)).alias("text_hash"))
    new = c.where("pos % 4 <> 1").select("chunk_id", "pos", F.sha2(F.when(F.col("pos") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("text_hash"))
    return old, new


@book.query(_UPSERTED)
def bucketed_upsert(spark, sf_dir):
    """The same upsert through a stored table: its buckets meet the new rows without an exchange, and those that change are rewritten."""
    old, new = (rows.withColumn("written", F.lit(i == 1)) for i, rows in enumerate(_upsert_sides(spark, sf_dir)))
    stored = BucketedTable.create(spark, scratch(spark, "upserts"), old.schema, ["chunk_id"], buckets=16)
    stored.upsert(old)
    stored.upsert(new)
    return stored.read().select("chunk_id", "text_hash", "written")


@book.query(_UPSERTED)
def hash_upsert(spark, sf_dir):
    old, new = _upsert_sides(spark, sf_dir)
    merged, written = store.hash_upsert(old, new)
    marked = merged.join(written.select("chunk_id", F.lit(True).alias("written")), "chunk_id", "left")
    return marked.select("chunk_id", "text_hash", F.coalesce("written", F.lit(False)).alias("written"))


@book.query("""WITH o AS (SELECT c_custkey AS k, c_acctbal AS v, c_custkey % 9 AS t FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey AS k, c_acctbal + 1 AS v FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(n.k, o.k) AS k, CASE WHEN n.k IS NOT NULL THEN n.v ELSE o.v END AS v, coalesce(o.t, 99)::BIGINT AS created_at, CASE WHEN n.k IS NOT NULL THEN 99 ELSE o.t END::BIGINT AS updated_at FROM o FULL JOIN n ON o.k = n.k""")
def graph_merge(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    t = F.col("c_custkey") % 9
    old = c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), t.alias("created_at"), t.alias("updated_at"))
    new = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), (F.col("c_acctbal") + 1).alias("v"))
    return store.upsert_times(old, new, "k", F.lit(99).cast("long"))


@book.query("SELECT c_custkey, c_mktsegment = 'BUILDING' OR c_custkey % 10 = 0 AS is_public FROM customer")
def public_flag(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", (F.col("c_custkey") % 10 == 0).alias("is_public"))
    return store.set_flag(c, "is_public", F.col("c_mktsegment") == "BUILDING").select("c_custkey", "is_public")


@book.query("""SELECT c_custkey, coalesce(string_agg(k || '=' || v, ',' ORDER BY k), '') AS props FROM (
SELECT c_custkey, k, last(v ORDER BY w) AS v FROM (SELECT c_custkey, 'name' AS k, c_name AS v, 0 AS w FROM customer UNION ALL SELECT c_custkey, 'seg', 'old', 0 FROM customer
UNION ALL SELECT c_custkey, 'seg', c_mktsegment, 1 FROM customer WHERE c_custkey % 2 = 0) GROUP BY 1, 2) GROUP BY 1""")
def map_merge(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    new = F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("seg"), F.col("c_mktsegment")))
    merged = store.merge_properties(F.create_map(F.lit("name"), F.col("c_name"), F.lit("seg"), F.lit("old")), new)
    pairs = F.transform(F.array_sort(F.map_entries(merged)), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return c.select("c_custkey", F.array_join(pairs, ",").alias("props"))


def _star(spark: SparkSession, sf_dir: str) -> graph.Graph:
    """nation CONTAINS customer HAS_CHUNK order; entities are parts that belong to a customer."""
    c, o, p = (table(spark, sf_dir, t) for t in ("customer", "orders", "part"))
    n = table(spark, sf_dir, "nation")
    key = lambda prefix, col: F.concat(F.lit(prefix), F.col(col).cast("string"))
    none = F.create_map().cast("map<string,string>")
    nodes = n.select(key("n", "n_nationkey").alias("id"), F.lit("Collection").alias("label"), none.alias("props"))
    nodes = nodes.unionByName(c.select(key("c", "c_custkey").alias("id"), F.lit("Document").alias("label"), none.alias("props")))
    nodes = nodes.unionByName(o.select(key("o", "o_orderkey").alias("id"), F.lit("Chunk").alias("label"), none.alias("props")))
    owner = F.create_map(F.lit("file_id"), key("c", "p_size"))
    nodes = nodes.unionByName(p.select(key("p", "p_partkey").alias("id"), F.lit("Entity").alias("label"), owner.alias("props")))
    edges = c.select(key("n", "c_nationkey").alias("src"), key("c", "c_custkey").alias("dst"), F.lit("CONTAINS").alias("label"))
    edges = edges.unionByName(o.select(key("c", "o_custkey").alias("src"), key("o", "o_orderkey").alias("dst"), F.lit("HAS_CHUNK").alias("label")))
    return graph.Graph(nodes, edges)


@book.query("SELECT 'o' || o_orderkey AS id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey % 5 = 1)")
def graph_exists_semi(spark, sf_dir):
    g = _star(spark, sf_dir)
    wanted = g.scan("Collection").where(F.substring("id", 2, 9).cast("int") % 5 == 1)
    return graph.chunks_where_collection(g.scan("Chunk"), g.edges, wanted).select("id")


@book.query("""WITH d AS (SELECT c_custkey FROM customer WHERE c_nationkey IN (3, 4)) SELECT label, count(*)::BIGINT AS n FROM (
SELECT 'Collection' AS label FROM nation WHERE n_nationkey NOT IN (3, 4) UNION ALL SELECT 'Document' FROM customer WHERE c_nationkey NOT IN (3, 4)
UNION ALL SELECT 'Chunk' FROM orders WHERE o_custkey NOT IN (FROM d) UNION ALL SELECT 'Entity' FROM part WHERE p_size NOT IN (FROM d)
UNION ALL SELECT 'edge CONTAINS' FROM customer WHERE c_nationkey NOT IN (3, 4) UNION ALL SELECT 'edge HAS_CHUNK' FROM orders WHERE o_custkey NOT IN (FROM d)) GROUP BY 1""")
def graph_cascade_delete(spark, sf_dir):
    g = _star(spark, sf_dir)
    left = graph.cascade_collection(g, g.scan("Collection", F.col("id").isin("n3", "n4")))
    names = left.nodes.select("label").unionByName(left.edges.select(F.concat(F.lit("edge "), "label").alias("label")))
    return names.groupBy("label").agg(F.count("*").alias("n"))


@book.query("SELECT 'p' || l_partkey AS dst, 'o' || l_orderkey AS src, 'MENTIONS' AS label FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size < 10 GROUP BY ALL")
def entity_links(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    chunks = lines.groupBy("l_orderkey").agg(F.collect_list(F.concat(F.lit("p"), F.col("l_partkey").cast("string"))).alias("entity_ids"))
    chunks = chunks.select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("chunk_id"), "entity_ids")
    entities = table(spark, sf_dir, "part").where("p_size < 10").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"))
    return graph.link(chunks, entities)


@book.query("SELECT count(*)::BIGINT AS chunks, count(DISTINCT l_suppkey)::BIGINT AS chapters, count(DISTINCT l_partkey)::BIGINT AS sections FROM lineitem")
def ingest_stats(spark, sf_dir):
    return graph.ingest_stats(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("chapter_number"), F.col("l_partkey").alias("section_number")))


@book.query("""WITH o AS (SELECT DISTINCT lower(p_name) AS other FROM part WHERE p_brand = 'Brand#11' OR p_size > 45)
SELECT p_name AS name, max(p_partkey)::BIGINT AS p_partkey, EXISTS (SELECT 1 FROM o WHERE contains(lower(p.p_name), other) OR contains(other, lower(p.p_name))) AS is_indexed FROM part p GROUP BY ALL""")
def already_indexed(spark, sf_dir):
    """All part names against those of one brand and of large parts."""
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), "p_partkey", "p_brand", "p_size")
    return store.new_and_indexed(p.groupBy("name").agg(F.max("p_partkey").alias("p_partkey")), p.where("p_brand = 'Brand#11' OR p_size > 45"))


@book.query("SELECT o_orderkey, o_orderpriority FROM orders WHERE NOT coalesce(starts_with(o_orderpriority, '4'), false)")
def prefix_cleanup(spark, sf_dir):
    return graph.cleanup_prefix(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "4")


QUERIES, ORACLE_SQL = book.QUERIES, book.ORACLE_SQL
