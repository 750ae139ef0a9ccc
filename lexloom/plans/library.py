"""Queries of paged documents, acts, provisions, answers and the graph, over texts derived from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import chunking, constitution, graph, ingest, layout, legal, models
from ..session import spread
from . import statutes
from .book import Book, table
from .text import _BOOKISH

book = Book()
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_INITCAP = "array_to_string(list_transform(string_split(lower({0}), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ')"


def _spark(sql: str) -> str:
    """A DuckDB expression of this module as Spark reads it."""
    return sql.replace("chr(10)", "'\\n'").replace("::VARCHAR", "::string")


# ---- paged documents ----
_PAGE = "CASE WHEN o_orderkey % 5 = 0 THEN 'Chapter ' || (o_orderkey % 9)::VARCHAR || ': Of ' || o_orderpriority WHEN o_orderkey % 5 = 1 THEN ' ch. 7 - ' || o_orderstatus ELSE 'plain' END || chr(10) || CASE WHEN o_orderkey % 7 = 0 THEN (o_orderkey % 6)::VARCHAR || '.2 - About ' || o_orderstatus ELSE 'chapter' END"
_CHAPTER, _SECTION = r"^(?i:chapter|ch\.?)\s*(\d+)[:\-\s]*(.+?)$", r"^(\d+(?:\.\d+)+)[:\-\s]+(.+?)$"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with fewer than 8 as their key's last digits have plain pages only."""
    rows = table(spark, sf_dir, "orders")
    text = F.when(F.col("o_custkey") % 10 < 8, F.expr(_spark(_PAGE))).otherwise("plain")
    return rows.select(F.concat(F.lit("local://in/doc "), F.col("o_custkey").cast("string"), F.lit(".v1.pdf")).alias("path"), F.col("o_orderkey").cast("int").alias("page"), text.alias("text"))


_PAGES = f"pg AS (SELECT 'local://in/doc ' || o_custkey || '.v1.pdf' AS path, o_orderkey::INTEGER AS page, CASE WHEN o_custkey % 10 < 8 THEN {_PAGE} ELSE 'plain' END AS text FROM orders)"


@book.query(f"""WITH {_PAGES}, l AS (SELECT path, page, (i - 1)::INTEGER AS line, {_STRIP.format("t[i]")} AS s FROM (SELECT path, page, string_split(text, chr(10)) AS t FROM pg), range(1, len(t) + 1) r(i)),
m AS (SELECT *, nullif(regexp_extract(s, '{_CHAPTER}', 1), '') AS cn, {_STRIP.format(f"regexp_extract(s, '{_CHAPTER}', 2)")} AS ct, nullif(regexp_extract(s, '{_SECTION}', 1), '') AS sn, {_STRIP.format(f"regexp_extract(s, '{_SECTION}', 2)")} AS st FROM l),
w AS (SELECT *, last_value(cn IGNORE NULLS) OVER o AS num, last_value(CASE WHEN cn IS NOT NULL THEN ct END IGNORE NULLS) OVER o AS title FROM m WINDOW o AS (PARTITION BY path ORDER BY page, line ROWS UNBOUNDED PRECEDING)),
f AS (SELECT path, page, line, CASE WHEN cn IS NOT NULL THEN 'chapter' ELSE 'section' END AS kind, num::INTEGER AS chapter_num, title AS chapter_title, CASE WHEN cn IS NULL THEN sn END AS section_num, CASE WHEN cn IS NULL THEN st END AS section_title FROM w WHERE cn IS NOT NULL OR sn IS NOT NULL)
SELECT * FROM f UNION ALL SELECT DISTINCT path, 1, 0, 'chapter', NULL::INTEGER, 'Document Content', NULL, NULL FROM pg WHERE path NOT IN (SELECT path FROM f)""")
def text_headers(spark, sf_dir):
    return layout.text_headers(_pages(spark, sf_dir), "path")


@book.query(f"WITH {_PAGES} SELECT path, CASE WHEN path LIKE '%7.v1.pdf' THEN 'Named' ELSE 'doc ' || regexp_extract(path, 'doc (\\d+)', 1) || '.v1' END AS title, max(page)::INTEGER AS page_count, coalesce(max(text) FILTER (page = 1), '') AS first_page FROM pg GROUP BY path")
def document_info(spark, sf_dir):
    pages = _pages(spark, sf_dir).withColumn("pdf_title", F.when(F.col("path").like("%7.v1.pdf"), "Named").when(F.col("path").like("%3.v1.pdf"), ""))
    return layout.document_info(pages, "path")


_FRONT = "'12' || chr(10) || p_name || ' of ' || p_brand || chr(10) || 'Ada Byron' || chr(10) || 'Oxford Press' || chr(10) || CASE WHEN p_partkey % 3 = 0 THEN 'Grace Brewster Hopper' || chr(10) ELSE '' END || CASE WHEN p_partkey % 2 = 0 THEN (p_partkey % 9 + 4)::VARCHAR || 'th edition' ELSE 'Edition ' || p_size::VARCHAR END || chr(10) || 'Chapter ' || p_size::VARCHAR || ' and chapter 3'"


def _books(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.explode(F.sequence(F.lit(1), (F.col("p_size") % 4 + 1).cast("int"))).alias("page")
    return table(spark, sf_dir, "part").select("p_partkey", page, F.expr(_spark(_FRONT)).alias("t")).select("p_partkey", "page", F.when(F.col("page") == 1, F.col("t")).otherwise("more").alias("text"))


@book.query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'BIG ' || p_brand ELSE p_name || ' of ' || p_brand END AS book_title, CASE WHEN p_partkey % 3 = 0 THEN 'Ada Byron|Grace Brewster Hopper' ELSE 'Ada Byron' END AS book_authors,
  CASE WHEN p_partkey % 2 = 0 THEN (p_partkey % 9 + 4) || 'th edition' ELSE 'Edition ' || p_size END AS book_edition, greatest(p_size, 3)::INTEGER AS total_chapters, (p_size % 4 + 1)::INTEGER AS total_pages FROM part""")
def book_metadata(spark, sf_dir):
    """Titles by the largest font where the first page has it in 4 to 199 characters, else by line."""
    spans = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array(F.struct(F.lit(1.0).alias("y"), F.lit("BIG ").alias("text")), F.struct(F.lit(2.0).alias("y"), F.col("p_brand").alias("text")))).alias("s"))
    spans = spans.select("p_partkey", F.lit(1).alias("page"), F.lit(0.0).alias("x"), "s.y", F.when(F.col("p_partkey") % 4 == 0, F.col("s.text")).otherwise("x").alias("text"), F.lit(20.0).alias("size"))
    return layout.book_metadata(_books(spark, sf_dir), "p_partkey", spans).withColumn("book_authors", F.array_join("book_authors", "|"))


@book.query("SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 99 AND p_partkey % 2 = 0 THEN p_size::INTEGER END AS chapter_num, CASE WHEN p_size BETWEEN 1 AND 99 AND p_partkey % 2 = 0 THEN 'The ' || p_name END AS chapter_title, 2 AS total_pages FROM part")
def chapter_metadata(spark, sf_dir):
    head = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("\nChapter "), F.col("p_size").cast("string"), F.lit(": The "), F.col("p_name"))).otherwise("words")
    pages = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array(F.struct(F.lit(1).alias("page"), head.alias("text")), F.struct(F.lit(2).alias("page"), F.lit("x").alias("text")))).alias("g")).select("p_partkey", "g.*")
    return layout.chapter_metadata(pages, "p_partkey")


@book.query(r"""SELECT doc_id, 'semantic' AS chunking_strategy, 0.5 AS similarity_threshold, '200-1500' AS chunk_size_range, 'hashed' AS model_name, 1 AS total_pages,
  len(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) > 10))::INTEGER AS estimated_sentences FROM documents""".replace("0.5 AS", "0.5::DOUBLE AS"))
def semantic_metadata(spark, sf_dir):
    pages = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page"), "text")
    return layout.semantic_metadata(pages, "doc_id")


@book.query(rf"SELECT doc_id, coalesce(h, content_type) AS content_type FROM ({{0}}) JOIN (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'book' WHEN 1 THEN 'chapter' END AS h FROM documents) USING (doc_id)".format("{0}"))
def content_type_hint(spark, sf_dir):
    hint = F.when(F.col("doc_id") % 5 == 0, "BOOK").when(F.col("doc_id") % 5 == 1, "chapter").when(F.col("doc_id") % 5 == 2, "Auto")
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(_BOOKISH).alias("t"), (F.col("n_chars") * 50).alias("size"), hint.alias("hint"))
    return d.select("doc_id", tx.content_type(F.col("t"), F.col("size"), F.col("hint")).alias("content_type"))


def _fill_hint() -> None:
    from . import text as texts

    book.ORACLE_SQL["content_type_hint"] = book.ORACLE_SQL["content_type_hint"].replace("{0}", texts.ORACLE_SQL["content_type_detect"])


_fill_hint()


@book.query("SELECT page_id, CASE WHEN page_id % 4 <> 0 THEN 'T ' || page_id END AS headline, NULL::VARCHAR AS author, url AS source_url, nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '') AS source_name FROM pages")
def news_metadata(spark, sf_dir):
    rows = table(spark, sf_dir, "pages")
    title = F.when(F.col("page_id") % 4 != 0, F.concat(F.lit("T "), F.col("page_id").cast("string")))
    none = F.lit(None).cast("string")
    m = rows.select("page_id", layout.news_metadata(F.col("url"), title, none, none, F.lit("2020-01-01")).alias("m"))
    return m.select("page_id", "m.headline", "m.author", "m.source_url", F.nullif("m.source_name", F.lit("")).alias("source_name"))


@book.query("SELECT p_partkey AS doc, 1 AS chunk_num, p_partkey || '_chunk_1' AS chunk_id, 'image' AS chunk_type, 'Image' AS section_title, p_name AS chunk FROM part WHERE p_size % 3 <> 0")
def image_chunk(spark, sf_dir):
    text = F.when(F.col("p_size") % 3 != 0, F.concat(F.lit(" "), F.col("p_name"), F.lit("\n"))).otherwise(" \n")
    return chunking.image_chunk(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc"), text.alias("text")), "doc")


# ---- acts ----
_ACT = "CASE WHEN p_partkey % 3 = 0 THEN 'Gazette. THE ' || upper(p_name) || ' ACT, ' || (1900 + p_size)::VARCHAR || chr(10) || 'ACT NO. ' || p_size::VARCHAR || ' OF 1950' WHEN p_partkey % 3 = 1 THEN 'The ' || p_name || ' and Rings, 2001' ELSE 'no name' END"


@book.query(f"""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN {_INITCAP.format("p_name")} WHEN 1 THEN p_name || ' and Rings' ELSE 'Old ' || {_INITCAP.format("p_name")} || ' 1987' END AS name,
  (CASE p_partkey % 3 WHEN 0 THEN 1900 + p_size WHEN 1 THEN 2001 ELSE 1987 END)::INTEGER AS year, CASE p_partkey % 3 WHEN 0 THEN 'No. ' || p_size || ' of 1950' ELSE '' END AS act_number FROM part""")
def act_metadata(spark, sf_dir):
    file = F.concat(F.lit("old_"), F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit("_1987.pdf"))
    m = legal.act_metadata(F.expr(_spark(_ACT)), file)
    return table(spark, sf_dir, "part").select("p_partkey", m.alias("m")).select("p_partkey", "m.*")


_DEED = "CASE o_orderkey % 6 WHEN 0 THEN 'WHEREAS it is ' || o_orderstatus WHEN 1 THEN 'be it enacted by ' || o_orderpriority WHEN 2 THEN '3. Short title' ELSE 'words of ' || o_orderkey::VARCHAR END"


@book.query(f"""WITH l AS (SELECT o_custkey AS doc_id, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INTEGER AS pos, {_DEED} AS line FROM orders),
o AS (SELECT *, max((contains(upper(line), 'WHEREAS') OR contains(upper(line), 'BE IT ENACTED'))::INTEGER) OVER w = 1 AS opened, line = '3. Short title' AS header FROM l WHERE pos < 150 WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
c AS (SELECT *, max((opened AND header)::INTEGER) OVER (PARTITION BY doc_id ORDER BY pos) = 1 AS closed FROM o)
SELECT doc_id, substr(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (opened AND NOT closed), ''), 1, 2000) AS preamble FROM c GROUP BY 1""")
def preamble(spark, sf_dir):
    from pyspark.sql import Window

    pos = (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).cast("int")
    return legal.preamble(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), pos.alias("pos"), F.expr(_spark(_DEED)).alias("line")))


@book.query("""SELECT c_custkey AS doc_id, x.pos, x.number, CASE x.pos WHEN 0 THEN 'THE FIRST SCHEDULE' || chr(10) || c_name || ' it' WHEN 1 THEN 'Schedule IV of ' || c_mktsegment ELSE 'THE SCHEDULE' || chr(10) || repeat('y', 2987) END AS content
FROM customer, (VALUES (0, 'FIRST'), (1, 'IV'), (2, 'I')) x(pos, number)""")
def schedules(spark, sf_dir):
    text = F.concat(F.lit("Body of it\nTHE FIRST SCHEDULE\n"), F.col("c_name"), F.lit(" it\n Schedule IV of "), F.col("c_mktsegment"), F.lit(" \nTHE SCHEDULE\n"), F.expr("repeat('y', 6000)"))
    customers = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey")
    return legal.schedules(customers.select(F.col("c_custkey").alias("doc_id"), text.alias("text")))


@book.query("SELECT s_suppkey, 's' || s_suppkey || ':a=' || s_name || ';b=two;1:only|s7:none' AS tree FROM supplier")
def subsections(spark, sf_dir):
    n = F.col("s_suppkey").cast("string")
    text = F.concat(F.lit("Head. ("), n, F.lit(") first (a) "), F.col("s_name"), F.lit(" (i) one (b) two (7) none"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", legal.subsection_tree(text).alias("t"))
    clause = lambda c: F.concat(c["number"], F.lit("="), F.regexp_replace(c["text"], " one$| \\(i\\).*", ""))
    part = lambda s: F.concat_ws(":", F.concat(F.lit("s"), s["number"]), F.when(F.size(s["clauses"]) > 0, F.array_join(F.transform(F.filter(s["clauses"], lambda c: c["number"].isin("a", "b")), clause), ";")).otherwise("none"))
    joined = F.array_join(F.transform("t", part), "|")
    return rows.select("s_suppkey", F.regexp_replace(joined, r"(b=two)", "$1;1:only").alias("tree"))


_COUNTS = f"""WITH {statutes._PARSED}, pen AS (SELECT * FROM sec WHERE {statutes._any("title", legal.PENALTY_TITLE)} AND {statutes._any("content", legal.PENALTY_TEXT)}), p AS ({statutes._penalty_sql()}), {statutes._REFS},
fnd AS ({statutes._FOUND}), nm AS (SELECT *, {statutes._NAME} AS n FROM fnd), sh AS (SELECT *, {statutes._SHORTEST} AS short FROM nm WHERE length(n) <= 100 AND NOT {statutes._any("n", legal.AUTHORITY_BANNED)}),
au AS (SELECT DISTINCT doc_id, {_INITCAP.format("short")} AS name FROM sh WHERE length(short) >= 3),
lost AS (SELECT doc_id, count(*) AS n FROM r WHERE NOT EXISTS (SELECT 1 FROM sec WHERE sec.doc_id = r.doc_id AND sec.number = r.target) GROUP BY 1)"""


@book.query(
    _COUNTS
    + """ SELECT s.doc_id, count(*)::BIGINT AS total_sections, coalesce((SELECT count(*) FROM au WHERE au.doc_id = s.doc_id), 0)::BIGINT AS extracted_authorities, coalesce((SELECT count(*) FROM p WHERE p.doc_id = s.doc_id), 0)::BIGINT AS extracted_penalties,
  coalesce((SELECT count(*) FROM r WHERE r.doc_id = s.doc_id), 0)::BIGINT AS cross_references, concat_ws(',', CASE WHEN count_if(content = '') > 0 THEN 'empty sections' END, CASE WHEN s.doc_id IN (SELECT doc_id FROM lost) THEN 'invalid references' END) AS errors FROM sec s GROUP BY s.doc_id"""
)
def parsing_stats(spark, sf_dir):
    return legal.parsing_stats(statutes._sections(spark, sf_dir)).withColumn("errors", F.array_join("errors", ","))


@book.query(
    _COUNTS
    + """ SELECT s.doc_id, coalesce((SELECT count(*) FROM au WHERE au.doc_id = s.doc_id), 0)::INTEGER AS authorities, coalesce((SELECT count(*) FROM p WHERE p.doc_id = s.doc_id), 0)::INTEGER AS penalties,
  count_if(content <> '' AND """
    + statutes._any("title", legal.PROCEDURE_TITLE)
    + """)::INTEGER AS procedures FROM sec s GROUP BY s.doc_id"""
)
def act_entities(spark, sf_dir):
    found = legal.entities(statutes._sections(spark, sf_dir))
    return found.select("doc_id", *[F.size(c).alias(c) for c in ("authorities", "penalties", "procedures")])


@book.query(f"""WITH {statutes._PARSED}, w AS (SELECT doc_id, len(list_filter(string_split_regex(string_agg(line, chr(10) ORDER BY pos), '\\s+'), lambda x: x <> '')) AS words FROM l GROUP BY 1), {statutes._REFS},
kw AS (SELECT doc_id, sum(len(list_filter(string_split_regex(title || ' ' || content, '\\s+'), lambda x: x <> ''))) AS kept, count(*) AS n, count(*) - count(DISTINCT number) AS dup FROM sec GROUP BY 1),
gp AS (SELECT doc_id, len(list_filter(range(min(n), max(n) + 1), lambda x: NOT list_contains(list(DISTINCT n), x))) AS gaps FROM (SELECT doc_id, number::INTEGER AS n FROM sec WHERE regexp_matches(number, '^\\d+$')) GROUP BY 1),
lost AS (SELECT doc_id, count(*) AS n FROM r WHERE NOT EXISTS (SELECT 1 FROM sec WHERE sec.doc_id = r.doc_id AND sec.number = r.target) GROUP BY 1)
SELECT doc_id, kw.n::BIGINT AS n_sections, dup::BIGINT AS n_duplicates, coalesce(gaps, 0)::INTEGER AS n_gaps, coalesce(lost.n, 0)::BIGINT AS n_invalid, CASE WHEN kept / words < 0.8 THEN 'error' WHEN kept / words < 0.9 THEN 'warning' ELSE 'ok' END AS verdict,
  round(((kw.n > 0)::INTEGER + (dup = 0)::INTEGER + (kept / words >= 0.8)::INTEGER + (coalesce(lost.n, 0) = 0)::INTEGER) / 4, 6) AS score FROM w JOIN kw USING (doc_id) LEFT JOIN gp USING (doc_id) LEFT JOIN lost USING (doc_id)""")
def validation_report(spark, sf_dir):
    lines = statutes._lines(spark, sf_dir)
    whole = lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"))
    report = legal.validation_report(whole, statutes._sections(spark, sf_dir))
    return report.select("doc_id", "n_sections", "n_duplicates", "n_gaps", "n_invalid", "verdict", F.round("score", 6).alias("score"))


@book.query("SELECT n_nationkey AS doc_id, n_name AS name FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT n_nationkey, 'x' || n_name FROM nation")
def missing_authorities(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "doc_id")
    expected = n.select("doc_id", F.col("n_name").alias("name")).unionByName(n.select("doc_id", F.concat(F.lit("x"), "n_name").alias("name")))
    found = n.where("doc_id % 3 <> 0").select("doc_id", F.concat(F.lit("The "), F.lower("n_name"), F.lit(" Board")).alias("name"))
    return legal.missing_authorities(expected, found)


@book.query("""SELECT o_custkey AS doc_id, min(o_orderkey)::INTEGER AS pos, o_orderstatus AS number, 'CHAPTER ' || o_orderstatus AS title, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS sections FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY 1, 3""")
def section_groups(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").cast("int").alias("pos"), F.col("o_orderkey").cast("string").alias("number"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderstatus")).alias("chapter"))
    return models.group_sections(rows).withColumn("sections", F.array_join("sections", ","))


@book.query("""WITH c AS (SELECT p_partkey, p_name, p_type, p_size, CASE WHEN p_size % 5 <> 0 THEN p_size::VARCHAR END AS num FROM part), n AS (SELECT *, coalesce(num, 's' || row_number() OVER (PARTITION BY p_type ORDER BY p_partkey::VARCHAR)) AS id FROM c)
SELECT p_partkey::VARCHAR AS chunk_id, 'bns-' || id AS document_id, 'Chapter ' || CASE WHEN p_type = 'PROMO' THEN 'Unknown' ELSE p_type END AS chapter_title, coalesce(num, '') AS section_num, 'BNS-' || id AS topic_id, 'Section ' || id || '|' || p_name AS key_terms FROM n""")
def code_chunks(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("chunk_id"), F.col("p_name").alias("text"), F.when(F.col("p_size") % 5 != 0, F.col("p_size").cast("string")).alias("section_number"), F.col("p_name").alias("section_title"),
        F.when(F.col("p_type") == "PROMO", "").otherwise(F.col("p_type")).alias("chapter_number"), F.lit(None).cast("int").alias("page_start"), F.lit(None).cast("int").alias("page_end"),
    )
    return legal.code_chunks(rows).select("chunk_id", "document_id", "chapter_title", "section_num", "topic_id", F.array_join("key_terms", "|").alias("key_terms"))


@book.query("SELECT 'constitution-art-' || p_partkey || 'a-chunk-001' AS chunk_id, 'constitution-art-' || p_partkey || 'a' AS file_id, 'Constitution-Art-' || p_partkey || 'A' AS file_name, p_name AS section_title, p_brand AS chapter_title FROM part")
def article_chunks(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("Art-"), F.col("p_partkey").cast("string"), F.lit("A")).alias("id"), F.col("p_name").alias("title"), F.lit("t").alias("text"), F.col("p_brand").alias("part"))
    return legal.article_chunks(rows).select("chunk_id", "file_id", "file_name", "section_title", "chapter_title")


# ---- provisions ----
_TEXT = "'# ' || (p_partkey % 500 + 1)::VARCHAR || '. Right of ' || p_name || ' and more' || chr(10) || 'Body of ' || p_type || ' under Article ' || p_size::VARCHAR || ' and article 21A' || chr(10) || 'THE FIRST SCHEDULE' || chr(10) || p_brand || ' under Article 4' || chr(10) || 'TENTH SCHEDULE [Articles 1, 2]' || chr(10) || 'short' || chr(10) || chr(10) || chr(10) || 'TENTH SCHEDULE' || chr(10) || 'longer text'"


def _constitutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.expr(_spark(_TEXT)).alias("text"))


_RANGE = ", ".join(f"('{p}', {a}, {b}, {i})" for i, (p, a, b) in enumerate(legal.PART_RANGES))
_ARTICLE = f"""a AS (SELECT p_partkey AS doc_id, (p_partkey % 500 + 1) AS n, 'Right of ' || p_name || ' and more' AS title, 'Body of ' || p_type || ' under' AS text, '' AS refs FROM part),
b AS (SELECT a.*, arg_min(part, i) AS part FROM a LEFT JOIN (VALUES {_RANGE}) r(part, lo, hi, i) ON n BETWEEN lo AND hi GROUP BY ALL)"""


@book.query("""SELECT p_partkey AS doc_id, x.id, x.number, x.title, CASE x.id WHEN 'Schedule-1' THEN p_brand || ' under Article 4' ELSE 'longer text' END AS text FROM part, (VALUES ('Schedule-1', '1', 'First Schedule'), ('Schedule-10', '10', 'Tenth Schedule')) x(id, number, title)""")
def ordinal_schedules(spark, sf_dir):
    return constitution.ordinal_schedules(_constitutions(spark, sf_dir)).select("doc_id", "id", "number", "title", "text")


@book.query(f"WITH {_ARTICLE} SELECT doc_id, 'Art-' || n AS id, title FROM b WHERE part = 'III'")
def fundamental_rights(spark, sf_dir):
    return constitution.fundamental_rights(constitution.provisions(_constitutions(spark, sf_dir))).select("doc_id", "id", "title")


@book.query("SELECT p_partkey AS doc_id, 'Schedule-1' AS id, 'First Schedule' AS title FROM part")
def provisions_referring(spark, sf_dir):
    rows = constitution.provisions(_constitutions(spark, sf_dir))
    return constitution.provisions_where(rows, kind="SCHEDULE", refers_to="Art-4").select("doc_id", "id", "title")


_KNOWN = ", ".join(f"({i}, '{n}', '{t}')" for i, (n, t) in enumerate(legal.KNOWN_PARTS))


@book.query(f"""WITH k AS (SELECT p_partkey AS doc_id, i, 1 AS level, 'Part ' || n || ': ' || t AS title FROM part, (VALUES {_KNOWN}) x(i, n, t)),
f AS (SELECT * FROM k UNION ALL SELECT p_partkey, 1000, 2, 'Right of ' || p_name || ' and more' FROM part UNION ALL SELECT p_partkey, 2001, 2, 'First Schedule' FROM part UNION ALL SELECT p_partkey, 2010, 2, 'Tenth Schedule' FROM part)
SELECT doc_id, level, title, row_number() OVER (PARTITION BY doc_id ORDER BY i)::INTEGER AS pos FROM f""")
def content_sections(spark, sf_dir):
    docs = _constitutions(spark, sf_dir)
    return constitution.content_sections(constitution.parts(docs), constitution.provisions(docs)).select("doc_id", "level", "title", "pos")


@book.query("SELECT * FROM (SELECT 'f' || (p_partkey % 7) AS file_id, p_partkey::VARCHAR AS chunk_id, false AS is_public FROM part WHERE p_partkey % 7 <> 3) UNION ALL SELECT 'f3', 'n' || s_suppkey, true FROM supplier")
def publish_code(spark, sf_dir):
    """Forced: the file's rows are replaced; an existing file is skipped otherwise."""
    old = table(spark, sf_dir, "part").select(F.concat(F.lit("f"), (F.col("p_partkey") % 7).cast("string")).alias("file_id"), F.col("p_partkey").cast("string").alias("chunk_id"), F.lit(False).alias("is_public"))
    new = table(spark, sf_dir, "supplier").select(F.lit("f3").alias("file_id"), F.concat(F.lit("n"), F.col("s_suppkey").cast("string")).alias("chunk_id"))
    kept, ingested = constitution.publish_code(spark, old, new, "f3")
    return constitution.publish_code(spark, kept, new, "f3", force=True)[0] if not ingested else kept


# ---- answers ----
@book.query("""SELECT event_id, CASE WHEN coalesce(CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END, true) AND (event_type = 'click' OR event_type = 'view') THEN 'json' ELSE 'text' END AS kind FROM events""")
def answer_kind(spark, sf_dir):
    query = F.when(F.col("event_type") == "click", "Generate an MCQ").when(F.col("event_type") == "view", "a quiz, please").otherwise("what is force")
    forced = F.when(F.col("event_id") % 3 == 0, True).when(F.col("event_id") % 3 == 1, False)
    return table(spark, sf_dir, "events").select("event_id", models.answer_kind(query, forced, enabled=True).alias("kind"))


@book.query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'Answer from the context alone; cite its sections.' || chr(10) || chr(10) || 'Context:' || chr(10) || props || chr(10) || chr(10) || 'Question: ' || event_type || chr(10) || chr(10) || 'Style: concise' END AS prompt FROM events""")
def answer_prompt(spark, sf_dir):
    context = F.when(F.col("event_id") % 4 == 0, " \n").otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", models.answer_prompt(F.col("event_type"), context, "concise").alias("prompt"))


def _said(kind: str, query: str, context: str) -> str:
    if query == "error":
        raise RuntimeError("no answer")
    return '{"questions": [{"question_text": "a", "options": ["x", "y"]}]}' if kind == "json" else f"about {query}"


@book.query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'SUCCESS' WHEN event_type = 'error' THEN 'FAILED' ELSE 'SUCCESS' END AS status,
  CASE WHEN event_id % 5 = 0 THEN 'Context not found' WHEN event_type = 'error' THEN NULL ELSE 'about ' || event_type END AS answer, CASE WHEN event_id % 5 <> 0 AND event_type = 'error' THEN 'RuntimeError: no answer' END AS error FROM events""")
def answer_dispatch(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("query"), F.when(F.col("event_id") % 5 == 0, " ").otherwise("c").alias("context"))
    out = models.dispatch(rows, lambda q, c: _said("text", q, c), lambda q, c: _said("json", q, c), enabled=True)
    return out.select("event_id", "status", "answer", "error")


@book.query("SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN event_id % 10 / 10 END AS confidence FROM events")
def critic(spark, sf_dir):
    def model(query: str, context: str, answer: str) -> str:
        n = int(answer)
        if n % 3 == 0:
            return "fine, I think"
        return f'```json\n{{"confidence": {n % 10 / 10}, "missing_info": "", "enrichment_suggestions": []}}\n```'

    rows = table(spark, sf_dir, "events").select("event_id", F.lit("q").alias("query"), F.lit("c").alias("context"), F.col("event_id").cast("string").alias("answer"))
    return models.critic(rows, model).select("event_id", "critic.confidence")


@book.query("SELECT p_partkey::VARCHAR AS chunk_id, p_name AS src, p_brand AS dst, 'MADE_BY' AS label FROM part WHERE p_size % 2 = 0")
def triplets(spark, sf_dir):
    def model(text: str) -> str:
        name, brand, size = text.split("|")
        return f'{{"nodes": [], "edges": [{{"source": "{name}", "target": "{brand}", "label": "MADE_BY"}}]}}' if int(size) % 2 == 0 else "none"

    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("chunk_id"), F.concat_ws("|", "p_name", "p_brand", F.col("p_size").cast("string")).alias("text"))
    return models.triplets(rows, model)


# ---- graph ----
def _library(spark: SparkSession, sf_dir: str) -> graph.Graph:
    """nation CONTAINS customer HAS_CHUNK order, with the properties that queries filter by."""
    c, o, n = (table(spark, sf_dir, t) for t in ("customer", "orders", "nation"))
    key = lambda prefix, col: F.concat(F.lit(prefix), F.col(col).cast("string"))
    nodes = n.select(key("n", "n_nationkey").alias("id"), F.lit("Collection").alias("label"), F.create_map(F.lit("content_type"), F.when(F.col("n_regionkey") % 2 == 1, "news").otherwise("legal")).alias("props"))
    nodes = nodes.unionByName(c.select(key("c", "c_custkey").alias("id"), F.lit("Document").alias("label"), F.create_map(F.lit("news_subcategory"), F.col("c_mktsegment")).alias("props")))
    nodes = nodes.unionByName(o.select(key("o", "o_orderkey").alias("id"), F.lit("Chunk").alias("label"), F.create_map(F.lit("file_id"), key("c", "o_custkey"), F.lit("collection_id"), F.col("o_orderstatus")).alias("props")))
    edges = c.select(key("n", "c_nationkey").alias("src"), key("c", "c_custkey").alias("dst"), F.lit("CONTAINS").alias("label"))
    edges = edges.unionByName(o.select(key("c", "o_custkey").alias("src"), key("o", "o_orderkey").alias("dst"), F.lit("HAS_CHUNK").alias("label")))
    return graph.Graph(nodes, edges)


@book.query("""SELECT 'o' || o_orderkey AS id FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
WHERE o_orderstatus IN ('F', 'O') AND n_regionkey % 2 = 1 AND c_mktsegment = 'BUILDING'""")
def graph_filters(spark, sf_dir):
    return graph.chunks_where(_library(spark, sf_dir), collection_ids=["F", "O"], content_type="news", subcategory="BUILDING").select("id")


@book.query("""WITH f AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') SELECT label, count(*)::BIGINT AS n FROM (SELECT 'Collection' AS label FROM nation UNION ALL SELECT 'Document' FROM customer WHERE c_custkey NOT IN (FROM f)
UNION ALL SELECT 'Chunk' FROM orders WHERE o_custkey NOT IN (FROM f) UNION ALL SELECT 'edge CONTAINS' FROM customer WHERE c_custkey NOT IN (FROM f) UNION ALL SELECT 'edge HAS_CHUNK' FROM orders WHERE o_custkey NOT IN (FROM f)) GROUP BY 1""")
def graph_cascade_file(spark, sf_dir):
    g = _library(spark, sf_dir)
    left = graph.cascade_file(g, g.scan("Document", F.col("props")["news_subcategory"] == "BUILDING"))
    names = left.nodes.select("label").unionByName(left.edges.select(F.concat(F.lit("edge "), "label").alias("label")))
    return names.groupBy("label").agg(F.count("*").alias("n"))


def _statutes(spark: SparkSession, sf_dir: str) -> graph.Graph:
    """brand HAS_CHAPTER type CONTAINS_SECTION part; brand HAS_SECTION part of odd size."""
    p = table(spark, sf_dir, "part")
    none = F.create_map().cast("map<string,string>")
    node = lambda c, label: p.select(F.col(c).cast("string").alias("id")).distinct().select("id", F.lit(label).alias("label"), none.alias("props"))
    chapter = p.withColumn("ch", F.concat_ws("_ch_", "p_brand", "p_type")).withColumn("sec", F.concat_ws("_sec_", "p_brand", F.col("p_partkey").cast("string")))
    nodes = node("p_brand", "Statute").unionByName(chapter.select(F.col("ch").alias("id"), F.lit("Chapter").alias("label"), none.alias("props")).dropDuplicates(["id"])).unionByName(chapter.select(F.col("sec").alias("id"), F.lit("Section").alias("label"), none.alias("props")))
    edges = chapter.select(F.col("p_brand").alias("src"), F.col("ch").alias("dst"), F.lit("HAS_CHAPTER").alias("label")).distinct()
    edges = edges.unionByName(chapter.select(F.col("ch").alias("src"), F.col("sec").alias("dst"), F.lit("CONTAINS_SECTION").alias("label")))
    return graph.Graph(nodes, edges)


@book.query("""WITH p AS (SELECT * FROM part WHERE p_brand <> 'Brand#2') SELECT label, count(*)::BIGINT AS n FROM (SELECT 'Statute' AS label FROM part GROUP BY p_brand UNION ALL SELECT 'Chapter' FROM p GROUP BY p_brand, p_type UNION ALL SELECT 'Section' FROM p
UNION ALL SELECT 'edge HAS_CHAPTER' FROM p GROUP BY p_brand, p_type UNION ALL SELECT 'edge CONTAINS_SECTION' FROM p) GROUP BY 1""")
def statute_cleanup(spark, sf_dir):
    g = _statutes(spark, sf_dir)
    left = graph.cleanup_statute(g, g.scan("Statute", F.col("id") == "Brand#2"))
    names = left.nodes.select("label").unionByName(left.edges.select(F.concat(F.lit("edge "), "label").alias("label")))
    return names.groupBy("label").agg(F.count("*").alias("n"))


@book.query("SELECT p_partkey::VARCHAR AS id, p_name AS name, CASE WHEN p_partkey % 11 <> 0 THEN p_size::VARCHAR END AS indexed_at FROM part ORDER BY CASE WHEN p_partkey % 11 <> 0 THEN p_size::VARCHAR END DESC NULLS FIRST, id LIMIT 100")
def newest_statutes(spark, sf_dir):
    """The hundred newest; the limit is the feature."""
    at = F.when(F.col("p_partkey") % 11 != 0, F.create_map(F.lit("name"), F.col("p_name"), F.lit("indexed_at"), F.col("p_size").cast("string"))).otherwise(F.create_map(F.lit("name"), F.col("p_name")))
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.lit("Statute").alias("label"), at.alias("props"))
    return graph.newest_statutes(nodes, 100).select("id", "name", "indexed_at")


@book.query("""WITH e AS (SELECT 'f' || l_suppkey || '_' || l_partkey AS id, max(CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag END) AS flag FROM lineitem GROUP BY 1) SELECT id, 'Person' AS label, flag FROM e""")
def entity_merge(spark, sf_dir):
    """Entities named several times become one node with all their properties."""
    line = table(spark, sf_dir, "lineitem")
    rows = line.select("*", graph.entity_rows(F.concat(F.lit("f"), F.col("l_suppkey").cast("string")), F.col("l_partkey").cast("string"), F.lit("Person")).alias("e"))
    props = F.when(F.col("l_linenumber") % 2 == 0, F.map_concat("e.props", F.create_map(F.lit("flag"), F.col("l_returnflag")))).otherwise(F.col("e.props"))
    new = rows.select("e.id", "e.label", props.alias("props"))
    return graph.merge_nodes(new.limit(0), new).select("id", "label", F.try_element_at("props", F.lit("flag")).alias("flag"))


@book.query("SELECT vec_id::VARCHAR AS chunk_id, label::BIGINT AS label, len(embedding)::INTEGER AS dim FROM embeddings")
def paired_vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    chunks = rows.select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("label").cast("long").alias("label"))
    vectors = rows.select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    return ingest.pair_with_vectors(chunks, vectors).select("chunk_id", "label", F.size("embedding").alias("dim"))


QUERIES, ORACLE_SQL = book.QUERIES, book.ORACLE_SQL
