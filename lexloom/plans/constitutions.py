"""Queries of provisions and unlined statutes, over texts derived from part and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import constitution
from .book import Book, table

book = Book()

_TEXT = "'# ' || (p_partkey % 500 + 1) || '. Right of ' || p_name || ' and more' || chr(10) || 'Body of ' || p_type || ' under Article ' || p_size || ' and article ' || p_size || '. Article ' || (p_size + 1) || chr(10) || '# 7. short' || chr(10)"


@book.query("""WITH a AS (SELECT p_partkey, p_partkey % 500 + 1 AS n, p_name, p_size, 'Body of ' || p_type || ' under' AS body FROM part)
SELECT p_partkey AS doc_id, n::VARCHAR AS number, 'Right of ' || p_name || ' and more' AS title, CASE WHEN p_size = n + 1 THEN body WHEN p_size = n THEN body || ' Article ' || p_size || ' and article ' || p_size || '.' ELSE body || ' Article ' || p_size || ' and' END AS text,
  CASE WHEN p_size = n + 1 THEN '' ELSE 'Art-' || p_size END AS refs FROM a""")
def constitution_articles(spark, sf_dir):
    docs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.expr(_TEXT.replace("chr(10)", "'\\n'")).alias("text"))
    return constitution.articles(docs).select("doc_id", "number", "title", "text", F.array_join("references", "|").alias("refs"))


@book.query("SELECT o_custkey AS doc_id, max(o_orderkey % 90)::INTEGER AS chapters FROM orders WHERE o_orderkey % 12 <= 10 GROUP BY 1")
def highest_chapter(spark, sf_dir):
    text = F.concat(F.lit("x Chapter "), (F.col("o_orderkey") % 90).cast("string"), F.lit(" y chapter 0"))
    return constitution.highest_chapter(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), (F.col("o_orderkey") % 12).alias("page"), text.alias("text")))


@book.query("""SELECT p_partkey AS doc_id, n.n::VARCHAR AS number, CASE n.n WHEN 1 THEN p_name ELSE 'Of ' || p_brand END AS title, CASE n.n WHEN 1 THEN 'Body (1) a' ELSE 'Rest of it' END AS content FROM part, (VALUES (1), (2)) n(n)""")
def plain_sections(spark, sf_dir):
    text = F.concat(F.lit("HEAD\r\n\r\n\r\n1. "), F.col("p_name"), F.lit(".\nBody (1) a\n\nCHAPTER II\nMORE\n2. Of  "), F.col("p_brand"), F.lit(".— \nRest of it  \n"))
    return constitution.plain_sections(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), text.alias("text"))).drop("pos")


QUERIES, ORACLE_SQL = book.QUERIES, book.ORACLE_SQL
