"""Statute queries. No table holds statutes, so lines of acts are derived from customer, alike in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import legal
from .book import Book, table

book = Book()

#: Line k of acts of 300 lines: chapters every 43 lines, sections every 10, blanks, footnotes, body lines.
_LINE = """CASE WHEN pos % 43 = 0 THEN concat('CHAPTER ', CASE WHEN pos % 86 = 0 THEN 'IV' ELSE 'X' END)
 WHEN pos % 43 = 1 THEN c_mktsegment
 WHEN pos % 10 = 4 THEN concat(cast(pos % 120 AS varchar(9)), '. ', CASE pos % 40 WHEN 4 THEN 'Short title of ' WHEN 14 THEN 'Penalty for ' WHEN 24 THEN 'Definitions in ' ELSE 'Appeal from ' END, c_mktsegment, '.')
 WHEN pos % 11 = 5 THEN ' ' WHEN pos % 13 = 6 THEN concat(cast(pos AS varchar(9)), '. Ins. by Act') WHEN pos % 17 = 3 THEN 'Provided that the fine is paid;  see Section 14 or clause 999A here.'
 WHEN pos % 19 = 7 THEN concat('The Central Board of ', c_mktsegment, ' shall act under section ', cast(pos AS varchar(9)), '. A fine which may extend to rupees 500, or more')
 WHEN pos % 29 = 9 THEN concat('(a) "', c_mktsegment, '" means a part of ', c_name, '; whoever fails shall be punishable with fine of rupees ', cast(pos AS varchar(9)), '.')
 WHEN pos % 31 = 10 THEN concat('1. File within ', cast(pos % 7 + 2 AS varchar(9)), ' days; the form must be signed. The State Pollution Control Board may hear it.')
 WHEN pos % 23 = 8 THEN 'imprisonment for a term which shall not be less than one year but which may extend to two years. The word of the law means any rule; (1) first (2) second'
 ELSE concat('Body  of ', c_name) END"""
_LINES = f"""l AS (SELECT act AS doc_id, pos, {_LINE} AS line FROM (SELECT c_custkey // 300 AS act, (c_custkey % 300)::INTEGER AS pos, c_mktsegment, c_name FROM customer))"""
_SECTION = r"regexp_extract(s, '^(\d+[A-Z]?)\.\s+([A-Z][^\n]+?)\.?\s*$', {0})"
#: N8/N7/J7 in SQL over the lines.
_PARSED = (
    _LINES
    + r""", m AS (SELECT doc_id, pos, line, regexp_replace(line, '^\s+|\s+$', '', 'g') AS s FROM l),
k AS (SELECT *, nullif(regexp_extract(s, '^(?i)CHAPTER\s+([IVX]+|\d+)\s*$', 1), '') AS chapter,
  regexp_matches(lower(s), '^\d+\.\s*(?:ins|subs|omitted|added|the words|w\.e\.f)|^\d+\s+of\s+\d{4}') OR regexp_matches(lower(s), '^[1-5]\..*(?:ins\.|subs\.|omitted|added)') AS foot,
  """
    + _SECTION.format(1)
    + " AS num, "
    + _SECTION.format(2)
    + r""" AS title FROM m),
h AS (SELECT *, CASE WHEN chapter IS NULL AND num <> '' AND NOT foot THEN num END AS header FROM k),
cs AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n, count(*) OVER (PARTITION BY doc_id) AS c FROM h WHERE chapter IS NOT NULL),
st AS (SELECT doc_id, pos AS start FROM cs WHERE n = least(2, c)),
b AS (SELECT h.* FROM h JOIN st USING (doc_id) WHERE pos >= start),
a AS (SELECT *, header IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, header ORDER BY pos) = 1 AS accepted FROM b),
i AS (SELECT *, sum((chapter IS NOT NULL OR accepted)::INTEGER) OVER w AS island, last_value(chapter IGNORE NULLS) OVER w AS cur FROM a WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
sec AS (SELECT doc_id, island, min(pos) AS pos, max(header) FILTER (accepted) AS number, max(title) FILTER (accepted) AS title, coalesce(min(cur), '') AS chapter_number,
  substr(regexp_replace(regexp_replace(regexp_replace(coalesce(string_agg(CASE WHEN s = '' THEN '' ELSE line END, chr(10) ORDER BY pos) FILTER (chapter IS NULL AND header IS NULL AND NOT foot), ''), '\n\s*\n\s*\n+', chr(10) || chr(10), 'g'), ' +', ' ', 'g'), '^\s+|\s+$', '', 'g'), 1, 5000) AS content
  FROM i GROUP BY doc_id, island HAVING bool_or(accepted))"""
)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / 300).alias("doc_id"), (F.col("c_custkey") % 300).cast("int").alias("pos"), "c_mktsegment", "c_name")
    return c.select("doc_id", "pos", F.expr(_LINE).alias("line"))


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legal.chapters_and_sections(_lines(spark, sf_dir))[1]


@book.query(f"WITH {_PARSED} SELECT doc_id, pos, number, title, content, chapter_number, contains(content, 'Provided that') AS has_proviso FROM sec")
def line_sections(spark, sf_dir):
    return _sections(spark, sf_dir).select("doc_id", "pos", "number", "title", "content", "chapter_number", "has_proviso")


@book.query(
    f"WITH {_PARSED}"
    + r""", t AS (SELECT doc_id, pos, chapter, lead(s, 1) OVER w AS s1 FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
x AS (SELECT doc_id, cur_pos, string_agg(number, ',' ORDER BY pos) AS numbers FROM (SELECT sec.doc_id, sec.number, sec.pos, (SELECT max(b.pos) FROM b WHERE b.doc_id = sec.doc_id AND b.chapter IS NOT NULL AND b.pos < sec.pos) AS cur_pos FROM sec) GROUP BY 1, 2)
SELECT t.doc_id, t.pos, chapter AS number, coalesce(s1, '') AS title, coalesce(numbers, '') AS section_numbers FROM t JOIN st USING (doc_id) LEFT JOIN x ON x.doc_id = t.doc_id AND x.cur_pos = t.pos WHERE chapter IS NOT NULL AND t.pos >= start"""
)
def asof_header(spark, sf_dir):
    chapters, _ = legal.chapters_and_sections(_lines(spark, sf_dir))
    return chapters.select("doc_id", "pos", "number", "title", F.array_join("section_numbers", ",").alias("section_numbers"))


@book.query(f"WITH {_PARSED} SELECT doc_id, start FROM st")
def content_start(spark, sf_dir):
    return legal.content_start(_lines(spark, sf_dir))


@book.query(rf"""WITH {_PARSED}, g AS (SELECT doc_id, min(n) AS lo, max(n) AS hi, list(DISTINCT n) AS got FROM (SELECT doc_id, number::INTEGER AS n FROM sec WHERE regexp_matches(number, '^\d+$')) GROUP BY 1)
SELECT doc_id, array_to_string(list_filter(range(lo, hi + 1), lambda x: NOT list_contains(got, x)), ',') AS missing FROM g""")
def sequence_gaps(spark, sf_dir):
    return legal.sequence_gaps(_sections(spark, sf_dir)).select("doc_id", F.array_join("missing", ",").alias("missing"))


@book.query("""SELECT l_partkey, l_orderkey, n, row_number() OVER (PARTITION BY l_partkey ORDER BY CASE WHEN regexp_matches(n, '^\\d+$') THEN n::INTEGER ELSE 999 END, l_orderkey, l_linenumber)::INTEGER AS place
FROM (SELECT l_partkey, l_orderkey, l_linenumber, CASE WHEN l_quantity > 40 THEN l_linenumber || 'A' ELSE (l_quantity::INTEGER)::VARCHAR END AS n FROM lineitem)""".replace("regexp_matches(n, '^\\d+$') THEN n::INTEGER", "regexp_matches(n, '^\\d+$') THEN try_cast(n AS INTEGER)"))
def section_sort(spark, sf_dir):
    from pyspark.sql import Window

    n = F.when(F.col("l_quantity") > 40, F.concat(F.col("l_linenumber").cast("string"), F.lit("A"))).otherwise(F.col("l_quantity").cast("int").cast("string"))
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", n.alias("n"))
    order = Window.partitionBy("l_partkey").orderBy(legal.section_order(F.col("n")), "l_orderkey", "l_linenumber")
    return rows.select("l_partkey", "l_orderkey", "n", F.row_number().over(order).alias("place"))


_RANGES = ", ".join(f"('{p}', {a}, {b}, {i})" for i, (p, a, b) in enumerate(legal.PART_RANGES))


@book.query(f"""SELECT p_partkey, coalesce(arg_min(part, i), 'XXII') AS part, coalesce(arg_min(part, i), '') AS known FROM part LEFT JOIN (VALUES {_RANGES}) r(part, lo, hi, i) ON p_partkey % 420 BETWEEN lo AND hi GROUP BY 1""")
def range_lookup(spark, sf_dir):
    n = F.col("p_partkey") % 420
    return table(spark, sf_dir, "part").select("p_partkey", legal.part_of(n, "XXII").alias("part"), legal.part_of(n, "").alias("known"))


@book.query("""WITH c AS (SELECT c_nationkey AS doc_id, c_custkey AS number, c_custkey * 10 AS start, c_custkey * 10 + 900 AS stop FROM customer)
SELECT s_nationkey AS doc_id, s_suppkey AS number, s_suppkey * 13 AS pos, (SELECT arg_min(number, start) FROM c WHERE c.doc_id = s_nationkey AND s_suppkey * 13 BETWEEN start AND stop) AS chapter_number FROM supplier""")
def chapter_by_position(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("doc_id"), F.col("c_custkey").alias("number"), (F.col("c_custkey") * 10).alias("start"), (F.col("c_custkey") * 10 + 900).alias("end"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("doc_id"), F.col("s_suppkey").alias("number"), (F.col("s_suppkey") * 13).alias("pos"))
    return legal.chapter_by_position(s, c)


_REF = r"(?i)\b(?:section|sub-section|clause)\s+([A-Z0-9\(\)]+)\b"
_REFS = rf"r AS (SELECT doc_id, number, unnest(regexp_extract_all(content, '{_REF}', 1)) AS target FROM sec)"
#: Places of the matches: the text between them is what is left when each becomes one mark.
_PLACES = rf"""g AS (SELECT doc_id, number, content, regexp_extract_all(content, '{_REF}', 0) AS m, regexp_extract_all(content, '{_REF}', 1) AS t, string_split(regexp_replace(content, '{_REF}', chr(1), 'g'), chr(1)) AS gaps FROM sec),
q AS (SELECT doc_id, number, content, i, t[i] AS target, length(m[i]) AS size, (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::INTEGER AS pos FROM g, range(1, len(m) + 1) r(i))"""


@book.query(f"WITH {_PARSED}, {_PLACES} SELECT doc_id, number, pos, target, substr(content, greatest(pos - 50, 0) + 1, pos + size + 50 - greatest(pos - 50, 0)) AS context FROM q")
def cross_refs(spark, sf_dir):
    return legal.cross_references(_sections(spark, sf_dir)).select("doc_id", "number", "pos", "target", "context")


@book.query(f"WITH {_PARSED}, {_REFS} SELECT doc_id, target, count(*)::BIGINT AS n FROM r WHERE NOT EXISTS (SELECT 1 FROM sec WHERE sec.doc_id = r.doc_id AND sec.number = r.target) GROUP BY ALL")
def invalid_refs_anti(spark, sf_dir):
    sections = _sections(spark, sf_dir)
    return legal.invalid_references(legal.cross_references(sections), sections).groupBy("doc_id", "target").agg(F.count("*").alias("n"))


def _any(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), '{w}')" for w in words) + ")"


def _penalty_sql() -> str:
    """Each pattern's matches with their groups side by side; patterns are shared with the operator."""
    parts = []
    for i, p in enumerate([*legal.IMPRISONMENT, *legal.FINES]):
        group = lambda g: f"unnest(regexp_extract_all(content, '{p}', {g}))"  # noqa: E731, B023
        last = "regexp_replace(v, '^\\s+|\\s+$', '', 'g')"
        least = "regexp_replace(u, '^\\s+|\\s+$', '', 'g')"
        value = f"CASE WHEN u <> '' THEN {least} || ' to ' || {last} ELSE {last} END" if i == 0 else last if i < len(legal.IMPRISONMENT) else f"CASE WHEN {last} = '' THEN 'unspecified' ELSE {last} END"
        kind = "imprisonment" if i < len(legal.IMPRISONMENT) else "fine"
        parts.append(f"SELECT doc_id, number AS section, '{kind}' AS type, {value} AS value, raw, {i} AS pattern FROM (SELECT doc_id, number, {group(0)} AS raw, {group(1)} AS u, {group(2 if i == 0 else 1)} AS v FROM pen)")
    return " UNION ALL ".join(parts)


@book.query(f"""WITH {_PARSED}, pen AS (SELECT * FROM sec WHERE {_any("title", legal.PENALTY_TITLE)} AND {_any("content", legal.PENALTY_TEXT)}), p AS ({_penalty_sql()})
SELECT doc_id, section, type, value, raw, pattern, count(*)::BIGINT AS n FROM p GROUP BY ALL""")
def penalties(spark, sf_dir):
    found = legal.penalties(_sections(spark, sf_dir))
    return found.groupBy("doc_id", "section", "type", "value", "raw", "pattern").agg(F.count("*").alias("n"))


_TRIMMED = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


@book.query(f"""WITH {_PARSED}, f AS (SELECT doc_id, number, content FROM sec WHERE contains(lower(title), 'definition') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos) = 1),
d AS (SELECT doc_id, number AS section, unnest(regexp_extract_all(content, '{legal.FORMAL_DEFINITION}', 1)) AS t, unnest(regexp_extract_all(content, '{legal.FORMAL_DEFINITION}', 2)) AS x, 'formal_definition' AS context FROM f
UNION ALL SELECT doc_id, 'inline', unnest(regexp_extract_all(content, '{legal.INLINE_DEFINITION}', 1)), unnest(regexp_extract_all(content, '{legal.INLINE_DEFINITION}', 2)), 'inline_definition' FROM sec),
e AS (SELECT doc_id, section, context, {_TRIMMED.format("t")} AS term, {_TRIMMED.format("x")} AS definition FROM d)
SELECT doc_id, section, context, term, definition, count(*)::BIGINT AS n FROM e WHERE context = 'formal_definition' OR len(string_split_regex(term, '\\s+')) BETWEEN 3 AND 5 GROUP BY ALL""")
def definitions(spark, sf_dir):
    return legal.definitions(_sections(spark, sf_dir)).groupBy("doc_id", "section", "context", "term", "definition").agg(F.count("*").alias("n"))


_NAME = _TRIMMED.format("regexp_replace(raw, '\\s+', ' ', 'g')")
#: initcap: letters after a space are upper case, all others lower case.
_INITCAP = "array_to_string(list_transform(string_split(lower({0}), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ')"
_SHORTER = r"regexp_replace(regexp_replace(n, '\bPollution Control Board\b', 'Board', 'g'), '\bGovernment\b', 'Govt', 'g')"
_SHORTEST = _TRIMMED.format(rf"regexp_replace(regexp_replace({_SHORTER}, '(?i)\b(?:Under|Section|This|Act|For|The|And|To|Of)\b', '', 'g'), '\s+', ' ', 'g')")
_FOUND = " UNION ALL ".join(f"SELECT doc_id, pos, number, content, {i} AS pattern, i, x[i] AS raw FROM (SELECT *, regexp_extract_all(content, '{p}', 1) AS x FROM sec), range(1, len(x) + 1) r(i)" for i, p in enumerate(legal.AUTHORITIES))
_KIND = "CASE " + " ".join(f"WHEN contains(lower(name), '{t}') THEN '{t}'" for t in legal.AUTHORITY_TYPES) + " ELSE 'other' END"
_PLACE = "CASE WHEN context = '' THEN '' " + " ".join(f"WHEN contains(lower(context), '{j}') THEN '{j.title()}'" for j in legal.JURISDICTIONS) + " ELSE 'Unknown' END"


@book.query(f"""WITH {_PARSED}, fnd AS ({_FOUND}), nm AS (SELECT *, {_NAME} AS n FROM fnd), sh AS (SELECT *, {_SHORTEST} AS short FROM nm WHERE length(n) <= 100 AND NOT {_any("n", ["shall", "may", "improve", "prevent", "control"])}),
au AS (SELECT *, {_INITCAP.format("short")} AS name FROM sh WHERE length(short) >= 3 QUALIFY row_number() OVER (PARTITION BY doc_id, name ORDER BY pos, pattern, i) = 1),
cx AS (SELECT *, coalesce({_TRIMMED.format("list_filter(regexp_split_to_array(content, '[.;]'), lambda s: contains(lower(s), lower(name)))[1]")}, '') AS context FROM au)
SELECT doc_id, name, {_KIND} AS type, number AS section, context, {_PLACE} AS jurisdiction, context <> '' AND {_any("context", ["power", "authority", "may", "shall", "can"])} AS has_powers FROM cx""")
def authorities(spark, sf_dir):
    found = legal.authorities(_sections(spark, sf_dir))
    return found.select("doc_id", "name", "type", "section", "context", "jurisdiction", (F.size("powers") > 0).alias("has_powers"))


@book.query(f"""WITH {_PARSED} SELECT doc_id, number AS section, title AS name, CASE WHEN length(content) > 200 THEN substr(content, 1, 200) || '...' ELSE content END AS description,
  nullif(regexp_extract(content, '{legal.TIMELINE}', 1), '') AS timeline,
  array_to_string(list_transform(regexp_extract_all(content, '{legal.STEPS}', 1)[1:5], lambda x: {_TRIMMED.format("x")}), '|') AS steps,
  array_to_string(list_transform(list_filter(regexp_split_to_array(content, '[.;]'), lambda x: {_any("x", legal.REQUIREMENTS)})[1:3], lambda x: {_TRIMMED.format("x")}), '|') AS requirements FROM sec WHERE content <> '' AND {_any("title", legal.PROCEDURE_TITLE)}""")
def procedures(spark, sf_dir):
    found = legal.procedures(_sections(spark, sf_dir))
    return found.select("doc_id", "section", "name", "description", "timeline", F.array_join("steps", "|").alias("steps"), F.array_join("requirements", "|").alias("requirements"))


@book.query(f"""WITH {_PARSED}, w AS (SELECT doc_id, len(list_filter(string_split_regex(string_agg(line, chr(10) ORDER BY pos), '\\s+'), lambda x: x <> '')) AS words FROM l GROUP BY 1),
kept AS (SELECT doc_id, sum(len(list_filter(string_split_regex(title || ' ' || content, '\\s+'), lambda x: x <> ''))) AS kept FROM sec GROUP BY 1)
SELECT doc_id, words::BIGINT AS words, kept::BIGINT AS kept, round(kept / words, 6) AS ratio, CASE WHEN kept / words < 0.8 THEN 'error' WHEN kept / words < 0.9 THEN 'warning' ELSE 'ok' END AS verdict FROM w JOIN kept USING (doc_id)""")
def content_preservation(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    whole = lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"))
    parts = _sections(spark, sf_dir).select("doc_id", F.concat_ws(" ", "title", "content").alias("text"))
    out = legal.preservation(whole, parts)
    return out.select("doc_id", F.col("words").cast("long").alias("words"), F.col("kept").cast("long").alias("kept"), F.round("ratio", 6).alias("ratio"), "verdict")


@book.query("""WITH a AS (SELECT l_suppkey, list(l_linenumber::VARCHAR) AS n, count(*) AS c, count_if(l_quantity < 20) AS e FROM lineitem GROUP BY 1)
SELECT l_suppkey, CASE WHEN l_suppkey % 5 = 0 THEN 'missing name' ELSE '' END AS errors,
  array_to_string(list_filter([CASE WHEN l_suppkey % 7 = 0 THEN 'unlikely year' END, CASE WHEN e > 0.3 * c THEN 'many empty sections' END, CASE WHEN len(list_distinct(n)) < c THEN 'duplicate section numbers' END], lambda x: x IS NOT NULL), ',') AS warnings FROM a""")
def act_validation(spark, sf_dir):
    content = F.when(F.col("l_quantity") < 20, F.lit(" \n")).otherwise(F.lit("x"))
    acts = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.collect_list(F.col("l_linenumber").cast("string")).alias("n"), F.collect_list(content).alias("c"))
    name = F.when(F.col("l_suppkey") % 5 == 0, " ").otherwise("Act")
    year = F.when(F.col("l_suppkey") % 7 == 0, 1500).otherwise(1950)
    v = legal.validate_act(name, year, F.col("n"), F.col("c"))
    return acts.select("l_suppkey", v.alias("v")).select("l_suppkey", F.array_join("v.errors", ",").alias("errors"), F.array_join("v.warnings", ",").alias("warnings"))


@book.query(f"WITH {_PARSED} SELECT doc_id || '_sec_' || number AS chunk_id, number AS section_number, chapter_number, sha256(substr('Section ' || number || ': ' || title || chr(10) || chr(10) || content, 1, 4000)) AS text_hash FROM sec WHERE length('Section ' || number || ': ' || title || chr(10) || chr(10) || content) > 20")
def section_chunks(spark, sf_dir):
    return legal.section_chunks(_sections(spark, sf_dir)).select("chunk_id", "section_number", "chapter_number", "text_hash")


@book.query(f"""WITH {_PARSED}, n AS (SELECT doc_id, chapter_number, count(*) AS n, count_if(title <> '') AS t, count_if(regexp_matches(content, '\\(\\d+\\)\\s')) AS d FROM sec GROUP BY 1, 2)
SELECT doc_id, sum(n)::BIGINT AS sections, sum(t)::BIGINT AS titled, sum(d)::BIGINT AS divided, string_agg(chapter_number || '=' || n, ',' ORDER BY chapter_number) AS by_chapter FROM n GROUP BY 1""")
def structure_summary(spark, sf_dir):
    pairs = F.transform(F.map_entries("by_chapter"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return legal.structure_summary(_sections(spark, sf_dir)).select("doc_id", "sections", "titled", "divided", F.array_join(F.array_sort(pairs), ",").alias("by_chapter"))


@book.query("""WITH s AS (SELECT o_custkey AS doc_id, o_orderpriority AS number, o_orderstatus || repeat('x', (o_orderkey % 9)::INTEGER) AS content, o_orderkey AS pos FROM orders)
SELECT doc_id, number, content, pos FROM s QUALIFY row_number() OVER (PARTITION BY doc_id, number ORDER BY length(content) DESC, pos) = 1""")
def longest_schedules(spark, sf_dir):
    content = F.expr("concat(o_orderstatus, repeat('x', cast(o_orderkey % 9 AS int)))")
    return legal.longest_schedules(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderpriority").alias("number"), content.alias("content"), F.col("o_orderkey").alias("pos")))


@book.query("""WITH a AS (SELECT p_partkey, (p_partkey % 420) || CASE WHEN p_partkey % 3 = 0 THEN 'A' ELSE '' END AS n, p_name FROM part)
SELECT p_partkey, n AS number, p_name AS title, 'Art-' || n || CASE WHEN n = '21' THEN '' ELSE '|Art-21' END AS refs FROM a""")
def article_entries(spark, sf_dir):
    n = F.concat((F.col("p_partkey") % 420).cast("string"), F.when(F.col("p_partkey") % 3 == 0, "A").otherwise(""))
    entry = F.concat(n, F.lit(". "), F.col("p_name"), F.lit("\nsee Article "), n, F.lit(" and article 21 and Article 21"))
    rows = table(spark, sf_dir, "part").select("p_partkey", legal.article_entry(entry).alias("a"), legal.article_references(entry).alias("r"))
    return rows.select("p_partkey", "a.number", "a.title", F.array_join("r", "|").alias("refs"))


QUERIES, ORACLE_SQL = book.QUERIES, book.ORACLE_SQL
