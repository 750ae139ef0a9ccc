"""Queries of text scalars, over documents, pages, part and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from .book import Book, table

book = Book()
WORDS = {k: "|".join(w.replace(".", r"\.") for w in v) for k, v in (("ex", tx.EXAMPLE_WORDS), ("qu", tx.QUESTION_WORDS), ("di", tx.DIAGRAM_WORDS))}
STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


@book.query(r"""
SELECT doc_id, (i - 1)::INTEGER AS pos, s[i] AS sentence
FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents), range(1, len(s) + 1) t(i)""")
def sentence_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("pos", "sentence"))


@book.query(r"""
SELECT doc_id, array_to_string(terms, '|') AS terms, len(terms)::INTEGER AS n FROM (
  SELECT doc_id, list_slice(list_filter(all_terms, lambda x, i: list_position(all_terms, x) = i), 1, 10) AS terms FROM (
    SELECT doc_id, list_concat(regexp_extract_all(text, '"([^"]+)"', 1), regexp_extract_all(' ' || substr(text, 2), '([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)', 1)) AS all_terms FROM documents))""")
def key_terms(spark, sf_dir):
    terms = tx.key_terms(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", terms.alias("t")).select("doc_id", F.array_join("t", "|").alias("terms"), F.size("t").alias("n"))


@book.query(r"""
SELECT doc_id, array_to_string(e, '|') AS equations, len(e)::INTEGER AS n FROM (
  SELECT doc_id, list_slice(list_filter(list_transform(list_filter(string_split(text, chr(10)),
    lambda l: regexp_matches(l, '[=+\-*/]\s*[A-Za-z0-9]|[A-Za-z]\s*=') OR regexp_matches(l, '[A-Z][a-z]?\s*=|∑|∫|√|π|α|β|γ|Δ')),
    lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g')), lambda l: length(l) < 100), 1, 5) AS e FROM documents)""")
def equations(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.equations(F.col("text")).alias("e")).select("doc_id", F.array_join("e", "|").alias("equations"), F.size("e").alias("n"))


@book.query(rf"SELECT doc_id, regexp_matches(lower(text), '{WORDS['di']}') AS has_diagram FROM documents")
def diagram_flag(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.has_diagram(F.col("text")).alias("has_diagram"))


_TYPE = rf"CASE WHEN regexp_matches(lower({{0}}), '{WORDS['ex']}') THEN 'example' WHEN regexp_matches(lower({{0}}), '{WORDS['qu']}') THEN 'question' ELSE 'concept' END"


@book.query(f"SELECT doc_id, {_TYPE.format('text')} AS chunk_type FROM documents UNION ALL SELECT -event_id - 1, {_TYPE.format('q')} FROM (SELECT event_id, CASE event_type WHEN 'click' THEN 'Worked Sample 5.1' WHEN 'view' THEN 'Practice Problems' ELSE 'Introduction' END AS q FROM events)")
def chunk_type_header(spark, sf_dir):
    header = F.when(F.col("event_type") == "click", "Worked Sample 5.1").when(F.col("event_type") == "view", "Practice Problems").otherwise("Introduction")
    derived = table(spark, sf_dir, "events").select((-F.col("event_id") - 1).alias("doc_id"), tx.chunk_type(header).alias("chunk_type"))
    return table(spark, sf_dir, "documents").select("doc_id", tx.chunk_type(F.col("text")).alias("chunk_type")).unionByName(derived)


@book.query(r"""
SELECT doc_id, bad, length(regexp_replace(t, '^\s+|\s+$', '', 'g')) > 0 AND (length(t) - length(regexp_replace(t, '[^\pC]|\s', '', 'g'))) / length(t) > 0.8 AS valid
FROM (SELECT doc_id, doc_id % 3 = 0 AS bad, CASE WHEN doc_id % 3 = 0 THEN substr(text, 1, 20) || repeat(chr(1), 1 + (doc_id % 11)::INTEGER) ELSE text END AS t FROM documents)""")
def text_valid(spark, sf_dir):
    bad = F.col("doc_id") % 3 == 0
    t = F.when(bad, F.concat(F.substring("text", 1, 20), F.expr("repeat(chr(1), 1 + cast(doc_id % 11 AS int))"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", bad.alias("bad"), t.alias("t")).select("doc_id", "bad", tx.is_valid(F.col("t")).alias("valid"))


@book.query("SELECT doc_id, sha256(text) AS text_hash, substr(md5('{\"doc_id\":' || doc_id || ',\"source\":\"' || source || '\"}'), 1, 16) AS content_hash FROM documents")
def text_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.text_hash(F.col("text")).alias("text_hash"), tx.content_hash(F.struct("doc_id", "source")).alias("content_hash"))


@book.query(r"""
SELECT p_partkey, concat_ws('_', 'statute', regexp_replace(regexp_replace(regexp_replace(lower(p_name || ' (Act) ' || p_brand), '[^\p{L}\p{N}\s_-]', '', 'g'), '^\s+|\s+$', '', 'g'), '[\s-]+', '_', 'g'), (1950 + p_size)::VARCHAR) AS slug FROM part""")
def slug_ids(spark, sf_dir):
    name = F.concat_ws(" ", "p_name", F.lit("(Act)"), "p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", tx.slug("statute", name, F.col("p_size") + 1950).alias("slug"))


_NAMES = "CASE page_id % 6 WHEN 0 THEN 'local://a/1b4e28ba-2fa1-11d2-883f-0016d3cca427_' || page_id || '.PDF' WHEN 1 THEN 'x/y_' || page_id || '.md' WHEN 2 THEN '/var/.hidden' WHEN 3 THEN page_id || '.tar.json' WHEN 4 THEN 'pic.' || page_id ELSE 'b/c.d/readme' END"


@book.query(rf"""
SELECT page_id, regexp_replace(f, '^[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}_', '') AS plain_name,
  CASE e WHEN '.pdf' THEN 'application/pdf' WHEN '.txt' THEN 'text/plain; charset=utf-8' WHEN '.md' THEN 'text/markdown; charset=utf-8' WHEN '.csv' THEN 'text/csv; charset=utf-8'
  WHEN '.json' THEN 'application/json' WHEN '.xml' THEN 'application/xml' WHEN '.html' THEN 'text/html; charset=utf-8' WHEN '.htm' THEN 'text/html; charset=utf-8' ELSE 'application/octet-stream' END AS mime
FROM (SELECT page_id, f, lower(regexp_extract(f, '[^.](\.[^.]*)$', 1)) AS e FROM (SELECT page_id, list_last(string_split(regexp_replace({_NAMES}, '^local://', ''), '/')) AS f FROM pages))""")
def mime_type(spark, sf_dir):
    path = F.expr(_NAMES)
    return table(spark, sf_dir, "pages").select("page_id", tx.plain_name(path).alias("plain_name"), tx.mime_type(path).alias("mime"))


_SOURCES = "CASE page_id % 7 WHEN 0 THEN url WHEN 1 THEN 'https://youtu.be/abcdefghi' || lpad((page_id % 97)::VARCHAR, 2, '0') WHEN 2 THEN 'a/' || page_id || '.pdf' WHEN 3 THEN 'samvidhan_' || page_id || '.PDF' WHEN 4 THEN 'p.webp' WHEN 5 THEN 'ftp://h/x' ELSE 'https://www.youtube.com/watch?a=1&v=zyxwvutsrq' || (page_id % 10) END"


@book.query(rf"""
SELECT page_id, CASE WHEN s = '' THEN CASE WHEN e = '.pdf' THEN CASE WHEN regexp_matches(lower(x), '{"|".join(tx.CONSTITUTION_WORDS)}') THEN 'constitution' ELSE 'pdf' END WHEN e IN ('.png', '.jpg', '.jpeg', '.webp') THEN 'image' END
  WHEN d IN ('youtube.com', 'www.youtube.com', 'youtu.be', 'm.youtube.com') THEN 'youtube' WHEN s IN ('http', 'https') THEN 'web' END AS source_type,
  coalesce(nullif(regexp_extract(x, 'youtube\.com/watch\?v=([a-zA-Z0-9_-]{{11}})', 1), ''), nullif(regexp_extract(x, 'youtu\.be/([a-zA-Z0-9_-]{{11}})', 1), ''),
    nullif(regexp_extract(x, 'youtube\.com/embed/([a-zA-Z0-9_-]{{11}})', 1), ''), CASE WHEN contains(d, 'youtube.com') THEN nullif(regexp_extract(x, '[?&]v=([^&#]+)', 1), '') END) AS video_id
FROM (SELECT page_id, x, lower(regexp_extract(x, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS s, regexp_extract(x, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS d,
  lower(regexp_extract(list_last(string_split(x, '/')), '[^.](\.[^.]*)$', 1)) AS e FROM (SELECT page_id, {_SOURCES} AS x FROM pages))""")
def source_type_detect(spark, sf_dir):
    source = F.expr(_SOURCES.replace("::VARCHAR", "").replace("(page_id % 97)", "cast(page_id % 97 AS string)").replace("|| (page_id % 10)", "|| cast(page_id % 10 AS string)"))
    return table(spark, sf_dir, "pages").select("page_id", source.alias("x")).select("page_id", tx.source_type(F.col("x")).alias("source_type"), tx.video_id(F.col("x")).alias("video_id"))


@book.query(r"""
SELECT page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS domain, coalesce(nullif(regexp_extract(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '[^./](\.[^./]+)$', 1), ''), '.pdf') AS suffix
FROM (SELECT page_id, url, CASE WHEN page_id % 2 = 0 THEN split_part(split_part(url, '?', 1), '#', 1) || 'f.docx?x=1' ELSE url END AS u FROM pages)""")
def url_domain(spark, sf_dir):
    u = F.when(F.col("page_id") % 2 == 0, F.concat(F.substring_index(F.substring_index("url", "?", 1), "#", 1), F.lit("f.docx?x=1"))).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", tx.domain(F.col("url")).alias("domain"), tx.url_suffix(u).alias("suffix"))


@book.query("""
SELECT event_id, CASE WHEN s >= 3600 THEN printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%02d:%02d', s // 60, s % 60) END AS stamp
FROM (SELECT event_id, floor(value * 37)::INTEGER AS s FROM events)""")
def timestamp_format(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", tx.timestamp(F.col("value") * 37).alias("stamp"))


_QUERY = "CASE event_type WHEN 'click' THEN '  What is force ' || event_id WHEN 'view' THEN 'Show me ' || event_id WHEN 'signup' THEN 'how to sum ' || event_id WHEN 'purchase' THEN 'What does an example do' ELSE 'momentum' END"


@book.query(rf"""
SELECT event_id, CASE {" ".join(f"WHEN regexp_matches(q, '{'|'.join(p)}') THEN '{n}'" for n, p in tx.INTENTS.items())} END AS intent
FROM (SELECT event_id, regexp_replace(lower({_QUERY}), '^\s+|\s+$', '', 'g') AS q FROM events)""")
def intent_classify(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", tx.intent(F.expr(_QUERY)).alias("intent"))


_BOOKISH = "CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN 'Second Edition' || chr(10) || 'Copyright © 2019 University Press ' || text WHEN 2 THEN 'Chapter 7: Waves' || chr(10) || text WHEN 3 THEN '12. Sound' || chr(10) || text ELSE 'see chapter 1, chapter 2 and Chapter 3 ' || text END"
_BOOK_SUM = " + ".join(f"regexp_matches(lower(t), '{p}')::INTEGER" for p in tx.BOOK_SIGNS)


@book.query(rf"""
SELECT doc_id, CASE WHEN size > 5 * 1024 * 1024 OR {_BOOK_SUM} >= 2 OR len(regexp_extract_all(lower(t), 'chapter\s+\d+')) >= 3 THEN 'book'
  WHEN len(list_filter(list_slice(string_split(t, chr(10)), 1, 5), lambda l: regexp_matches(regexp_replace(lower(l), '^\s+|\s+$', '', 'g'), '^chapter\s+\d+|^ch\.?\s*\d+|^\d+\.\s+[a-z]'))) > 0 THEN 'chapter' ELSE 'document' END AS content_type
FROM (SELECT doc_id, {_BOOKISH} AS t, n_chars * 50 AS size FROM documents)""")
def content_type_detect(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(_BOOKISH).alias("t"), (F.col("n_chars") * 50).alias("size"))
    return d.select("doc_id", tx.content_type(F.col("t"), F.col("size")).alias("content_type"))


@book.query(rf"""
SELECT doc_id, nullif(list_filter(list_transform(list_slice(string_split(t, chr(10)), 1, 20), lambda l: CASE
    WHEN regexp_matches(l, '^(?i)(chapter|ch\.?)\s*\d{{1,2}}[:\-\s]*.+$') THEN regexp_extract(l, '(\d+)', 1)
    WHEN regexp_matches(l, '^\d{{1,2}}(\.\s+|[:\-\s]+)[A-Za-z].+$') THEN regexp_extract(l, '^(\d+)', 1) ELSE '' END), lambda x: x <> '')[1], '')::INTEGER AS number
FROM (SELECT doc_id, {_BOOKISH} AS t FROM documents)""")
def chapter_info(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(_BOOKISH).alias("t"))
    return d.select("doc_id", tx.chapter_info(F.col("t"))["number"].alias("number"))


@book.query(r"""
SELECT doc_id, array_to_string(regexp_extract_all(t, '(?i)(?:Article|Art\.|Section|Sec\.)\s+(\d+[A-Z]?(?:\([a-z]\))?)', 1), ',') AS cited,
  coalesce(nullif(regexp_extract(t, '(?i)(\d+(?:st|nd|rd|th)\s+edition)', 1), ''), nullif(regexp_extract(t, '(?i)(edition\s+\d+)', 1), '')) AS edition
FROM (SELECT doc_id, 'Under Section ' || doc_id || 'A(b) and art. ' || (doc_id % 9) || ', ' || (doc_id % 40 + 4) || 'th Edition. ' || text AS t FROM documents)""")
def citations(spark, sf_dir):
    t = F.expr("'Under Section ' || doc_id || 'A(b) and art. ' || (doc_id % 9) || ', ' || (doc_id % 40 + 4) || 'th Edition. ' || text")
    d = table(spark, sf_dir, "documents").select("doc_id", t.alias("t"))
    return d.select("doc_id", F.array_join(tx.statute_citations(F.col("t")), ",").alias("cited"), tx.edition(F.col("t")).alias("edition"))


@book.query("""
SELECT event_id, json_valid(j) AS valid, CASE WHEN json_valid(j) THEN json_extract(j, '$.k')::BIGINT END AS k
FROM (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN left(props, 4) ELSE props END AS j FROM events)""")
def json_valid(spark, sf_dir):
    j = F.when(F.col("event_id") % 4 == 0, F.substring("props", 1, 4)).otherwise(F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```")))
    e = table(spark, sf_dir, "events").select("event_id", tx.strip_fences(j).alias("j"))
    return e.select("event_id", tx.is_json(F.col("j")).alias("valid"), F.get_json_object("j", "$.k").cast("long").alias("k"))


@book.query(rf"""
SELECT event_id, regexp_matches(lower(q), '{"|".join(tx.EDUCATIONAL_JSON)}') AS educational, regexp_matches(lower(q), '{"|".join(tx.EDUCATIONAL_PROMPT)}') AS prompt_educational,
  CASE WHEN regexp_matches(lower(q), 'basic|easy') THEN 'basic' WHEN regexp_matches(lower(q), 'advanced|difficult') THEN 'advanced' ELSE 'intermediate' END AS difficulty
FROM (SELECT event_id, CASE event_type WHEN 'click' THEN 'Create a BASIC worksheet' WHEN 'view' THEN 'advanced MCQ on heat' WHEN 'error' THEN 'why is it so' ELSE 'create questions' END AS q FROM events)""")
def educational_query(spark, sf_dir):
    q = F.expr("CASE event_type WHEN 'click' THEN 'Create a BASIC worksheet' WHEN 'view' THEN 'advanced MCQ on heat' WHEN 'error' THEN 'why is it so' ELSE 'create questions' END")
    return table(spark, sf_dir, "events").select("event_id", tx.is_educational(q).alias("educational"), tx.is_educational(q, tx.EDUCATIONAL_PROMPT).alias("prompt_educational"), tx.difficulty(q).alias("difficulty"))


QUERIES, ORACLE_SQL = book.QUERIES, book.ORACLE_SQL
