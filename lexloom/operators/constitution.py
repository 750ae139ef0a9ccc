"""Constitution text: parts, articles, schedules and references; and statutes without a line layout.

Only match positions come from Arrow batches. Acceptance, cutting, part lookup and the choice among
several candidates of one number are columns and windows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from . import legal

# ---- fixed values: patterns, priorities and limits that decide results ----
ARTICLES = [(2, r"#\s*(\d+[A-Z]*)\.?\s+([^\n#]+?)(?=\n|$)"), (3, r"Article\s+(\d+[A-Z]*)\.\s*([^\n]+?)(?=\n|\.|—)")]
CONTENT = r"#\s*PART\s+I\s*\n.*?#\s*THE\s+UNION"
CONTENT_BEHIND, CONTEXT, LOOK_AHEAD, LEAST_TITLE, HIGHEST = 50_000, 500, 2000, 15, 500
BREAKS = [r"(?i)Article\s+\d+[A-Z]*\.", r"(?i)PART\s+[IVX]+", r"\n\n\n", r"(?i)SCHEDULE"]
REFERENCES = [r"(?i)Article\s+(\d+[A-Z]*)", r"अनुच्छेद\s+(\d+[A-Z]*)"]
ORDINALS = ["FIRST", "SECOND", "THIRD", "FOURTH", "FIFTH", "SIXTH", "SEVENTH", "EIGHTH", "NINTH", "TENTH", "ELEVENTH", "TWELFTH"]
LEAST_PARTS = 20
# ---- end of fixed values ----


def article_candidates(documents: DataFrame) -> DataFrame:
    """(doc_id, pos, priority, number, title, before, after) of everything that looks like an article."""
    patterns = [(p, re.compile(x, re.I | re.M)) for p, x in ARTICLES]
    content = re.compile(CONTENT, re.I | re.S)
    names = ["pos", "priority", "number", "title", "before", "after"]
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, rows = [], []
            for i, text in enumerate(t.as_py() or "" for t in batch["text"]):
                first = content.search(text)
                begin = first.start() if first and first.start() > CONTENT_BEHIND else 0
                for priority, pattern in patterns:
                    for m in pattern.finditer(text, begin):
                        index.append(i)
                        rows.append((m.start(), priority, m[1], m[2].strip(), text[max(0, m.start() - CONTEXT) : m.start()], text[m.end() : m.end() + LOOK_AHEAD]))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)]
            yield pa.record_batch([batch["doc_id"].take(pa.array(index, pa.int64())), *columns], names=["doc_id", *names])

    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, pos int, priority int, number string, title string, before string, after string")


def article_text(number: Column, after: Column) -> Column:
    """The text behind a title up to the next article; of several break marks the first listed that occurs cuts."""
    digits = F.regexp_replace(number, "[A-Z]", "")
    following = F.concat(F.lit(r"(?i)Article\s+"), (F.expr("try_cast(regexp_replace(number, '[A-Z]', '') AS int)") + 1).cast("string"), F.lit(r"(?:\.|[^0-9A-Z])"))
    lettered = F.concat(F.lit(r"(?i)Article\s+"), number, F.lit(r"[A-Z](?:\.|[^A-Z])"))
    marks = [F.when(digits != "", following), F.when(digits != "", lettered), *[F.lit(b) for b in BREAKS]]
    cut = F.coalesce(*[F.when(F.rlike(after, m), F.split(after, m, 2)[0]) for m in marks], after)
    return strip(cut)


def references(text: Column) -> Column:
    """Art-n of articles mentioned, by pattern, then in order, each once."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in REFERENCES])
    return F.array_distinct(F.transform(found, lambda n: F.concat(F.lit("Art-"), n)))


def articles(documents: DataFrame) -> DataFrame:
    """Accepted articles, one per number: the highest priority, then the longest text, then the first."""
    rows = article_candidates(documents)
    n = F.expr("try_cast(regexp_replace(number, '[^0-9]', '') AS int)")
    fine = n.between(1, HIGHEST) & (F.length("title") >= LEAST_TITLE) & ~F.contains(F.substring("title", 1, 10), F.lit("|")) & ~F.contains(F.upper("before"), F.lit("SCHEDULE"))
    rows = rows.where(fine).withColumn("text", article_text(F.col("number"), F.col("after")))
    best = legal.best_articles(rows.select("doc_id", "pos", "priority", "number", "title", "text"))
    digits = F.expr("try_cast(regexp_replace(number, '[^0-9]', '') AS int)")
    return best.select(
        "doc_id", F.concat(F.lit("Art-"), "number").alias("id"), "number", "title", "text", legal.part_of(digits).alias("part"), F.lit("ARTICLE").alias("type"), references(F.col("text")).alias("references"), "pos"
    )


def parts(documents: DataFrame) -> DataFrame:
    """(doc_id, pos, number, title) of the text's parts in order; with fewer than 20 the known table stands in."""
    pieces = F.slice(F.split(F.regexp_replace("text", r"(?i)PART(?=\s+[IVX]+)", "\u0001PART"), "\u0001"), 2, 1 << 30)
    head = r"(?i)^PART\s+([IVX]+)[\s\-–—]*"
    found = F.transform(pieces, lambda p: F.struct(F.regexp_extract(p, head, 1).alias("number"), strip(F.regexp_replace(F.regexp_replace(p, head, ""), r"\s+", " ")).alias("title")))
    known = F.array(*[F.struct(F.lit(n).alias("number"), F.lit(t).alias("title")) for n, t in legal.KNOWN_PARTS])
    chosen = F.when(F.size(found) < LEAST_PARTS, known).otherwise(found)
    return documents.select("doc_id", F.posexplode(chosen).alias("pos", "p")).select("doc_id", "pos", "p.number", "p.title")


def ordinal_schedules(documents: DataFrame) -> DataFrame:
    """(doc_id, pos, id, number, title, text): the longest text of each of the twelve schedules."""
    name = "|".join(ORDINALS)
    mark = rf"(?i)(?:THE\s+)?(?:{name})\s+SCHEDULE\s*(?:\[.*?\])?\s*\n"
    pieces = F.slice(F.split(F.regexp_replace("text", mark, "\u0001$0"), "\u0001"), 2, 1 << 30)
    rows = documents.select("doc_id", F.posexplode(pieces).alias("pos", "piece"))
    which = F.upper(F.regexp_extract("piece", rf"(?i)^(?:THE\s+)?({name})\s+SCHEDULE", 1))
    number = reduce(lambda rest, o: F.when(which == o[1], str(o[0])).otherwise(rest), enumerate(ORDINALS, 1), which)
    body = F.regexp_replace("piece", "^" + mark, "")
    body = strip(F.split(body, rf"\n\n\n|(?i)(?:THE\s+)?(?:{name})\s+SCHEDULE", 2)[0])
    rows = rows.select("doc_id", "pos", number.alias("number"), F.concat(F.initcap(F.lower(which)), F.lit(" Schedule")).alias("title"), body.alias("content"))
    kept = legal.longest_schedules(rows)
    return kept.select("doc_id", "pos", F.concat(F.lit("Schedule-"), "number").alias("id"), "number", "title", F.col("content").alias("text"))


def provisions(documents: DataFrame) -> DataFrame:
    """Articles and schedules of documents as one table of provisions."""
    a = articles(documents).select("doc_id", "id", "number", "title", "text", "part", "type", "references")
    s = ordinal_schedules(documents).select("doc_id", "id", "number", "title", "text", F.lit(None).cast("string").alias("part"), F.lit("SCHEDULE").alias("type"), references(F.col("text")).alias("references"))
    return a.unionByName(s)


def provisions_where(rows: DataFrame, part: str | None = None, provision_id: str | None = None, kind: str | None = None, refers_to: str | None = None, chapter: str | None = None) -> DataFrame:
    """Provisions of a part, a chapter, an id or a type, or those that refer to an id. No criterion keeps all."""
    wanted = {"part": part, "chapter": chapter, "id": provision_id, "type": kind}
    tests = [F.col(c) == v for c, v in wanted.items() if v is not None]
    tests += [F.array_contains("references", refers_to)] if refers_to is not None else []
    return rows.where(reduce(lambda x, y: x & y, tests)) if tests else rows


def fundamental_rights(rows: DataFrame) -> DataFrame:
    """The articles of part III."""
    return provisions_where(rows, part="III", kind="ARTICLE")


def content_sections(part_rows: DataFrame, provision_rows: DataFrame) -> DataFrame:
    """Parts (level 1), then articles, then schedules (level 2) in order, as titled sections."""
    order = F.when(F.col("type") == "ARTICLE", 1).otherwise(2)
    a = part_rows.select("doc_id", F.lit(0).alias("o"), F.col("pos").cast("long").alias("i"), F.lit(1).alias("level"), F.concat(F.lit("Part "), "number", F.lit(": "), "title").alias("title"), F.col("title").alias("text"))
    b = provision_rows.select("doc_id", order.alias("o"), legal.section_order(F.regexp_extract("number", r"^(\d+)", 1)).cast("long").alias("i"), F.lit(2).alias("level"), "title", "text")
    place = Window.partitionBy("doc_id").orderBy("o", "i", "title")
    return a.unionByName(b).withColumn("pos", F.row_number().over(place)).drop("o", "i")


def preprocess(text: Column) -> Column:
    """One kind of line end, no trailing spaces, no runs of blank lines."""
    text = F.regexp_replace(text, r"\r\n?", "\n")
    text = F.regexp_replace(text, r"(?m)[^\S\n]+$", "")
    return F.regexp_replace(F.regexp_replace(text, r"^\n+", ""), r"\n{3,}", "\n\n")


def clean_title(title: Column) -> Column:
    """Without closing stops and dashes, single spaces."""
    return strip(F.regexp_replace(F.regexp_replace(strip(title), r"[.—]+$", ""), r"\s+", " "))


def split_title(text: Column) -> Column:
    """struct(title, content) at the first separator of the list that occurs."""
    out = F.struct(F.lit("").alias("title"), strip(text).alias("content"))
    for s in (r"—", r":", r"\.", r"\.—"):
        halves = F.split(text, s, 2)
        out = F.when(F.size(halves) == 2, F.struct(strip(halves[0]).alias("title"), strip(halves[1]).alias("content"))).otherwise(out)
    return out


def plain_sections(documents: DataFrame) -> DataFrame:
    """(doc_id, pos, number, title, content): sections from ``n. Title`` to the next, in numeric order."""
    clean = documents.select("doc_id", preprocess(F.col("text")).alias("text"))
    pieces = F.slice(F.split(F.regexp_replace("text", r"(?m)^(?=\d+\.\s)", "\u0001"), "\u0001"), 2, 1 << 30)
    rows = clean.select("doc_id", F.posexplode(pieces).alias("pos", "piece"))
    head = r"^(\d+)\.\s+([^—\n]+)"
    body = strip(F.regexp_replace(F.regexp_replace("piece", head + r"(?:—|\.)?", ""), r"(?s)\n\nCHAPTER\s+[IVX]+.*$", ""))
    rows = rows.select("doc_id", "pos", F.regexp_extract("piece", head, 1).alias("number"), clean_title(F.regexp_extract("piece", head, 2)).alias("title"), body.alias("content"))
    return rows.where("number <> ''")


def highest_chapter(pages: DataFrame, first_pages: int = 10) -> DataFrame:
    """(doc_id, chapters): the highest chapter number on the first pages (doc_id, page, text); 0 if none."""
    numbers = F.transform(F.regexp_extract_all("text", F.lit(r"(?i)chapter\s+(\d{1,6})"), F.lit(1)), lambda n: n.cast("int"))
    return pages.where(F.col("page") <= first_pages).groupBy("doc_id").agg(F.coalesce(F.max(F.array_max(numbers)), F.lit(0)).alias("chapters"))


def publish_code(spark: SparkSession, existing: DataFrame, chunks: DataFrame, file_id: str, force: bool = False) -> tuple[DataFrame, bool]:
    """(rows, ingested): chunks replace a code's rows; an existing code is skipped unless forced."""
    if not force and not existing.where(F.col("file_id") == file_id).isEmpty():
        return existing, False
    kept = existing.where(~F.coalesce(F.col("file_id") == file_id, F.lit(False)))
    return kept.unionByName(chunks.withColumn("is_public", F.lit(True)).select(existing.columns)), True
