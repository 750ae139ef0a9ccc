"""Paged documents: spans by a plugged-in extractor, headers, first pages, and what each chunking strategy reports."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from . import chunking, constitution, media

SPANS = "path string, page int, x double, y double, text string, size double, flags int, font string, error string"
# The text patterns of headers and the header of documents without one.
CHAPTER_LINE, SECTION_LINE = r"^(?i)(?:chapter|ch\.?)\s*(\d+)[:\-\s]*(.+?)$", r"^(\d+(?:\.\d+)+)[:\-\s]+(.+?)$"
DEFAULT_HEADER = "Document Content"


def pdf_spans(files: DataFrame, extract: Callable[[bytes], Iterable[tuple]]) -> DataFrame:
    """Spans of files (path, content) by a plugged-in extractor of (page, x, y, text, size, flags, font).

    A file that the extractor can't read becomes one row with its error. Bold and italic come from flags or the
    font's name.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    rows = [(path, *span, None) for span in extract(content)]
                except Exception as e:  # an unreadable file is a row
                    rows = [(path, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in SPANS.split(", ")]).astype({"page": "Int32", "flags": "Int32"})

    spans = files.select("path", "content").mapInPandas(run, SPANS)
    style = tx.font_flags(F.coalesce("flags", F.lit(0)), F.coalesce("font", F.lit("")))
    return spans.withColumns({"bold": style["bold"], "italic": style["italic"]})


def document_info(pages: DataFrame, by: str, pdf_title: str = "pdf_title") -> DataFrame:
    """(by, title, page_count, first_page): the title, else the file's stem; pages counted; the first page's text.

    ``pages`` has by (a path), page, text and the title, if the file names one.
    """
    stem = F.regexp_replace(tx.file_name(F.col(by)), r"(?<=.)\.[^.]*$", "")
    grouped = pages.groupBy(by).agg(F.max(pdf_title).alias("t"), F.max("page").alias("page_count"), F.max(F.when(F.col("page") == 1, F.col("text"))).alias("first_page"))
    return grouped.select(by, F.coalesce(F.nullif("t", F.lit("")), stem).alias("title"), "page_count", F.coalesce("first_page", F.lit("")).alias("first_page"))


def text_headers(pages: DataFrame, by: str) -> DataFrame:
    """Headers by their text alone: (by, page, line, kind, chapter_num, chapter_title, section_num, section_title).

    A section belongs to the chapter above it. A document without any header has the default one on page 1.
    ``pages`` has by, page (from 1) and text.
    """
    lines = pages.select(by, "page", F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("text", tx.strip(F.col("text")))
    of = lambda p, g: F.nullif(F.regexp_extract("text", p, g), F.lit(""))
    chapter = F.when(of(CHAPTER_LINE, 1).isNotNull(), F.struct(of(CHAPTER_LINE, 1).alias("num"), tx.strip(of(CHAPTER_LINE, 2)).alias("title")))
    marked = lines.withColumns({"c": chapter, "s_num": F.when(chapter.isNull(), of(SECTION_LINE, 1)), "s_title": tx.strip(of(SECTION_LINE, 2))})
    upto = Window.partitionBy(by).orderBy("page", "line").rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("inside", F.last("c", ignorenulls=True).over(upto)).where("c IS NOT NULL OR s_num IS NOT NULL")
    found = marked.select(
        by, "page", "line", F.when(F.col("c").isNotNull(), "chapter").otherwise("section").alias("kind"), F.expr("try_cast(inside.num AS int)").alias("chapter_num"), F.col("inside.title").alias("chapter_title"),
        F.col("s_num").alias("section_num"), F.when(F.col("s_num").isNotNull(), F.col("s_title")).alias("section_title"),
    )
    empty = lambda kind: F.lit(None).cast(kind)
    none = pages.select(by).distinct().join(found.select(by).distinct(), by, "left_anti")
    default = none.select(by, F.lit(1).alias("page"), F.lit(0).alias("line"), F.lit("chapter").alias("kind"), empty("int").alias("chapter_num"), F.lit(DEFAULT_HEADER).alias("chapter_title"), empty("string").alias("section_num"), empty("string").alias("section_title"))
    return found.unionByName(default)


def title_by_font(spans: DataFrame, by: str) -> DataFrame:
    """(by, font_title): the text of the largest size on the first page, if it has 4 to 199 characters."""
    first = spans.where("page = 1")
    size = first.groupBy(by).agg(F.max("size").alias("size"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "text"))), lambda s: s["text"])
    title = tx.strip(F.array_join(ordered, ""))
    return first.join(size, [by, "size"]).groupBy(by).agg(title.alias("t")).select(by, F.when(F.length("t").between(4, 199), F.col("t")).alias("font_title"))


def book_metadata(pages: DataFrame, by: str, spans: DataFrame | None = None) -> DataFrame:
    """(by, book_title, book_authors, book_edition, total_chapters, total_pages) from first pages."""
    first = F.max(F.when(F.col("page") == 1, F.col("text")))
    rows = pages.groupBy(by).agg(first.alias("t"), F.max("page").alias("total_pages"))
    chapters = constitution.highest_chapter(pages.withColumnRenamed(by, "doc_id")).withColumnRenamed("doc_id", by)
    rows = rows.join(chapters, by, "left")
    title = tx.title_line(F.col("t"))
    if spans is not None:
        rows = rows.join(title_by_font(spans, by), by, "left")
        title = F.coalesce("font_title", title)
    return rows.select(by, title.alias("book_title"), F.coalesce(tx.authors(F.col("t")), F.array().cast("array<string>")).alias("book_authors"), tx.edition(F.col("t")).alias("book_edition"), F.nullif(F.coalesce("chapters", F.lit(0)), F.lit(0)).alias("total_chapters"), "total_pages")


def chapter_metadata(pages: DataFrame, by: str) -> DataFrame:
    """(by, chapter_num, chapter_title, total_pages)."""
    rows = pages.groupBy(by).agg(F.max(F.when(F.col("page") == 1, F.col("text"))).alias("t"), F.max("page").alias("total_pages"))
    rows = rows.withColumn("c", tx.chapter_info(F.col("t")))
    return rows.select(by, F.col("c.number").alias("chapter_num"), F.col("c.title").alias("chapter_title"), "total_pages")


def semantic_metadata(pages: DataFrame, by: str, threshold: float = 0.5, least: int = 200, most: int = 1500, model: str = "hashed") -> DataFrame:
    """The semantic strategy's settings with the first page's number of sentences."""
    rows = pages.groupBy(by).agg(F.max(F.when(F.col("page") == 1, F.col("text"))).alias("t"), F.max("page").alias("total_pages"))
    return rows.select(
        by, F.lit("semantic").alias("chunking_strategy"), F.lit(threshold).alias("similarity_threshold"), F.lit(f"{least}-{most}").alias("chunk_size_range"), F.lit(model).alias("model_name"),
        "total_pages", F.size(tx.semantic_sentences(F.coalesce("t", F.lit("")))).alias("estimated_sentences"),
    )


def semantic_documents(sections: DataFrame, document_id: str, embed: Callable = chunking.hashed_embedding, threshold: float = 0.5, least: int = 200, most: int = 1500) -> DataFrame:
    """Header chunks, each split semantically; a section that the splitter leaves nothing of stays one chunk.

    ``sections`` as for chunking.chunk_headers. Ids are those of the header chunk with _semantic_n.
    """
    base = chunking.chunk_headers(sections, document_id).select(document_id, "chunk_id", "section_title", "page_start", F.col("chunk").alias("text"))
    split = chunking.semantic_chunks(base, threshold, least, most, embed).drop("n_sentences")
    whole = base.join(split.select("chunk_id").distinct(), "chunk_id", "left_anti").withColumnRenamed("text", "chunk").withColumn("chunk_num", F.lit(1))
    out = split.unionByName(whole.select(split.columns))
    number = F.col("chunk_num").cast("string")
    return out.withColumns({"base_chunk_id": F.col("chunk_id"), "chunk_id": F.concat("chunk_id", F.lit("_semantic_"), number), "chunk_type": tx.chunk_type(F.col("chunk"))})


def news_metadata(url: Column, title: Column, author: Column, published: Column, crawled: Column) -> Column:
    """struct(headline, author, published_date, source_url, source_name, crawled_date)."""
    return F.struct(title.alias("headline"), author.alias("author"), published.alias("published_date"), url.alias("source_url"), F.when(url.isNotNull(), tx.domain(url)).alias("source_name"), crawled.alias("crawled_date"))


def ocr_needed(pages: DataFrame, by: str) -> DataFrame:
    """(by, needs_ocr) over pages (by, page, text)."""
    return pages.groupBy(by).agg(media.needs_ocr(F.array_join(F.collect_list("text"), ""), F.count("*")).alias("needs_ocr"))
