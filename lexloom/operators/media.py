"""Transcripts, web pages and page layouts: heterogeneous sources to titled sections."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from . import segments, transcript

# Fixed value: seconds after which a transcript segment closes.
SEGMENT_SECONDS = 90.0


@dataclass
class OpenSegment:
    """The one segment of a video that is still growing; batch and stream both feed entries to it.

    Its clock is the sum of its entries' durations. Entries are added until the clock has run for ``limit`` seconds, but the
    entry that opens a segment never closes it; entries without text can't open one.
    """

    start: float = 0.0
    clock: float = 0.0
    parts: list[str] = field(default_factory=list)

    def add(self, start: float, seconds: float | None, text: str | None, limit: float) -> tuple[float, str, int] | None:
        """Take an entry; the segment (start, text, entries) that it completes, if any."""
        opens = not any(self.parts)
        if opens:
            self.start, self.clock, self.parts = start, 0.0, []
        self.clock += seconds or 0.0
        self.parts.append(text or "")
        return self.close() if not opens and self.clock >= limit else None

    def close(self) -> tuple[float, str, int] | None:
        """End the segment; None if it has no text."""
        text, n = " ".join(self.parts).strip(), len(self.parts)
        self.clock, self.parts = 0.0, []
        return (self.start, text, n) if text else None


def transcript_segments(entries: DataFrame, limit: float = SEGMENT_SECONDS) -> DataFrame:
    """(video_id, segment, start, timestamp, section_id, text, n_entries) from (video_id, start, duration, text).

    A segment closes once its durations reach ``limit`` after an entry that isn't its first; empty texts
    open nothing. The clock starts anew, so no window frame expresses it; entries are folded in blocks (see transcript), so that
    a long video is many tasks.
    """
    found = transcript.fold(entries, limit).select("video_id", "segment", "start", "text", "n_entries")
    stamp = tx.timestamp(F.col("start"))
    return found.withColumns({"timestamp": stamp, "section_id": F.concat(F.lit("timestamp_"), stamp)})


class _Page(HTMLParser):
    """Headings and content blocks of a page in order; script and style never count as text."""

    HEADINGS, BLOCKS, HIDDEN = {"h1": 1, "h2": 2, "h3": 3}, {"p", "ul", "ol"}, {"script", "style", "noscript", "template"}
    #: Containers that may hold a page's main content, and those that never do.
    CONTAINERS, ASIDE = {"article", "main", "section", "div", "td", "body"}, {"nav", "footer", "aside", "header", "form"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[tuple[str, list[str]]] = []
        self.open: list[tuple[str, list[str]]] = []
        self.hidden, self.meta, self.code, self.title, self.in_title = 0, {}, False, [], False
        # Containers by number: the open ones, each item's, and the characters of paragraphs (less those of links).
        self.within, self.place, self.weight, self.count, self.link = [("", 0)], {}, {}, 0, 0
        # Line, column and length of the first title's start tag, and where the tag behind its text starts.
        self.title_from, self.title_to = None, None

    def handle_starttag(self, tag, attrs):
        if tag in self.HIDDEN:
            self.hidden += 1
        elif tag == "title":
            self.in_title = True
            self.title_from = self.title_from or (self.getpos(), len(self.get_starttag_text()))
        elif tag == "meta":
            a = dict(attrs)
            if (name := a.get("name") or a.get("property")) and a.get("content"):
                self.meta.setdefault(name, a["content"])
        elif tag in ("code", "pre"):
            self.code = True
        elif tag == "a":
            self.link += 1
        if tag in self.CONTAINERS or tag in self.ASIDE:
            self.count += 1
            self.within.append((tag, self.count))
        if tag in self.HEADINGS or tag in self.BLOCKS:
            if self.open and self.open[-1][0] == "p":  # a block ends an open paragraph
                self.open.pop()
            item = (tag, [])
            self.place[len(self.items)] = tuple(n for _, n in self.within), any(t in self.ASIDE for t, _ in self.within)
            self.items.append(item)
            self.open.append(item)

    def handle_endtag(self, tag):
        if tag in self.HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "title":
            self.in_title = False
            self.title_to = self.title_to or self.getpos()
        elif tag == "a":
            self.link = max(0, self.link - 1)
        elif any(t == tag for t, _ in self.within):
            while self.within.pop()[0] != tag:
                pass
        elif any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.hidden and (text := data.strip()):
            for _, words in self.open:
                words.append(text)
            inner = self.within[-1]
            if self.open and self.open[-1][0] == "p" and not self.link and not any(t in self.ASIDE for t, _ in self.within):
                self.weight[inner[1]] = self.weight.get(inner[1], 0) + len(text)

    def written_title(self, html: str) -> str | None:
        """The first title as the page's source has it, entities and all; null without one that ends."""
        if not self.title_from or not self.title_to or self.title_to < self.title_from[0]:
            return None
        starts = list(accumulate((len(line) + 1 for line in html.split("\n")), initial=0))
        place = lambda at: starts[at[0] - 1] + at[1]
        return html[place(self.title_from[0]) + self.title_from[1] : place(self.title_to)]

    def main_text(self) -> str:
        """The blocks of the container whose own paragraphs hold most characters outside links; of the page without one."""
        best = max(self.weight, key=lambda n: (self.weight[n], -n), default=0)
        parts = [" ".join(words).strip() for i, (_, words) in enumerate(self.items) if best in self.place[i][0] and not self.place[i][1]]
        return "\n".join(p for p in parts if p)


def page_sections(html: str) -> tuple[dict, list[tuple[int, str, str]]]:
    """(metadata, [(level, title, text)]). Text below a heading that a deeper heading follows goes to the deeper one."""
    page = _Page()
    page.feed(html)
    page.close()
    titles: list[str | None] = [None, None, None]
    pending: list[str] = []
    out: list[tuple[int, str, str]] = []

    def save(level: int) -> None:
        nonlocal pending
        if titles[level - 1]:
            if text := "\n".join(pending).strip():
                out.append((level, titles[level - 1], text))
            pending = []
            titles[level - 1] = None

    for tag, words in page.items:
        level = page.HEADINGS.get(tag)
        if level:
            for deeper in range(3, level - 1, -1):
                save(deeper)
            titles[level - 1] = "".join(words)
        elif words:
            pending.append(" ".join(words))
    deepest = next((lv for lv in (3, 2, 1) if titles[lv - 1]), None)
    if deepest:
        save(deepest)
    elif pending:
        out.append((1, "Article Content", "\n".join(pending).strip()))
    meta = {"title": "".join(page.title).strip() or None, "title_source": page.written_title(html), "author": page.meta.get("author"), "publish_date": page.meta.get("article:published_time"), "has_code": page.code, "main_text": page.main_text()}
    return meta, out


def web_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with title, title_source (as written, entities undecoded), author, publish_date, main_text, has_code and
    sections array<struct<level, title, text>>.

    No built-in parses HTML (unclosed tags, entities, scripts), so pages are parsed per Arrow batch.
    """
    from pyspark.sql.types import StructType

    keep = [c for c in pages.columns if c != html]
    section = pa.struct([("level", pa.int32()), ("title", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parsed = [page_sections(h.as_py() or "") for h in batch[html]]
            sections = pa.array([[{"level": lv, "title": t, "text": x} for lv, t, x in s] for _, s in parsed], pa.list_(section))
            texts = [pa.array([m[k] for m, _ in parsed], pa.string()) for k in ("title", "title_source", "author", "publish_date", "main_text")]
            code = pa.array([m["has_code"] for m, _ in parsed], pa.bool_())
            yield pa.record_batch([*(batch[c] for c in keep), *texts, code, sections], names=[*keep, "title", "title_source", "author", "publish_date", "main_text", "has_code", "sections"])

    extra = StructType.fromDDL("title string, title_source string, author string, publish_date string, main_text string, has_code boolean, sections array<struct<level:int,title:string,text:string>>")
    return pages.select(*keep, html).mapInArrow(run, StructType([pages.schema[c] for c in keep] + extra.fields))


def upper_median(rows: DataFrame, by: list[str], value: Column) -> DataFrame:
    """(by.., median): the element at n div 2 of a group's sorted values, the upper one of the two middle ones; nulls don't count.

    Groups are selected from by counts of their distinct values: a group takes as much memory as it has distinct values.
    """
    counts = rows.select(*by, value.alias("_v")).where("_v IS NOT NULL").groupBy(*by, "_v").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(*by).orderBy("_v")
    placed = counts.withColumns({"_upto": F.sum("_n").over(upto), "_all": F.sum("_n").over(Window.partitionBy(*by))})
    return placed.where(F.expr("_upto > _all div 2 AND _upto - _n <= _all div 2")).select(*by, F.col("_v").alias("median"))


def assemble_lines(spans: DataFrame, by: list[str]) -> DataFrame:
    """Spans (by.., page, x, y, text, size, bold, font) of one rounded y (half even) make a line."""
    y = F.bround("y", 0)
    ordered = F.array_sort(F.collect_list(F.struct("x", "text")))
    text = F.array_join(F.transform(ordered, lambda s: s["text"]), " ")
    return spans.groupBy(*by, "page", y.alias("y")).agg(text.alias("text"), F.avg("size").alias("size"), F.bool_or("bold").alias("bold"), F.mode("font", True).alias("font"))


def page_headers(lines: DataFrame, by: list[str]) -> DataFrame:
    """Header lines (kind chapter or section) with the chapter header above each section."""
    marked = lines.join(upper_median(lines, by, F.col("size")), by).withColumn("kind", tx.page_header(F.col("text"), F.col("size"), F.col("bold"), F.col("median")))
    chapter = F.when(F.col("kind") == "chapter", F.col("text"))
    marked = segments.running(marked.withColumn("_block", F.col("page")), by, ["page", "y"], lasts={"chapter": chapter})
    return marked.where("kind IS NOT NULL").drop("median", "_block")


def between_headers(lines: DataFrame, by: list[str], is_header: Column) -> DataFrame:
    """The text from each header to the next: (by.., page, y, header, next_page, text, n_lines)."""
    order = Window.partitionBy(*by).orderBy("page", "y")
    marked = lines.withColumn("_h", F.coalesce(is_header, F.lit(False))).withColumn("_block", F.col("page"))
    marked = segments.running(marked, by, ["page", "y"], {"_island": F.col("_h").cast("int")})
    body = F.when(~F.col("_h"), F.struct("page", "y", "text"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(body)), lambda x: x["text"]), "\n")
    islands = marked.where("_island > 0").groupBy(*by, "_island").agg(
        F.min(F.when(F.col("_h"), F.struct("page", "y", "text"))).alias("h"), text.alias("text"), F.count_if(~F.col("_h")).alias("n_lines")
    )
    heads = islands.select(*by, "h.page", "h.y", F.col("h.text").alias("header"), "text", "n_lines")
    return heads.withColumn("next_page", F.lead("page").over(order))


def needs_ocr(text: Column, pages: Column) -> Column:
    """Fewer than 100 characters a page."""
    return F.length(tx.strip(text)) / F.greatest(pages, F.lit(1)) < 100


def first_usable(candidates: list[Column], least: int = 500) -> Column:
    """The first provider's text of at least ``least`` characters, else the first that isn't empty."""
    long = [F.when(F.length(tx.strip(c)) >= least, c) for c in candidates]
    return F.coalesce(*long, *[F.nullif(c, F.lit("")) for c in candidates])


def join_pages(pages: DataFrame, by: list[str]) -> DataFrame:
    """S3: page texts as one text, each behind ``[Page n]``."""
    ordered = F.array_sort(F.collect_list(F.struct("page", "text")))
    return pages.groupBy(*by).agg(F.array_join(F.transform(ordered, lambda p: F.concat(F.lit("[Page "), p["page"].cast("string"), F.lit("]\n"), p["text"])), "\n\n").alias("text"))


def enrich_questions(rows: DataFrame, response: str = "response", query: str = "query") -> DataFrame:
    """Question JSON with ids, types and metadata as ``enriched``; other responses stay as they are."""
    option = "struct<question_text:string,options:array<string>,correct_answer:string,explanation:string,requires_diagram:boolean,contains_math:boolean,diagram_type:string>"
    parsed = F.from_json(response, f"struct<questions:array<{option}>>")["questions"]
    n_options = lambda q: F.coalesce(F.size(q["options"]), F.lit(0))
    kind = lambda q: F.when(n_options(q) > 2, "multiple_choice").when(n_options(q) == 2, "true_false").otherwise("short_answer")
    question = lambda q, i: F.struct(
        F.concat(F.lit("q"), (i + 1).cast("string")).alias("question_id"),
        F.struct(
            F.coalesce(q["question_text"], F.lit("")).alias("question_text"), kind(q).alias("type"), F.coalesce(q["requires_diagram"], F.lit(False)).alias("requires_diagram"),
            F.coalesce(q["contains_math"], F.lit(False)).alias("contains_math"), F.lit("intermediate").alias("complexity_level"),
        ).alias("question_config"),
        F.struct(F.coalesce(q["options"], F.array().cast("array<string>")).alias("options"), F.coalesce(q["correct_answer"], F.lit("")).alias("correct_answer"), F.coalesce(q["explanation"], F.lit("")).alias("reason"), F.lit(1).alias("max_score")).alias("answer_config"),
        F.struct(F.lit(True).alias("auto_generated_id"), (i + 1).alias("question_number"), F.lit(30).alias("estimated_time")).alias("metadata"),
    )
    types = ["multiple_choice", "true_false", "short_answer"]
    counts = F.struct(*[_count(F.transform(F.col("_q"), kind), t).alias(t) for t in types])
    out = rows.withColumn("_q", F.when(tx.is_json(F.col(response)) & tx.is_educational(F.col(query)), parsed))
    body = F.struct(
        F.concat(F.lit("Educational content generated for: "), F.col(query)).alias("content_text"), F.transform("_q", question).alias("questions"),
        F.struct(F.size("_q").alias("total_questions"), counts.alias("question_types"), tx.difficulty(F.col(query)).alias("difficulty_level"), (F.size("_q") * 2).alias("estimated_reading_time")).alias("metadata"),
    )
    return out.withColumn("enriched", F.when(F.col("_q").isNotNull(), F.to_json(body)).otherwise(F.col(response))).drop("_q")


def _count(kinds: Column, wanted: str) -> Column:
    return F.size(F.filter(kinds, lambda k: k == wanted))


def question_types(rows: DataFrame, response: str = "response") -> DataFrame:
    """(type, n) over all questions of all responses."""
    options = F.transform(F.from_json(response, "struct<questions:array<struct<options:array<string>>>>")["questions"], lambda q: F.coalesce(F.size(q["options"]), F.lit(0)))
    n = F.col("n_options")
    kind = F.when(n > 2, "multiple_choice").when(n == 2, "true_false").otherwise("short_answer")
    return rows.select(F.explode(options).alias("n_options")).groupBy(kind.alias("type")).agg(F.count("*").alias("n"))


def parse_critic(response: Column) -> Column:
    """The critic's verdict inside a code fence, null where it is no JSON."""
    body = tx.strip_fences(response)
    return F.when(tx.is_json(body), F.from_json(body, "struct<score:double,verdict:string,issues:array<string>>"))


def quota_exceeded(failed: Column, error: Column) -> Column:
    """R9 (aggregate): 429 if any failed row's error speaks of a quota, else 200."""
    hit = F.bool_or(failed & F.coalesce(error.rlike("429|RESOURCE_EXHAUSTED|(?i)quota"), F.lit(False)))
    return F.when(F.coalesce(hit, F.lit(False)), 429).otherwise(200)
