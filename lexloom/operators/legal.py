"""Structure of statutes: lines -> chapters and sections by windows, schedules, clauses, entities, checks.

Lines are rows (doc_id, pos, line). A section's body is an island: the lines between one accepted header
and the next; a section's chapter is the last chapter header above it. Scans run over blocks of a document's lines
(see segments), so that a long document is many tasks; only a section's own lines come together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import segments
from ..functions.text import any_of, clean_content, has_any, strip

# ---- fixed values: patterns and tables that decide results ----
CHAPTER = r"^(?i)CHAPTER\s+([IVX]+|\d+)\s*$"
SECTION = r"^(\d+[A-Z]?)\.\s+([A-Z][^\n]+?)\.?\s*$"
FOOTNOTE = r"^\d+\.\s*(?:ins|subs|omitted|added|the words|w\.e\.f)|^\d+\s+of\s+\d{4}"
FOOTNOTE_MARKS = r"^[1-5]\..*(?:ins\.|subs\.|omitted|added)"
# A mark starts with one of few characters, which rules out most places at once; inside a run of digits none starts that its first digit doesn't start.
SCHEDULE = r"(?i)(?=[TFS\d])(?:(?:THE\s+)?(FIRST|SECOND|THIRD|FOURTH|FIFTH|SIXTH|SEVENTH|(?<!\d)\d+(?:ST|ND|RD|TH)?)\s+SCHEDULE|THE\s+SCHEDULE|SCHEDULE\s+([IVX]+|\d+|[A-Z]))"
ACT_NAMES = [
    r"(?i)THE\s+([A-Z][A-Za-z\s\(\)&,\-]+?)\s+ACT,?\s*((?:19|20)\d{2})",
    r"(?i)THE\s+([A-Z][A-Za-z\s\(\)&,\-]+?)\s*,\s*((?:19|20)\d{2})",
    r"(?i)([A-Z][A-Za-z\s\(\)&,\-]+?)\s+ACT[,\s]+((?:19|20)\d{2})",
]
ACT_NUMBER = r"(?i)(?:ACT\s+)?NO\.?\s*(\d+)\s+OF\s+((?:19|20)\d{2})"
CROSS_REFERENCE = r"\b(?:section|sub-section|clause)\s+([A-Z0-9\(\)]+)\b"
SUBSECTION, CLAUSE, SUBCLAUSE = r"\d+", r"[a-z]+", r"[ivx]+"
AUTHORITIES = [
    r"(?i)\b([A-Z][a-z]+\s+(?:Board|Authority|Commission|Committee|Tribunal|Government))\b",
    r"(?i)\b(Central\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b",
    r"(?i)\b(State\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b",
    r"(?i)\b([A-Z][a-z]+\s+Pollution\s+Control\s+Board)\b",
    r"(?i)\b(Appellate\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b",
    r"(?i)\b(High\s+Court|Supreme\s+Court)\b",
]
AUTHORITY_TYPES = ["board", "court", "tribunal", "government", "commission", "authority"]
JURISDICTIONS = ["state", "central", "union territory", "district"]
IMPRISONMENT = [
    r"(?i)imprisonment\s+for\s+a?\s*term\s+(?:which\s+)?(?:shall\s+not\s+be\s+less\s+than\s+([^,]+)\s+but\s+)?(?:which\s+)?(?:may\s+)?(?:extend\s+to\s+)?([^,\.]+)",
    r"(?i)imprisonment\s+for\s+a?\s*term\s+(?:which\s+)?(?:may\s+)?(?:extend\s+to\s+)?([^,\.]+)",
]
FINES = [
    r"(?i)fine\s+(?:which\s+)?(?:may\s+)?(?:extend\s+to\s+)?(?:rupees\s+)?([^,\.]+)",
    r"(?i)with\s+fine(?:\s+of\s+(?:rupees\s+)?([^,\.]+))?",
    r"(?i)₹\s*(\d+(?:,\d+)*)",
    r"(?i)rupees\s+(\d+(?:,\d+)*)",
]
FORMAL_DEFINITION = r'(?is)\([a-z]\)\s*"([^"]+)"\s+means\s+([^;]+);?'
INLINE_DEFINITION = r"(?i)\b([A-Za-z\s]+)\s+means\s+([^;\.]+)"
PENALTY_TITLE, PENALTY_TEXT = ["penalty", "punishment", "offence", "fine", "imprisonment"], ["punishable", "imprisonment", "fine", "penalty"]
PROCEDURE_TITLE, REQUIREMENTS = ["procedure", "process", "appeal", "application", "hearing"], ["require", "must", "shall", "necessary"]
STEPS, TIMELINE = r"(?i)(?:(?:\d+\.|\([a-z]\)|\([i]+\))\s+)([^\.]+\.)", r"(?i)(?:within\s+)?(\d+\s+(?:days?|months?|years?))"
PART_RANGES = [
    ("I", 1, 4), ("II", 5, 11), ("III", 12, 35), ("IV", 36, 51), ("IVA", 51, 51), ("V", 52, 151), ("VI", 152, 237),
    ("VIII", 239, 242), ("IX", 243, 243), ("IXA", 243, 243), ("X", 244, 244), ("XI", 245, 263), ("XII", 264, 300),
    ("XIII", 301, 307), ("XIV", 308, 323), ("XIVA", 323, 323), ("XV", 324, 329), ("XVI", 330, 342), ("XVII", 343, 351),
    ("XVIII", 352, 360), ("XIX", 361, 367), ("XX", 368, 368), ("XXI", 369, 392), ("XXII", 393, 395),
]
KNOWN_PARTS = [
    ("I", "The Union and Its Territory"), ("II", "Citizenship"), ("III", "Fundamental Rights"), ("IV", "Directive Principles of State Policy"),
    ("IVA", "Fundamental Duties"), ("V", "The Union"), ("VI", "The States"), ("VIII", "Union Territories"), ("IX", "The Panchayats"),
    ("IXA", "The Municipalities"), ("IXB", "Co-operative Societies"), ("X", "Scheduled and Tribal Areas"), ("XI", "Union-State Relations"),
    ("XII", "Finance, Property, Contracts"), ("XIII", "Trade and Commerce"), ("XIV", "Services"), ("XIVA", "Tribunals"), ("XV", "Elections"),
    ("XVI", "Special Provisions"), ("XVII", "Official Language"), ("XVIII", "Emergency Provisions"), ("XIX", "Miscellaneous"), ("XX", "Amendment"),
    ("XXI", "Temporary/Transitional"), ("XXII", "Short Title, Commencement, Repeals"),
]
CRITICAL_WORDS = ["penalty", "definition", "authority", "board", "power"]
AUTHORITY_BANNED = ["shall", "may", "improve", "prevent", "control"]
AUTHORITY_SHORT = {"Pollution Control Board": "Board", "Government": "Govt"}
AUTHORITY_STOP = ["Under", "Section", "This", "Act", "For", "The", "And", "To", "Of"]
POWER_WORDS, FUNCTION_WORDS = ["power", "authority", "may", "shall", "can"], ["function", "duty", "responsibility", "shall"]
ARTICLE_COLLECTION = "constitution-golden-source"
# ---- end of fixed values ----


def is_footnote(line: Column) -> Column:
    low = strip(F.lower(line))
    return low.rlike(FOOTNOTE) | low.rlike(FOOTNOTE_MARKS)


def chapter_number(line: Column) -> Column:
    """The number of a chapter header, or null."""
    return F.nullif(F.regexp_extract(strip(line), CHAPTER, 1), F.lit(""))


def section_header(line: Column) -> Column:
    """struct(number, title) of a section header that is no footnote, or null."""
    s = strip(line)
    number, title = F.regexp_extract(s, SECTION, 1), strip(F.regexp_extract(s, SECTION, 2))
    real = (number != "") & ~is_footnote(F.concat(number, F.lit(". "), title))
    return F.when(real, F.struct(number.alias("number"), title.alias("title")))


def is_chapter_title(line: Column) -> Column:
    """At least 5 characters, more than 60 % of the letters upper case."""
    s = strip(line)
    letters, upper = F.length(F.regexp_replace(s, r"\P{L}", "")), F.length(F.regexp_replace(s, r"\P{Lu}", ""))
    return (F.length(s) >= 5) & (letters > 0) & (upper > letters * 0.6)


def to_lines(documents: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, pos from 0, line)."""
    return documents.select("doc_id", F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"))


def content_start(lines: DataFrame, toc_mode: str = "second") -> DataFrame:
    """(doc_id, start): the second chapter header, the only one, 5 lines before the first section, or 0.

    toc_mode ``none`` starts at the first chapter header (no table of contents in the text).
    """
    line = F.struct(F.col("line").isNotNull().alias("some"), (F.length(strip(F.col("line"))) > 0).alias("filled"))
    near = segments.ahead(segments.blocked(lines), ["doc_id"], ["pos"], line, 2)
    following = F.coalesce(F.get("_ahead", 0)["v"]["filled"], F.lit(False)) & F.coalesce(F.get("_ahead", 1)["v"]["some"], F.lit(False))
    marked = near.select("doc_id", "pos", chapter_number(F.col("line")).isNotNull().alias("chapter"), (section_header(F.col("line")).isNotNull() & following).alias("section"))
    found = marked.groupBy("doc_id").agg(F.min(F.when(F.col("chapter"), F.col("pos"))).alias("c1"), F.min(F.when(F.col("section"), F.col("pos"))).alias("s"))
    if toc_mode == "second":
        later = marked.where("chapter").join(found.select("doc_id", "c1"), "doc_id").where("pos > c1").groupBy("doc_id").agg(F.min("pos").alias("c2"))
        found = found.join(later, "doc_id", "left")
    else:
        found = found.withColumn("c2", F.lit(None))
    return found.select("doc_id", F.coalesce("c2", "c1", F.greatest(F.col("s") - 5, F.lit(0)), F.lit(0)).alias("start"))


def chapters_and_sections(lines: DataFrame, toc_mode: str = "second") -> tuple[DataFrame, DataFrame]:
    """(chapters, sections) of every document.

    chapters: doc_id, pos, number, title, section_numbers. sections: doc_id, pos, number, title, content,
    chapter_number, chapter_title, has_proviso, has_explanation. The first section of a number wins. Lines of a document
    are told apart by pos.
    """
    body = lines.join(content_start(lines, toc_mode), "doc_id").where("pos >= start").drop("start")
    body = segments.ahead(segments.blocked(body), ["doc_id"], ["pos"], F.col("line"), 4)
    near = [F.get("_ahead", i)["v"] for i in range(4)]
    title = reduce(
        lambda later, line: F.when(line.isNull() | section_header(line).isNotNull(), "").when(F.length(strip(line)) == 0, later).when(is_chapter_title(line), strip(line)).when(chapter_number(line).isNotNull(), "").otherwise(later),
        reversed(near), F.lit(""),
    )
    chapter, header = chapter_number(F.col("line")), section_header(F.col("line"))
    marked = body.withColumns({"chapter": chapter, "chapter_title": F.when(chapter.isNotNull(), title), "header": header}).drop("_ahead")
    marked = marked.withColumn("header", F.when(F.col("chapter").isNull(), F.col("header")))
    # The first header of each number, as places within its block: few rows, and no line waits for another block's.
    firsts = marked.where("header IS NOT NULL").groupBy("doc_id", "header.number").agg(F.min(F.struct("pos", "_block")).alias("f"))
    firsts = firsts.groupBy("doc_id", F.col("f._block").alias("_block")).agg(F.collect_set("f.pos").alias("_firsts"))
    marked = marked.join(firsts, ["doc_id", "_block"], "left")
    first = F.coalesce(F.array_contains("_firsts", F.col("pos")), F.lit(False))
    marked = marked.withColumn("accepted", F.col("header").isNotNull() & first).drop("_firsts")
    skipped = F.col("header").isNotNull() & ~F.col("accepted")
    opens = F.col("chapter").isNotNull() | F.col("accepted")
    here = F.when(F.col("chapter").isNotNull(), F.struct(F.col("chapter").alias("number"), F.col("chapter_title").alias("title"), F.col("pos").alias("at")))
    marked = segments.running(marked, ["doc_id"], ["pos"], {"island": opens.cast("int")}, {"inside": here})
    kept = ~opens & ~skipped & ~is_footnote(F.col("line"))
    body_line = F.when(kept, F.struct("pos", F.when(F.length(strip(F.col("line"))) == 0, "").otherwise(F.col("line")).alias("line")))
    content = clean_content(F.array_join(F.transform(F.array_sort(F.collect_list(body_line)), lambda x: x["line"]), "\n"))
    # Lines in front of the first header belong to no section, so they aren't gathered.
    islands = marked.where("island > 0").groupBy("doc_id", "island").agg(F.min("pos").alias("pos"), F.max(F.when(F.col("accepted"), F.col("header"))).alias("h"), F.min_by("inside", "pos").alias("inside"), content.alias("content"))
    sections = islands.where("h IS NOT NULL").select(
        "doc_id", "pos", "h.number", "h.title", "content", F.coalesce("inside.number", F.lit("")).alias("chapter_number"), F.coalesce("inside.title", F.lit("")).alias("chapter_title"),
        F.contains("content", F.lit("Provided that")).alias("has_proviso"), F.contains("content", F.lit("Explanation")).alias("has_explanation"), F.col("inside.at").alias("chapter_pos"),
    )
    own = sections.where("chapter_pos IS NOT NULL").groupBy("doc_id", F.col("chapter_pos").alias("pos")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "number"))), lambda x: x["number"]).alias("section_numbers"))
    chapters = marked.where("chapter IS NOT NULL").select("doc_id", "pos", F.col("chapter").alias("number"), F.col("chapter_title").alias("title")).join(own, ["doc_id", "pos"], "left")
    return chapters.withColumn("section_numbers", F.coalesce("section_numbers", F.array().cast("array<string>"))), sections.drop("chapter_pos")


def _title_case(text: Column) -> Column:
    return F.initcap(text)


def act_metadata(text: Column, file_name: Column) -> Column:
    """struct(name, year, act_number) from the first 5000 characters, else from the file's name."""
    head = F.substring(text, 1, 5000)
    names = [F.nullif(strip(F.regexp_extract(head, p, 1)), F.lit("")) for p in ACT_NAMES]
    years = [F.nullif(F.regexp_extract(head, p, 2), F.lit("")) for p in ACT_NAMES]
    name = F.coalesce(*names, _title_case(F.replace(F.replace(file_name, F.lit(".pdf"), F.lit("")), F.lit("_"), F.lit(" "))))
    name = strip(F.regexp_replace(name, r"\s+", " "))
    name = F.when(F.upper(name) == name, _title_case(F.lower(name))).otherwise(name)
    year = F.coalesce(*years, F.nullif(F.regexp_extract(file_name, r"((?:19|20)\d{2})", 1), F.lit("")), F.lit("0")).cast("int")
    n, y = F.regexp_extract(head, ACT_NUMBER, 1), F.regexp_extract(head, ACT_NUMBER, 2)
    number = F.when(n == "", "").otherwise(F.concat(F.lit("No. "), n, F.lit(" of "), y))
    return F.struct(name.alias("name"), year.alias("year"), number.alias("act_number"))


def preamble(lines: DataFrame) -> DataFrame:
    """(doc_id, preamble): from WHEREAS or BE IT ENACTED to the first header, within 150 lines, cut at 2000."""
    up = F.upper(F.col("line"))
    by = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    opened = F.max(F.contains(up, F.lit("BE IT ENACTED")) | F.contains(up, F.lit("WHEREAS"))).over(by)
    header = chapter_number(F.col("line")).isNotNull() | section_header(F.col("line")).isNotNull()
    marked = lines.where("pos < 150").withColumns({"opened": opened, "header": header})
    marked = marked.withColumn("closed", F.max(F.col("opened") & F.col("header")).over(by))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("opened") & ~F.col("closed"), F.struct("pos", "line")))), lambda x: x["line"]), "\n")
    return marked.groupBy("doc_id").agg(F.substring(strip(text), 1, 2000).alias("preamble"))


def schedules(documents: DataFrame) -> DataFrame:
    """(doc_id, pos, number, content): from each schedule mark to the next (the last: 5000), cut at 3000."""
    parts = F.slice(F.split(F.regexp_replace("text", SCHEDULE, "\u0001$0"), "\u0001"), 2, 1 << 30)
    # A step of its own, so that a text is searched once for both the parts and their number.
    found = documents.select("doc_id", parts.alias("parts")).withColumn("n", F.size("parts"))
    rows = found.select("doc_id", F.posexplode("parts").alias("pos", "part"), "n")
    number = F.coalesce(F.nullif(F.regexp_extract("part", "^" + SCHEDULE, 1), F.lit("")), F.nullif(F.regexp_extract("part", "^" + SCHEDULE, 2), F.lit("")), F.lit("I"))
    body = F.when(F.col("pos") == F.col("n") - 1, F.substring("part", 1, 5000)).otherwise(F.col("part"))
    return rows.select("doc_id", "pos", number.alias("number"), F.substring(F.btrim(body, F.lit(" \t\n\x0b\f\r")), 1, 3000).alias("content"))


def numbered_parts(text: Column, mark: str) -> Column:
    """Array of struct(number, text) for marks such as (1), (a) or (i); a part ends at the next mark."""
    parts = F.filter(F.split(F.regexp_replace(text, rf"\((?={mark}\)\s)", "\u0001("), "\u0001"), lambda p: p.rlike(rf"^\({mark}\)\s"))
    head = rf"^\(({mark})\)\s+"
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, head, 1).alias("number"), strip(F.regexp_replace(p, head, "")).alias("text")))


def subsection_tree(content: Column) -> Column:
    """Subsections with their clauses and sub-clauses."""
    return F.transform(
        numbered_parts(content, SUBSECTION),
        lambda s: F.struct(
            s["number"].alias("number"), s["text"].alias("text"),
            F.transform(numbered_parts(s["text"], CLAUSE), lambda c: F.struct(c["number"].alias("number"), c["text"].alias("text"), numbered_parts(c["text"], SUBCLAUSE).alias("sub_clauses"))).alias("clauses"),
        ),
    )


def section_order(number: Column) -> Column:
    """The numeric value of a section number, 999 if it isn't all digits."""
    return F.when(number.rlike(r"^\d+$"), number.cast("int")).otherwise(999)


def sequence_gaps(sections: DataFrame) -> DataFrame:
    """(doc_id, missing): numbers between the least and greatest numeric section that no section has."""
    numeric = F.collect_set(F.when(F.col("number").rlike(r"^\d{1,6}$"), F.col("number").cast("int")))
    got = sections.groupBy("doc_id").agg(numeric.alias("got")).where(F.size("got") > 0)
    return got.select("doc_id", F.array_sort(F.array_except(F.sequence(F.array_min("got"), F.array_max("got")), "got")).alias("missing"))


def chapter_by_position(sections: DataFrame, chapters: DataFrame) -> DataFrame:
    """Section -> the first chapter whose inclusive interval (start, end) holds its position, else null.

    Positions are cut into cells as wide as an interval is on average, and an interval is dealt to the cells that it
    reaches: about two for each, so sections meet only intervals near them, by equi-join on document and cell.
    """
    width = chapters.agg(F.avg(F.greatest(F.col("end") - F.col("start") + 1, F.lit(1)))).first()[0]
    cell = lambda c: F.floor(c / F.lit(float(max(1.0, width or 1.0))))
    reach = F.explode(F.sequence(cell(F.col("start")), cell(F.col("end"))))
    dealt = chapters.where("start <= end").select("doc_id", "start", "end", F.col("number").alias("chapter_number"), reach.alias("_cell"))
    # Sections are looked up once for each position; repeated rows then meet the one answer.
    asked = sections.select("doc_id", "pos").distinct().withColumn("_cell", cell(F.col("pos")))
    inside = F.when(F.col("pos").between(F.col("start"), F.col("end")), F.struct("start", "chapter_number"))
    found = asked.join(dealt, ["doc_id", "_cell"]).groupBy("doc_id", "pos").agg(F.min(inside)["chapter_number"].alias("chapter_number"))
    return sections.join(found, ["doc_id", "pos"], "left").select(*sections.columns, "chapter_number")


def part_of(article: Column, default: str | None = None) -> Column:
    """The first range that holds the article number, else the default. The table is a fixed few rows."""
    out = F.lit(default).cast("string")
    for part, low, high in reversed(PART_RANGES):
        out = F.when(article.between(low, high), part).otherwise(out)
    return out


def cross_references(sections: DataFrame) -> DataFrame:
    """(doc_id, number, pos, target, context) with 50 characters of context on either side.

    Contexts overlap and need positions, which no built-in returns, so matches are found per Arrow batch.
    """
    pattern = re.compile(CROSS_REFERENCE, re.I)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, pos, target, context = [], [], [], []
            for i, text in enumerate(batch["content"].to_pylist()):
                for m in pattern.finditer(text or ""):
                    index.append(i)
                    pos.append(m.start())
                    target.append(m[1])
                    context.append(text[max(0, m.start() - 50) : m.end() + 50])
            take = pa.array(index, pa.int64())
            columns = [batch["doc_id"].take(take), batch["number"].take(take), pa.array(pos, pa.int32()), pa.array(target, pa.string()), pa.array(context, pa.string())]
            yield pa.record_batch(columns, names=["doc_id", "number", "pos", "target", "context"])

    kind = dict(sections.dtypes)["doc_id"]
    return sections.select("doc_id", "number", "content").mapInArrow(run, f"doc_id {kind}, number string, pos int, target string, context string")


def invalid_references(references: DataFrame, sections: DataFrame) -> DataFrame:
    """References whose target is no section of their document."""
    return references.join(sections.select("doc_id", F.col("number").alias("target")), ["doc_id", "target"], "left_anti")


def normalise_authority(name: Column) -> Column:
    """The name without stop words in title case; null if it is too long, too short or holds a banned word."""
    single = lambda c: strip(F.regexp_replace(c, r"\s+", " "))
    plain = single(name)
    short = reduce(lambda c, pair: F.regexp_replace(c, rf"\b{pair[0]}\b", pair[1]), AUTHORITY_SHORT.items(), plain)
    bare = single(F.regexp_replace(short, rf"(?i)\b(?:{'|'.join(AUTHORITY_STOP)})\b", ""))
    usable = (F.length(plain) <= 100) & ~has_any(plain, AUTHORITY_BANNED) & (F.length(bare) >= 3)
    return F.when(usable, F.initcap(bare))


def authorities(sections: DataFrame) -> DataFrame:
    """One row per document and authority, at its first mention: type, section, context, jurisdiction.

    Order is by section position, then pattern, then place in the text.
    """
    found = F.concat(*[F.regexp_extract_all("content", F.lit(p), F.lit(1)) for p in AUTHORITIES])
    rows = sections.select("doc_id", "pos", "number", "content", F.posexplode(found).alias("nth", "raw")).withColumn("name", normalise_authority(F.col("raw"))).where("name IS NOT NULL")
    first = Window.partitionBy("doc_id", "name").orderBy("pos", "nth")
    rows = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    low = F.lower("name")
    kind = reduce(lambda rest, t: F.when(F.contains(low, F.lit(t)), t).otherwise(rest), reversed(AUTHORITY_TYPES), F.lit("other"))
    sentences = F.filter(F.split("content", "[.;]"), lambda s: F.contains(F.lower(s), F.lower(F.col("name"))))
    context = F.coalesce(strip(F.try_element_at(sentences, F.lit(1))), F.lit(""))
    out = rows.select("doc_id", "name", kind.alias("type"), F.col("number").alias("section"), context.alias("context"))
    cut = F.when(F.length("context") > 100, F.concat(F.substring("context", 1, 100), F.lit("..."))).otherwise(F.col("context"))
    listed = lambda words: F.when((F.col("context") != "") & has_any(F.col("context"), words), F.array(cut)).otherwise(F.array().cast("array<string>"))
    jurisdiction = reduce(lambda rest, j: F.when(F.contains(F.lower("context"), F.lit(j)), F.initcap(F.lit(j))).otherwise(rest), reversed(JURISDICTIONS), F.lit("Unknown"))
    return out.withColumns(
        {"powers": listed(POWER_WORDS), "functions": listed(FUNCTION_WORDS), "jurisdiction": F.when(F.col("context") == "", "").otherwise(jurisdiction)}
    )


def penalties(sections: DataFrame) -> DataFrame:
    """(doc_id, section, type, value, raw) of penalty sections; every pattern adds its matches.

    A missing minimum term leaves the maximum alone (Q17).
    """
    gate = has_any(F.col("title"), PENALTY_TITLE) & has_any(F.col("content"), PENALTY_TEXT)
    kept = sections.where(gate)
    everything = []
    for i, p in enumerate([*IMPRISONMENT, *FINES]):
        jail = i < len(IMPRISONMENT)
        groups = 2 if i == 0 else 1
        zipped = F.arrays_zip(*[F.regexp_extract_all("content", F.lit(p), F.lit(g)).alias(f"g{g}") for g in range(groups + 1)])
        last = strip(F.col("m")[f"g{groups}"])
        value = last if groups == 1 else F.when(F.col("m")["g1"] != "", F.concat(strip(F.col("m")["g1"]), F.lit(" to "), last)).otherwise(last)
        value = value if jail else F.when(value == "", "unspecified").otherwise(value)
        rows = kept.select("doc_id", "number", F.posexplode(zipped).alias("nth", "m"))
        everything.append(rows.select("doc_id", F.col("number").alias("section"), F.lit("imprisonment" if jail else "fine").alias("type"), value.alias("value"), F.col("m")["g0"].alias("raw"), F.lit(i).alias("pattern"), "nth"))
    return reduce(DataFrame.unionByName, everything)


def definitions(sections: DataFrame) -> DataFrame:
    """(doc_id, section, term, definition, context): of the first definition section, and inline ones."""
    first = Window.partitionBy("doc_id").orderBy("pos")
    formal = sections.where(F.contains(F.lower("title"), F.lit("definition"))).withColumn("_n", F.row_number().over(first)).where("_n = 1")
    pairs = lambda p: F.arrays_zip(F.regexp_extract_all("content", F.lit(p), F.lit(1)).alias("t"), F.regexp_extract_all("content", F.lit(p), F.lit(2)).alias("d"))
    a = formal.select("doc_id", F.col("number").alias("section"), F.explode(pairs(FORMAL_DEFINITION)).alias("x"), F.lit("formal_definition").alias("context"))
    b = sections.select("doc_id", F.lit("inline").alias("section"), F.explode(pairs(INLINE_DEFINITION)).alias("x"), F.lit("inline_definition").alias("context"))
    b = b.where(F.size(F.split(strip(F.col("x.t")), r"\s+")).between(3, 5))
    return a.unionByName(b).select("doc_id", "section", strip(F.col("x.t")).alias("term"), strip(F.col("x.d")).alias("definition"), "context")


def procedures(sections: DataFrame) -> DataFrame:
    """Name, description, at most 5 steps, timeline and at most 3 requirements of procedural sections."""
    kept = sections.where(has_any(F.col("title"), PROCEDURE_TITLE) & (F.length(strip(F.col("content"))) > 0))
    c = F.col("content")
    required = F.filter(F.split(c, "[.;]"), lambda s: any_of([F.contains(F.lower(s), F.lit(w)) for w in REQUIREMENTS]))
    return kept.select(
        "doc_id", F.col("number").alias("section"), F.col("title").alias("name"), F.when(F.length(c) > 200, F.concat(F.substring(c, 1, 200), F.lit("..."))).otherwise(c).alias("description"),
        F.slice(F.transform(F.regexp_extract_all(c, F.lit(STEPS), F.lit(1)), strip), 1, 5).alias("steps"),
        F.nullif(F.regexp_extract(c, TIMELINE, 1), F.lit("")).alias("timeline"), F.slice(F.transform(required, strip), 1, 3).alias("requirements"),
    )


def entities(sections: DataFrame) -> DataFrame:
    """(doc_id, authorities, penalties, definitions, procedures): the four lists of every document that has a section.

    Lists are sorted by their fields; a document is expected to fit a row with its entities.
    """
    found = {
        "authorities": authorities(sections).select("doc_id", F.struct("name", "type", "section", "jurisdiction").alias("x")),
        "penalties": penalties(sections).select("doc_id", F.struct("section", "type", "value").alias("x")),
        "definitions": definitions(sections).select("doc_id", F.struct("term", "definition", "context", "section").alias("x")),
        "procedures": procedures(sections).select("doc_id", F.struct("section", "name", "timeline").alias("x")),
    }
    out = sections.select("doc_id").distinct()
    for name, rows in found.items():
        listed = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list("x")).alias(name))
        empty = F.array().cast(listed.schema[name].dataType)
        out = out.join(listed, "doc_id", "left").withColumn(name, F.coalesce(name, empty))
    return out


def parsing_stats(sections: DataFrame) -> DataFrame:
    """(doc_id, total_sections, extracted_authorities, extracted_penalties, cross_references, errors) of parsed documents.

    Errors are those of the checks: empty sections and references that lead nowhere.
    """
    count = lambda rows, name: rows.groupBy("doc_id").agg(F.count("*").alias(name))
    references = cross_references(sections)
    out = count(sections, "total_sections")
    blank = sections.groupBy("doc_id").agg(F.count_if(F.length(strip(F.coalesce("content", F.lit("")))) == 0).alias("_blank"))
    parts = [count(authorities(sections), "extracted_authorities"), count(penalties(sections), "extracted_penalties"), count(references, "cross_references"), count(invalid_references(references, sections), "_lost"), blank]
    for rows in parts:
        out = out.join(rows, "doc_id", "left")
    out = out.na.fill(0)
    errors = F.array_compact(F.array(F.when(F.col("_blank") > 0, "empty sections"), F.when(F.col("_lost") > 0, "invalid references")))
    return out.withColumn("errors", errors).drop("_blank", "_lost")


def validation_report(originals: DataFrame, sections: DataFrame) -> DataFrame:
    """One row per document: sections, gaps, duplicates, kept words, invalid references, score and verdict.

    ``originals`` has doc_id and text. The score is the share of four checks that hold: sections were found, no number
    occurs twice, at least 0.8 of the words were kept, no reference leads nowhere.
    """
    parsed = sections.select("doc_id", F.concat_ws(" ", "title", "content").alias("text"))
    kept = preservation(originals, parsed).select("doc_id", "ratio", "verdict")
    numbers = sections.groupBy("doc_id").agg(F.count("*").alias("n_sections"), (F.count("*") - F.count_distinct("number")).alias("n_duplicates"))
    gaps = sequence_gaps(sections).select("doc_id", F.size("missing").alias("n_gaps"))
    lost = invalid_references(cross_references(sections), sections).groupBy("doc_id").agg(F.count("*").alias("n_invalid"))
    out = originals.select("doc_id").join(kept, "doc_id", "left").join(numbers, "doc_id", "left").join(gaps, "doc_id", "left").join(lost, "doc_id", "left")
    out = out.na.fill(0, ["n_sections", "n_duplicates", "n_gaps", "n_invalid"])
    checks = [F.col("n_sections") > 0, F.col("n_duplicates") == 0, F.col("ratio") >= 0.8, F.col("n_invalid") == 0]
    return out.withColumn("score", overall_score(checks))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def preservation(originals: DataFrame, parsed: DataFrame) -> DataFrame:
    """Words kept by (doc_id, text) parts over words of the originals, and a verdict."""
    whole = originals.select("doc_id", word_count(F.col("text")).alias("words"), F.lower("text").alias("low"))
    kept = parsed.groupBy("doc_id").agg(F.sum(word_count(F.col("text"))).alias("kept"))
    joined = whole.join(kept, "doc_id", "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
    ratio = F.when(F.col("words") > 0, F.col("kept") / F.col("words")).otherwise(0.0)
    return joined.select("doc_id", "words", "kept", ratio.alias("ratio"), F.when(ratio < 0.8, "error").when(ratio < 0.9, "warning").otherwise("ok").alias("verdict"))


def overall_score(checks: list[Column]) -> Column:
    """Share of the checks that hold."""
    return reduce(lambda a, b: a + b, [c.cast("int") for c in checks]) / F.lit(float(len(checks)))


def validate_act(name: Column, year: Column, numbers: Column, contents: Column) -> Column:
    """struct(errors, warnings) for an act's name, year, section numbers and contents."""
    n = F.coalesce(F.size(numbers), F.lit(0))
    empty = F.size(F.filter(contents, lambda c: F.length(strip(F.coalesce(c, F.lit("")))) == 0))
    errors = F.array_compact(F.array(F.when(F.coalesce(F.length(strip(name)), F.lit(0)) == 0, "missing name"), F.when(numbers.isNull() | (n <= 0), "no sections")))
    warnings = F.array_compact(
        F.array(
            F.when(~F.coalesce(year.between(1800, 2100), F.lit(False)), "unlikely year"),
            F.when((n > 0) & (empty > 0.3 * n), "many empty sections"),
            F.when((n > 0) & (F.size(F.array_distinct(numbers)) < n), "duplicate section numbers"),
        )
    )
    return F.struct(errors.alias("errors"), warnings.alias("warnings"))


def missing_authorities(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Expected names (doc_id, name) that no extracted name of the document contains."""
    have = found.select("doc_id", F.lower("name").alias("_have"))
    return expected.join(have, (expected.doc_id == have.doc_id) & F.contains(F.col("_have"), F.lower(expected.name)), "left_anti")


def section_chunks(sections: DataFrame, least: int = 20, most: int = 4000) -> DataFrame:
    """A section's chunk text, longer than ``least`` characters, cut at ``most``, with id and hash."""
    text = F.concat(F.lit("Section "), F.col("number"), F.lit(": "), F.col("title"), F.lit("\n\n"), F.col("content"))
    rows = sections.withColumn("text", F.substring(text, 1, most)).where(F.length(F.col("text")) > least)
    return rows.select("doc_id", F.concat_ws("_", F.col("doc_id").cast("string"), F.lit("sec"), "number").alias("chunk_id"), F.col("number").alias("section_number"), "chapter_number", "text", F.sha2("text", 256).alias("text_hash"))


def code_chunks(chunks: DataFrame, prefix: str = "bns") -> DataFrame:
    """Chunk records of a code's sections (chunk_id, text, section_number, section_title, chapter_number, pages); a missing number is the row's place."""
    place = F.concat(F.lit("s"), F.row_number().over(Window.partitionBy("chapter_number").orderBy("chunk_id")).cast("string"))
    number = F.coalesce("section_number", place)
    chapter = F.concat(F.lit("Chapter "), F.coalesce(F.nullif("chapter_number", F.lit("")), F.lit("Unknown")))
    return chunks.select(
        "chunk_id", F.concat(F.lit(f"{prefix}-"), number).alias("document_id"), "text", chapter.alias("chapter_title"), F.coalesce("section_number", F.lit("")).alias("section_num"), F.coalesce("section_title", F.lit("")).alias("section_title"),
        F.lit("concept").alias("chunk_type"), F.concat(F.lit(f"{prefix.upper()}-"), number).alias("topic_id"), F.array(F.concat(F.lit("Section "), number), F.coalesce("section_title", F.lit(""))).alias("key_terms"), "page_start", "page_end",
    )


def article_chunks(articles: DataFrame, collection: str = ARTICLE_COLLECTION) -> DataFrame:
    """Chunk records of articles (id, title, text, part)."""
    name = F.concat(F.lit("constitution-"), F.lower("id"))
    return articles.select(
        F.concat(name, F.lit("-chunk-001")).alias("chunk_id"), name.alias("file_id"), F.concat(F.lit("Constitution-"), "id").alias("file_name"), F.lit(collection).alias("collection_id"), "text",
        F.lit("concept").alias("chunk_type"), F.col("part").alias("chapter_title"), F.col("title").alias("section_title"), F.lit("constitution").alias("source_type"),
    )


def article_entry(entry: Column) -> Column:
    """struct(number, title, part) of an entry such as "14. Equality"; number "0" if there is none."""
    first = F.substring_index(entry, "\n", 1)
    number = F.regexp_extract(first, r"^\s*(\d+[A-Z]*)\.?\s*", 1)
    number = F.when(number == "", "0").otherwise(number)
    digits = F.regexp_extract(number, r"^(\d+)", 1).cast("int")
    title = strip(F.regexp_replace(first, r"^\s*\d+[A-Z]*\.?\s*", ""))
    return F.struct(number.alias("number"), title.alias("title"), part_of(digits, "XXII").alias("part"))


def article_references(text: Column) -> Column:
    """Art-n of every article mentioned, distinct, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?i)Article\s+(\d+[A-Z]*)"), F.lit(1)), lambda n: F.concat(F.lit("Art-"), n)))


def best_articles(candidates: DataFrame) -> DataFrame:
    """Of candidates (doc_id, number, priority, text, pos) the highest priority, then longest, then first."""
    best = Window.partitionBy("doc_id", "number").orderBy(F.desc("priority"), F.desc(F.length("text")), "pos")
    return candidates.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def longest_schedules(found: DataFrame) -> DataFrame:
    """The longest text per schedule number, the first of equals."""
    best = Window.partitionBy("doc_id", "number").orderBy(F.desc(F.length("content")), "pos")
    return found.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def structure_summary(sections: DataFrame) -> DataFrame:
    """A10: totals, titled and divided sections, and a map of sections by chapter, per document."""
    per = sections.groupBy("doc_id", "chapter_number").agg(F.count("*").alias("n"), F.count_if(F.length("title") > 0).alias("titled"), F.count_if(F.size(numbered_parts(F.col("content"), SUBSECTION)) > 0).alias("divided"))
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("chapter_number", "n"))))
    return per.groupBy("doc_id").agg(F.sum("n").alias("sections"), F.sum("titled").alias("titled"), F.sum("divided").alias("divided"), pairs.alias("by_chapter"))
