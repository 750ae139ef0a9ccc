"""Text scalars: Column -> Column, all inside the JVM.

White space means Python's ASCII set unless noted; ``strip`` removes all of it, not only spaces.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: word lists, patterns and tables that decide results ----
EXAMPLE_WORDS = ["example", "sample", "worked", "demonstration", "illustration", "case study"]
QUESTION_WORDS = ["exercise", "problem", "question", "checkpoint", "practice", "review", "test yourself"]
DIAGRAM_WORDS = ["figure", "diagram", "fig.", "illustration", "graph", "chart"]
PAGE_DIAGRAM_WORDS = ["figure", "diagram", "illustration", "graph", "chart", "image"]
EQUATION = r"[=+\-*/]\s*[A-Za-z0-9]|[A-Za-z]\s*="
FORMULA = r"([A-Z][a-z]?\s*=|∑|∫|√|π|α|β|γ|Δ)"
QUOTED, CAPITALISED = r'"([^"]+)"', r"(?<!^)([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)"
BOOK_SIGNS = [r"\bedition\b", r"\bisbn[\s\-:]*\d", r"\bcopyright\s+©?\s*\d{4}", r"\bpublished\s+by\b", r"\b(?:university|academic)\s+press\b"]
# Lines are matched in lower case, which makes a pattern of upper-case chapters superfluous.
CHAPTER_LINES = [r"^chapter\s+\d+", r"^ch\.?\s*\d+", r"^\d+\.\s+[a-z]"]
CHAPTER_INFO = [
    r"^(?i)chapter\s+(\d+)[:\-\s]*(.+?)$",
    r"^(?i)ch\.?\s*(\d+)[:\-\s]*(.+?)$",
    r"^(?i)(\d+)\.\s+([A-Z].+?)$",
    r"^(?i)(\d+)[:\-\s]+([A-Z].+?)$",
]
EDITIONS = [r"(?i)(\d+(?:st|nd|rd|th)\s+edition)", r"(?i)(edition\s+\d+)", r"(?i)(\d+(?:st|nd|rd|th)\s+ed\.?)"]
AUTHOR, NOT_AUTHOR = r"^[A-Z][a-z]+\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?$", ["edition", "press", "university", "chapter", "contents"]
CASE_CITATION = r"(?i)([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\s+v\.?\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\s*(?:\((\d{4})\))?"
STATUTE_CITATION = r"(?i)(?:Article|Art\.|Section|Sec\.)\s+(\d+[A-Z]?(?:\([a-z]\))?)"
INTENTS = {
    "concept": [r"^what (is|are|does|do)", r"^explain", r"^define", r"^describe", "definition of", "meaning of", "concept of", "understanding", "tell me about"],
    "example": ["example", "show me", "demonstrate", "illustration", "sample", "case study"],
    "question": [r"^how (do|to|can)", r"^solve", r"^calculate", r"^find", r"^determine", "practice", "exercise", "problem"],
}
MIME_TYPES = {
    ".pdf": "application/pdf",
    ".txt": "text/plain; charset=utf-8",
    ".md": "text/markdown; charset=utf-8",
    ".csv": "text/csv; charset=utf-8",
    ".json": "application/json",
    ".xml": "application/xml",
    ".html": "text/html; charset=utf-8",
    ".htm": "text/html; charset=utf-8",
}
DEFAULT_MIME = "application/octet-stream"
YOUTUBE_HOSTS = ["youtube.com", "www.youtube.com", "youtu.be", "m.youtube.com"]
CONSTITUTION_WORDS = ["constitution", "constitutional", "bharatiya", "संविधान", "samvidhan", "fundamental_rights", "directive_principles", "emergency_provisions"]
VIDEO_ID = [
    r"(?:https?://)?(?:www\.)?youtube\.com/watch\?v=([a-zA-Z0-9_-]{11})",
    r"(?:https?://)?(?:www\.)?youtu\.be/([a-zA-Z0-9_-]{11})",
    r"(?:https?://)?(?:www\.)?youtube\.com/embed/([a-zA-Z0-9_-]{11})",
]
EDUCATIONAL_PROMPT = ["mcq", "questions", "quiz", "test", "exam", "assessment", "generate", "create", "multiple choice", "true false", "practice", "exercise", "homework", "assignment", "worksheet"]
EDUCATIONAL_JSON = ["mcq", "questions", "quiz", "test", "exam", "assessment", "generate", "create questions", "multiple choice", "true false"]
ABBREVIATIONS = [(r"\bDr\.", "Dr"), (r"\bProf\.", "Prof"), (r"\bet al\.", "et al"), (r"\be\.g\.", "eg"), (r"\bi\.e\.", "ie")]
BASIC_WORDS, ADVANCED_WORDS = ["basic", "easy"], ["advanced", "difficult"]
BOLD_FONTS, ITALIC_FONTS = ["bold", "heavy", "black"], ["italic", "oblique"]
# ---- end of fixed values ----


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def has_any(text: Column, words: list[str]) -> Column:
    """Whether any of the plain strings occurs in the lower-cased text."""
    low = F.lower(text)
    return any_of([F.contains(low, F.lit(w)) for w in words])


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def words(text: Column) -> Column:
    """Words of a text, as Python's split(): no empty ones."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def sentences(text: Column) -> Column:
    """Cut behind . ! ? and the white space that follows."""
    return F.split(text, r"(?<=[.!?])\s+")


def semantic_sentences(text: Column) -> Column:
    """Abbreviations lose their full stops first; sentences of 10 characters or fewer go."""
    for pattern, plain in ABBREVIATIONS:
        text = F.regexp_replace(text, pattern, plain)
    return F.filter(F.transform(sentences(text), strip), lambda s: F.length(s) > 10)


def key_terms(text: Column, limit: int = 10) -> Column:
    """Quoted strings, then capitalised phrases not at the start; distinct, in order of appearance."""
    found = F.concat(F.regexp_extract_all(text, F.lit(QUOTED), F.lit(1)), F.regexp_extract_all(text, F.lit(CAPITALISED), F.lit(1)))
    return F.slice(F.array_distinct(found), 1, limit)


def equations(text: Column, limit: int = 5) -> Column:
    """Lines that look like equations, stripped, shorter than 100 characters."""
    lines = F.filter(F.split(text, "\n"), lambda l: l.rlike(EQUATION) | l.rlike(FORMULA))
    return F.slice(F.filter(F.transform(lines, strip), lambda l: F.length(l) < 100), 1, limit)


def has_diagram(text: Column, words_: list[str] = DIAGRAM_WORDS) -> Column:
    return has_any(text, words_)


def chunk_type(text: Column) -> Column:
    """Example before question before concept."""
    return F.when(has_any(text, EXAMPLE_WORDS), "example").when(has_any(text, QUESTION_WORDS), "question").otherwise("concept")


def printable_share(text: Column) -> Column:
    """share of characters that are printable or white space."""
    return (F.length(text) - F.length(F.regexp_replace(text, r"[^\p{C}]|\s", ""))) / F.length(text)


def is_valid(text: Column) -> Column:
    """not blank and more than 80 % printable."""
    return F.coalesce((F.length(strip(text)) > 0) & (printable_share(text) > 0.8), F.lit(False))


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def content_hash(struct: Column) -> Column:
    """16 hex digits over the JSON of a struct whose fields are given in sorted order."""
    return F.substring(F.md5(F.to_json(struct).cast("binary")), 1, 16)


def slug(prefix: str, name: Column, year: Column) -> Column:
    """prefix_name_year; letters and digits of any script stay, spaces become underscores."""
    plain = F.regexp_replace(strip(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}\s_-]", "")), r"[\s-]+", "_")
    return F.concat_ws("_", F.lit(prefix), plain, year.cast("string"))


def clean_content(text: Column, limit: int = 5000) -> Column:
    """At most one blank line, single spaces, stripped, cut."""
    text = F.regexp_replace(F.regexp_replace(text, r"\n\s*\n\s*\n+", "\n\n"), " +", " ")
    return F.substring(strip(text), 1, limit)


def timestamp(seconds: Column) -> Column:
    """MM:SS, from one hour HH:MM:SS; fractions are cut."""
    total = F.floor(seconds).cast("int")
    h, m, s = (total / 3600).cast("int"), ((total % 3600) / 60).cast("int"), total % 60
    return F.when(h > 0, F.format_string("%02d:%02d:%02d", h, m, s)).otherwise(F.format_string("%02d:%02d", m, s))


def file_name(path: Column) -> Column:
    return F.substring_index(F.regexp_replace(path, "^local://", ""), "/", -1)


def extension(path: Column) -> Column:
    """Lower-case suffix with its dot; empty if there is none (a leading dot is no suffix)."""
    return F.lower(F.regexp_extract(file_name(path), r"[^.](\.[^.]*)$", 1))


def mime_type(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MIME_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, extension(path)), F.lit(DEFAULT_MIME))


def plain_name(path: Column) -> Column:
    """The file name without a UUID in front."""
    return F.regexp_replace(file_name(path), "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}_", "")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def domain(url: Column) -> Column:
    """What stands between :// and the path, port and user included."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def url_suffix(url: Column, default: str = ".pdf") -> Column:
    """Suffix of the path's last part, else the default."""
    found = F.regexp_extract(url_path(url), r"[^./](\.[^./]+)$", 1)
    return F.when(found == "", F.lit(default)).otherwise(found)


def source_type(source: Column) -> Column:
    """Youtube or web for urls; by suffix for paths; null if unsupported."""
    kind, ext = scheme(source), extension(source)
    by_file = F.when(ext == ".pdf", F.when(has_any(source, CONSTITUTION_WORDS), "constitution").otherwise("pdf")).when(ext.isin(".png", ".jpg", ".jpeg", ".webp"), "image")
    return F.when(kind == "", by_file).when(domain(source).isin(YOUTUBE_HOSTS), "youtube").when(kind.isin("http", "https"), "web")


def video_id(url: Column) -> Column:
    """Three url shapes, then the v parameter of a youtube.com url."""
    found = [F.nullif(F.regexp_extract(url, p, 1), F.lit("")) for p in VIDEO_ID]
    query = F.when(F.contains(domain(url), F.lit("youtube.com")), F.nullif(F.regexp_extract(url, r"[?&]v=([^&#]+)", 1), F.lit("")))
    return F.coalesce(*found, query)


def intent(query: Column) -> Column:
    """Concept before example before question, else null."""
    low = strip(F.lower(query))
    out = F.when(F.lit(False), F.lit(""))
    for name, patterns in INTENTS.items():
        out = out.when(low.rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(name))
    return out


def content_type(text: Column, size_bytes: Column, hint: Column | None = None) -> Column:
    """The user's hint (unless it is auto); book by size, book signs or chapter headings; chapter by its first lines; else document."""
    low = F.lower(text)
    signs = reduce(lambda a, b: a + b, [low.rlike(p).cast("int") for p in BOOK_SIGNS])
    first = F.transform(F.slice(F.split(text, "\n"), 1, 5), lambda l: strip(F.lower(l)))
    chapter = F.exists(first, lambda l: any_of([l.rlike(p) for p in CHAPTER_LINES]))
    book = (size_bytes > 5 * 1024 * 1024) | (signs >= 2) | (F.regexp_count(low, F.lit(r"chapter\s+\d+")) >= 3)
    found = F.when(book, "book").when(chapter, "chapter").otherwise("document")
    return found if hint is None else F.coalesce(F.nullif(F.lower(hint), F.lit("auto")), found)


def chapter_info(text: Column) -> Column:
    """struct(number, title) from the first of 20 lines that fits a chapter pattern with 1-99, or null."""
    lines = F.transform(F.slice(F.split(text, "\n"), 1, 20), strip)

    def read(line: Column) -> Column:
        out = F.lit(None).cast("struct<number:int,title:string>")
        for p in reversed(CHAPTER_INFO):
            number = F.try_to_number(F.regexp_extract(line, p, 1), F.lit("999999")).cast("int")
            out = F.when(number.between(1, 99), F.struct(number.alias("number"), strip(F.regexp_extract(line, p, 2)).alias("title"))).otherwise(out)
        return out

    return F.try_element_at(F.filter(F.transform(lines, read), lambda x: x.isNotNull()), F.lit(1))


def edition(text: Column) -> Column:
    return F.coalesce(*[F.nullif(strip(F.regexp_extract(text, p, 1)), F.lit("")) for p in EDITIONS])


def authors(text: Column) -> Column:
    """Lines among the first 20 that look like a name, at most 5."""
    lines = F.transform(F.slice(F.split(text, "\n"), 1, 20), strip)
    return F.slice(F.filter(lines, lambda l: l.rlike(AUTHOR) & ~has_any(l, NOT_AUTHOR)), 1, 5)


def title_line(text: Column) -> Column:
    """The first of 10 lines with 4-199 characters that isn't a number."""
    lines = F.transform(F.slice(F.split(text, "\n"), 1, 10), strip)
    return F.try_element_at(F.filter(lines, lambda l: (F.length(l) > 3) & (F.length(l) < 200) & ~l.rlike(r"^\d+$")), F.lit(1))


def statute_citations(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(STATUTE_CITATION), F.lit(1))


def case_citations(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CASE_CITATION), F.lit(0))


def is_json(text: Column) -> Column:
    """R2: whether a text parses as JSON."""
    return F.try_parse_json(text).isNotNull()


def strip_fences(text: Column) -> Column:
    """JSON inside a Markdown code fence."""
    return strip(F.regexp_replace(strip(text), r"^```(?:json)?|```$", ""))


def is_educational(query: Column, words_: list[str] = EDUCATIONAL_JSON) -> Column:
    return has_any(query, words_)


def difficulty(query: Column) -> Column:
    return F.when(has_any(query, BASIC_WORDS), "basic").when(has_any(query, ADVANCED_WORDS), "advanced").otherwise("intermediate")


def font_flags(flags: Column, font: Column) -> Column:
    """struct(bold, italic) from flag bits 4 and 1, or the font's name."""
    return F.struct(
        ((flags.bitwiseAND(F.lit(16)) != 0) | has_any(font, BOLD_FONTS)).alias("bold"),
        ((flags.bitwiseAND(F.lit(2)) != 0) | has_any(font, ITALIC_FONTS)).alias("italic"),
    )


def page_header(text: Column, size: Column, bold: Column, median: Column) -> Column:
    """Chapter or section by font size against the median (3-200 characters), else by pattern, else null."""
    length = F.length(strip(text))
    by_size = F.when(size >= 1.5 * median, "chapter").when((size >= 1.2 * median) | (bold & (size > median)), "section")
    by_text = F.when(text.rlike(r"^(?i)(?:chapter|ch\.?)\s*\d+[:\-\s]*.+?$"), "chapter").when(text.rlike(r"^\d+(?:\.\d+)+[:\-\s]+.+?$"), "section")
    return F.when(length.between(3, 200), F.coalesce(by_size, by_text))
