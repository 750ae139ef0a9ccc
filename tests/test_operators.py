"""Folds and structure against plain restatements and literal cases."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from lexloom.functions import text as tx
from lexloom.functions.vector import cosine, unit
from lexloom.operators import chunking, legal, media, retrieve

TEXT = "Aa bb cc. Dd ee ff! Gg hh? Ii jj kk ll."


@pytest.mark.parametrize(
    ("size", "overlap", "expected"),
    [
        (20, 2, ["Aa bb cc. Dd ee ff!", "ee ff! Gg hh?", "Gg hh? Ii jj kk ll."]),
        (20, 9, ["Aa bb cc. Dd ee ff!", "Aa bb cc. Dd ee ff! Gg hh?", TEXT]),
    ],
)
def test_packing_cases(size, overlap, expected):
    assert list(chunking.pack(TEXT, size, overlap)) == expected


def test_packing_of_odd_texts(spark):
    rows = [(1, None), (2, " \n "), (3, "no stop at all"), (4, "x" * 100_000), (5, TEXT)]
    got = chunking.chunk_text(spark.createDataFrame(rows, "id int, text string")).collect()
    assert [(r.id, r.chunk_num, r.chunk) for r in got] == [(3, 1, "no stop at all"), (4, 1, "x" * 100_000), (5, 1, TEXT)]


def test_sections_number_through_the_document(spark):
    rows = [(1, "whole", [("A", "One."), ("B", "  "), ("C", "Two.")]), (2, "whole text", []), (3, "all blank", [("A", " ")]), (4, "t", None)]
    df = spark.createDataFrame(rows, "id int, text string, sections array<struct<title:string,text:string>>")
    got = chunking.chunk_sections(df, "id").orderBy("id", "chunk_num").collect()
    assert [(r.id, r.chunk_num, r.section_title, r.chunk) for r in got] == [
        (1, 1, "A", "One."), (1, 2, "C", "Two."), (2, 1, "Content Part 1", "whole text"), (3, 1, "Content Part 1", "all blank"), (4, 1, "Content Part 1", "t"),
    ]


def test_split_points():
    assert chunking.split_points([0.9, 0.1, 0.9, 0.9], [50] * 5, 0.5, 60, 1000) == [0, 2]
    assert chunking.split_points([0.1, 0.1, 0.1], [100] * 4, 0.5, 150, 1000) == [0, 1, 2]
    assert chunking.split_points([], [10], 0.5, 5, 10) == [0]
    long = chunking.split_points([0.9] * 9, [100] * 10, 0.5, 50, 250)
    assert long[0] == 0 and all(b > a for a, b in zip(long, long[1:]))


def _one(spark, column, **values):
    names = ", ".join(f"{k} {'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], names).select(column.alias("x")).first().x


def test_text_cases(spark):
    headers = {"Example 5.1": "example", "Sample Problem": "example", "Exercise 5.3": "question", "Practice Problems": "question", "5.4 Newton's Law": "concept", "Introduction": "concept"}
    for h, kind in headers.items():
        assert _one(spark, tx.chunk_type(F.col("h")), h=h) == kind
    assert _one(spark, tx.key_terms(F.col("t")), t='See "net force" and The Second Law by Isaac Newton. Isaac Newton') == ["net force", "The Second Law", "Isaac Newton"]
    assert _one(spark, tx.equations(F.col("t")), t="F = ma\nplain\n  x=1  \n" + "y = " + "z" * 100) == ["F = ma", "x=1"]
    assert _one(spark, tx.timestamp(F.col("s")), s=59.9) == "00:59" and _one(spark, tx.timestamp(F.col("s")), s=3600.0) == "01:00:00"
    assert _one(spark, tx.intent(F.col("q")), q="What is an example of force?") == "concept"
    info = _one(spark, tx.chapter_info(F.col("t")), t="x\nCHAPTER 5: Force and Motion - I\n")
    assert (info.number, info.title) == (5, "Force and Motion - I")
    assert _one(spark, tx.case_citations(F.col("t")), t="in Ram Lal v. State (1994) it") == ["in Ram Lal v. State (1994)"]
    assert _one(spark, tx.font_flags(F.col("f"), F.col("n")), f=16, n="Times").bold and _one(spark, tx.font_flags(F.col("f"), F.col("n")), f=0, n="Arial-Oblique").italic


def test_cosine_cases(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([1.0, 1.0], [2.0, 2.0]), ([1.0], [1.0, 2.0]), (None, [1.0])], "a array<double>, b array<double>")
    assert [round(r.x, 9) for r in df.select(cosine(F.col("a"), F.col("b")).alias("x")).collect()] == [0, 1, 0, 0]
    assert df.limit(1).select(unit(F.col("b")).alias("x")).first().x == [0.0, 0.0]


def test_feedback_cases(spark):
    df = spark.createDataFrame([(["a"], 1), (["b"], 0), (["b", "b"], 1)], "doc_ids array<string>, label int")
    got = {r.doc_id: r.feedback_score for r in retrieve.feedback_scores(df).collect()}
    assert got["a"] == pytest.approx(2 / 3) and got["b"] == 0.5
    hits = spark.createDataFrame([(1, 1, "z", 0.8, 0.8)], "query_id int, rank int, file_id string, score double, rerank_score double")
    assert retrieve.blend(hits, retrieve.feedback_scores(df)).first().final_score == pytest.approx(0.74)


def test_top_k_is_monotone_and_filters_differ(spark):
    rng = random.Random(0)
    rows = [(i, [rng.random() for _ in range(4)], i % 3) for i in range(200)]
    chunks = spark.createDataFrame([*rows, (900, None, 0), (901, [1.0], 0)], "id long, embedding array<float>, label int")
    queries = chunks.where("id < 5").select(F.col("id").alias("query_id"), "embedding")
    ids = lambda df: {(r.query_id, r.id) for r in df.collect()}
    three, five = ids(retrieve.vector_topk(chunks, queries, 3)), ids(retrieve.vector_topk(chunks, queries, 5))
    assert three < five and len(five) == 25
    post = ids(retrieve.vector_topk(chunks, queries, 5, F.col("label") == 1, "post"))
    pre = ids(retrieve.vector_topk(chunks, queries, 5, F.col("label") == 1, "pre"))
    assert post <= pre and len(pre) == 25


ACT = """THE SAMPLE CODE ACT, 1999
NO. 14 OF 1999
WHEREAS it is good to test
CHAPTER I
FIRST THINGS
1. Short title.
CHAPTER II
MAIN MATTERS
2. Definitions.
(a) "board" means the Board; (b) "fee" means money paid;
Provided that a fee is due under section 9.
1. Ins. by Act 5 of 2001
3. Penalty for delay.
Imprisonment for a term which may extend to two years, or with fine of rupees 500.
CHAPTER III
4. Appeal procedure.
(1) File it. (a) in form (i) one (ii) two (b) in time (2) Wait within 30 days.
4. Duplicate header.
THE FIRST SCHEDULE
forms
SECOND SCHEDULE
fees"""


def test_structure_of_a_statute(spark):
    docs = spark.createDataFrame([(1, ACT)], "doc_id long, text string")
    lines = legal.to_lines(docs)
    assert legal.content_start(lines).first().start == 6
    chapters, sections = legal.chapters_and_sections(lines)
    assert [(r.number, r.title, r.section_numbers) for r in chapters.orderBy("pos").collect()] == [("II", "MAIN MATTERS", ["2", "3"]), ("III", "", ["4"])]
    got = {r.number: r for r in sections.collect()}
    assert list(got) and set(got) == {"2", "3", "4"} and got["2"].has_proviso and "Ins. by" not in got["2"].content and got["4"].chapter_number == "III"
    meta = docs.select(legal.act_metadata(F.col("text"), F.lit("x.pdf")).alias("m")).first().m
    assert (meta.name, meta.year, meta.act_number) == ("Sample Code", 1999, "No. 14 of 1999")
    assert legal.preamble(lines).first().preamble == "WHEREAS it is good to test"
    assert [(r.number, r.content) for r in legal.schedules(docs).orderBy("pos").collect()] == [("FIRST", "THE FIRST SCHEDULE\nforms"), ("SECOND", "SECOND SCHEDULE\nfees")]
    tree = sections.where("number = '4'").select(legal.subsection_tree(F.col("content")).alias("t")).first().t
    assert [(s.number, [c.number for c in s.clauses]) for s in tree] == [("1", ["a", "i", "ii", "b"]), ("2", [])]
    found = {(r.type, r.value) for r in legal.penalties(sections).collect()}
    assert ("imprisonment", "two years") in found and ("fine", "500") in found
    assert {(r.term, r.definition) for r in legal.definitions(sections).where("section <> 'inline'").collect()} == {("board", "the Board"), ("fee", "money paid")}
    refs = legal.cross_references(sections).collect()
    assert [(r.number, r.target) for r in refs] == [("2", "9")] and "section 9" in refs[0].context
    assert legal.invalid_references(legal.cross_references(sections), sections).count() == 1
    p = legal.procedures(sections).first()
    assert p.timeline == "30 days" and p.section == "4"


def test_authorities_restated(spark):
    text = "The Central Board of Taxes shall decide. The High Court may hear; State Water Board has power."
    rows = legal.authorities(spark.createDataFrame([(1, 0, "5", "T", text)], "doc_id long, pos int, number string, title string, content string")).collect()
    names = {r.name: r for r in rows}
    assert names["High Court"].type == "court" and names["High Court"].section == "5"
    assert "Central Board" in {n.split(" Of")[0] for n in names} or any(n.startswith("Central") for n in names)


def test_validation_and_lookup(spark):
    v = _one(spark, legal.validate_act(F.col("n"), F.lit(1700), F.array(F.lit("1"), F.lit("1")), F.array(F.lit(""), F.lit("x"))), n="")
    assert v.errors == ["missing name"] and v.warnings == ["unlikely year", "many empty sections", "duplicate section numbers"]
    assert [_one(spark, legal.part_of(F.col("n")), n=n) for n in (51, 238, 21)] == ["IV", None, "III"]
    order = spark.createDataFrame([("10",), ("2",), ("10A",)], "n string").orderBy(legal.section_order(F.col("n")))
    assert [r.n for r in order.collect()] == ["2", "10", "10A"]


def test_segments_and_pages(spark):
    rows = [("v", float(i), d, t) for i, (d, t) in enumerate([(100.0, "a"), (10.0, "b"), (50.0, "c"), (40.0, "d"), (1.0, "e")])]
    got = media.transcript_segments(spark.createDataFrame(rows, "video_id string, start double, duration double, text string")).collect()
    assert [(r.segment, r.text, r.timestamp) for r in got] == [(1, "a b", "00:00"), (2, "c d", "00:02"), (3, "e", "00:04")]
    html = "<title>T &amp; U</title><script>var a='<p>no</p>'</script><h1>A</h1><p>x<h2>B</h2><p>y</p><h3>C</h3><ul><li>z</li></ul><!-- <p>c</p> -->"
    meta, sections = media.page_sections(html)
    assert meta["title"] == "T & U" and sections == [(3, "C", "x\ny\nz")]
    assert media.page_sections("<p>one<p>two")[1] == [(1, "Article Content", "one\ntwo")] and media.page_sections("")[1] == []
    assert media.page_sections("<h1>A</h1><p>x</p><h1>B</h1><p>y</p>")[1] == [(1, "A", "x"), (1, "B", "y")]


def test_upper_median(spark):
    df = spark.createDataFrame([(x,) for x in (1, 2, 3, 4)], "x int")
    assert [r.median for r in media.upper_median(df.withColumn("g", F.lit(1)), ["g"], F.col("x")).collect()] == [3]


def test_semantic_chunks_restated(spark):
    text = "Cats purr softly today. Cats purr softly again. Trains run very late now. Trains run very late often. Ok."
    got = chunking.semantic_chunks(spark.createDataFrame([(1, text), (2, "One lone sentence here."), (3, None)], "id int, text string"), 0.5, 30, 500).collect()
    assert [(r.id, r.n_sentences) for r in got] == [(1, 2), (1, 2), (2, 1)]
    assert re.match("Cats.*again\\.$", got[0].chunk)


def test_main_content_is_the_densest_container():
    html = '<html><body><nav><p>menu menu menu menu menu menu menu menu menu menu menu</p></nav><div class="ad"><p>buy</p></div><article><h1>T</h1><p>Long text of the page. <a href="x">link</a><p>More text.</p><ul><li>one</li></ul></article><footer><p>foot</p></footer></body>'
    meta, _ = media.page_sections(html)
    assert meta["main_text"] == "T\nLong text of the page. link\nMore text.\none"
    assert media.page_sections("<p>only</p> words")[0]["main_text"] == "only" and media.page_sections("")[0]["main_text"] == ""


def test_model_calls_keep_their_errors(spark):
    from lexloom.operators import layout, models

    files = spark.createDataFrame([("a.pdf", bytearray(b"1|Head|20|16\n1|body|10|0")), ("b.pdf", bytearray(b"?"))], "path string, content binary")

    def extract(content: bytes):
        for i, line in enumerate(content.decode().split("\n")):
            page, text, size, flags = line.split("|")
            yield int(page), 0.0, float(i), text, float(size), int(flags), "Serif"

    spans = {(r.path, r.text): r for r in layout.pdf_spans(files, extract).collect()}
    assert spans["a.pdf", "Head"].bold and not spans["a.pdf", "body"].bold and spans["b.pdf", None].error.startswith("ValueError")
    tries = []
    out = {r.path: r for r in models.call(files, lambda c: tries.append(1) or (1 / 0 if c == b"?" else " "), ["content"]).collect()}
    assert out["b.pdf"].status == "FAILED" and "ZeroDivisionError" in out["b.pdf"].error and out["a.pdf"].status == "EMPTY"
    found = {r.path: r.text for r in models.first_page_texts(files.withColumn("native", F.lit("short")), lambda c: "o" * 600, native="native").collect()}
    assert found == {"a.pdf": "o" * 600, "b.pdf": "o" * 600}
    assert models.critic(spark.createDataFrame([("q", "c", "a")], "query string, context string, answer string"), None).first().critic is None


def test_transcripts_fall_back_to_the_model(spark):
    from lexloom.operators import models

    videos = spark.createDataFrame([("v",), ("w",), ("x",)], "video_id string")
    entries = spark.createDataFrame([("v", 0.0, 100.0, "a"), ("v", 1.0, 5.0, "b"), ("x", 0.0, 1.0, " "), ("other", 0.0, 1.0, "c")], "video_id string, start double, duration double, text string")
    rows = {(r.video_id, r.origin): r.text for r in models.transcripts(videos, entries, lambda v: f"about {v}").collect()}
    assert rows == {("v", "transcript"): "a b", ("w", "model"): "about w", ("x", "model"): "about x"}


def test_extracted_acts_are_grouped(spark):
    from lexloom.operators import models

    docs = spark.createDataFrame([(1, "x"), (2, "bad")], "doc_id long, text string")
    said = '{"metadata": {"act_name": "A"}, "sections": [{"number": "1", "chapter": "II"}, {"number": "2", "chapter": "I"}, {"number": "3", "chapter": "II"}, {"number": "4"}]}'
    rows = {r.doc_id: r for r in models.extract_acts(docs, lambda t: said if t == "x" else "no json").collect()}
    assert [(c.number, list(c.sections)) for c in rows[1].chapters] == [("II", ["1", "3"]), ("I", ["2"])] and rows[1].metadata.act_name == "A"
    assert not rows[2].chapters
    flagged = models.worth_extracting(spark.createDataFrame([("Penalty", "fine of 5"), ("Words", "x means y")], "title string, content string")).collect()
    assert [(r.ask_penalties, r.ask_definitions) for r in flagged] == [(True, False), (False, True)]


def test_image_embeddings_have_a_status(spark):
    from lexloom.operators import ingest

    images = spark.createDataFrame([("a", bytearray(b"xyz")), ("b", bytearray(b"")), ("c", None)], "path string, content binary")
    rows = {r.path: (r.status, list(r.embedding)) for r in ingest.embed_with_status(images, lambda b: [float(len(b)), 1.0], 2, column="content").collect()}
    assert rows == {"a": ("SUCCESS", [3.0, 1.0]), "b": ("EMPTY", [0.0, 0.0]), "c": ("EMPTY", [0.0, 0.0])}


def test_files_and_traces(spark, tmp_path):
    from lexloom import session
    from lexloom.sources import readers

    files = readers.Files(spark, f"file://{tmp_path}")
    files.write("local://a/b.bin", b"x" * 20_000)
    assert files.exists("a/b.bin") and files.size("a/b.bin") == 20_000 and [len(b) for b in files.blocks("a/b.bin")] == [8192, 8192, 3616]
    assert files.read("local://a/b.bin") == b"x" * 20_000 and files.delete("a/b.bin") and not files.exists("a/b.bin")
    with pytest.raises(ValueError):
        files.write("../up", b"")
    with session.traced(spark, "t1", "u1") as trace:
        assert trace == "t1" and {"trace-t1", "user-u1"} <= set(spark.getTags())
    assert not spark.getTags()


def test_store_errors_and_indexes(spark, tmp_path):
    from lexloom.operators import store

    assert store.store_error(409, "x").status == 409 and isinstance(store.store_error(None, "Index required but not found for field"), (store.IndexRequired, store.CollectionMissing))
    s = store.CollectionStore(spark, f"file://{tmp_path}/db")
    with pytest.raises(store.CollectionMissing):
        s.ensure_indexes("none")
    s.create("c", spark.createDataFrame([], "collection_id string, file_id string").schema)
    assert s.ensure_indexes("c") == ["collection_id", "file_id"]
    s.append("c", spark.createDataFrame([("a b/c", "f"), (None, "g")], "collection_id string, file_id string"))
    s.delete("c", file_id="f")
    assert [r.file_id for r in s.read("c").collect()] == ["g"]


def test_semantic_documents_keep_every_section(spark):
    from lexloom.operators import layout

    text = " ".join(f"The river number {i} runs along the hills and towns." for i in range(30))
    rows = [(1, 0, "Example", text, 1), (1, 1, "Short", "x" * 60, 2), (1, 2, "Tiny", "x", 3)]
    found = layout.semantic_documents(spark.createDataFrame(rows, "doc long, section_pos int, title string, text string, page_number int"), "doc").collect()
    base = {r.base_chunk_id for r in found}
    assert base == {"1_chunk_1", "1_chunk_2"} and all(r.chunk_id.startswith(r.base_chunk_id + "_semantic_") for r in found)
    assert [r.chunk for r in found if r.base_chunk_id == "1_chunk_2"] == ["x" * 60]
