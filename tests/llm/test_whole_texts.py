"""Cuts that a review found: each test fails on the code that had the cut."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.llm import iblt, pii


def test_an_edit_spares_the_paragraphs_before_it(spark):
    """A line of 32 words is more than one paragraph, so an edit of its end doesn't make it wholly unlike."""
    words = [f"word{i:02d}" for i in range(32)]
    rows = [(" ".join(words), " ".join([*words[:-1], "other"]))]
    df = spark.createDataFrame(rows, "a string, b string").select(F.size(F.array_intersect(iblt.digests(F.col("a")), iblt.digests(F.col("b")))).alias("n"))
    assert df.first().n > 0


def test_usual_shapes_of_unseen_identifiers_are_found(spark):
    seeds = "Phone: +1 555 010 {0}\n+1 555 020 {0}\nplease call +1 555 030 {0}\n%s +1 555 040 {0}" % ("w" * 300)
    new = ["Phone: 0301234567", "Phone: (030) 123 456", "030 1234567", "please call 555 123 4567.", "w" * 300 + " 555.123.4568"]
    rows = [(i, seeds.format(1000 + i)) for i in range(60)] + [(100 + i, "x\n" + t) for i, t in enumerate(new)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    text = dict(rows)
    got = {r.doc_id: [text[r.doc_id][s.start : s.end] for s in r.found] for r in pii.find(docs).collect() if r.doc_id >= 100}
    assert [got[100 + i] for i in range(5)] == [["0301234567"], ["(030) 123 456"], ["030 1234567"], ["555 123 4567"], ["555.123.4568"]]


def test_mentions_of_long_words_are_linear():
    for text in ("a" * 200_000, "a@" * 100_000, "1 " * 100_000, "1-" * 100_000 + "x", "(" * 200_000 + "1", "a@b.c," * 30_000):
        pii.mentions(text, pii.base_spans(text))
