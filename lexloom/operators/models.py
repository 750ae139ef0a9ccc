"""Plugged-in models over rows: OCR, vision, parsers, extraction, critics; every call has a status.

A model is a Python callable on one row's values. It runs in Arrow-sized batches on the executors, is tried again
a few times, and a row whose tries all fail carries the error: no call can fail a job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from ..functions import text as tx
from . import legal, media

#: What a critic's answer and a graph of triplets hold.
CRITIC = "struct<confidence:double,missing_info:string,enrichment_suggestions:array<string>>"
TRIPLETS = "struct<nodes:array<struct<id:string,label:string>>,edges:array<struct<source:string,target:string,label:string>>>"
EXTRACTED = (
    "struct<metadata:struct<act_name:string,act_year:int,act_number:string,preamble:string>,sections:array<struct<number:string,title:string,content:string,chapter:string>>,"
    "authorities:array<struct<name:string,type:string>>,penalties:array<struct<section:string,type:string,value:string>>,"
    "definitions:array<struct<term:string,definition:string>>,cross_references:array<struct<section:string,target:string>>>"
)
STYLES = ("detailed", "concise")


def call(rows: DataFrame, model: Callable[..., str | None], inputs: list[str], output: str = "response", tries: int = 3) -> DataFrame:
    """``rows`` with ``output`` (the model's text), status (SUCCESS, EMPTY, FAILED) and error.

    The model gets the input columns by position. Null or blank answers are EMPTY, exceptions after ``tries`` calls FAILED.
    Columns of the same names are replaced.
    """
    keep = rows.drop(output, "status", "error")
    schema = StructType(list(keep.schema.fields)).add(output, StringType()).add("status", StringType()).add("error", StringType())

    def ask(*values) -> tuple[str | None, str, str | None]:
        error = None
        for _ in range(tries):
            try:
                said = model(*values)
                return (said, "SUCCESS", None) if said and said.strip() else (None, "EMPTY", None)
            except Exception as e:  # a model's failure is a row, not a job's end
                error = f"{type(e).__name__}: {e}"
        return None, "FAILED", error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers = [ask(*values) for values in zip(*(batch[c].to_pylist() for c in inputs))]
            added = [pa.array([a[i] for a in answers], pa.string()) for i in range(3)]
            yield pa.record_batch([*(batch[c] for c in batch.schema.names), *added], names=[*batch.schema.names, output, "status", "error"])

    return keep.mapInArrow(run, schema)


def available(model: Callable | None, enabled: bool = True) -> bool:
    """Whether a plug-in is there and switched on."""
    return enabled and callable(model)


def first_page_texts(files: DataFrame, model: Callable[[bytes], str], least: int = 500, native: str | None = None) -> DataFrame:
    """Text of files (path, content) by a plugged-in OCR or cloud parser; a native text that is long enough wins."""
    found = call(files, model, ["content"], "ocr_text")
    texts = [F.col("ocr_text")] if native is None else [F.col(native), F.col("ocr_text")]
    return found.withColumn("text", media.first_usable(texts, least))


def describe_images(images: DataFrame, model: Callable[[bytes], str]) -> DataFrame:
    """Images (path, content) with the vision model's description as ``text``."""
    return call(images, model, ["content"], "text")


def transcripts(videos: DataFrame, entries: DataFrame, model: Callable[[str], str] | None = None) -> DataFrame:
    """Segments of videos that have a transcript; others one segment by the plugged-in model, if there is one.

    ``videos`` has video_id, ``entries`` (video_id, start, duration, text).
    """
    columns = ["video_id", "segment", "start", "text", "n_entries"]
    found = media.transcript_segments(entries.join(videos.select("video_id").distinct(), "video_id", "left_semi")).select(*columns)
    if model is None:
        return found.withColumn("origin", F.lit("transcript"))
    missing = videos.select("video_id").distinct().join(entries.where(F.length(tx.strip(F.col("text"))) > 0), "video_id", "left_anti")
    said = call(missing, model, ["video_id"], "text").where("status = 'SUCCESS'")
    other = said.select("video_id", F.lit(1).alias("segment"), F.lit(0.0).alias("start"), "text", F.lit(1).alias("n_entries"))
    return found.withColumn("origin", F.lit("transcript")).unionByName(other.withColumn("origin", F.lit("model")))


def answer_prompt(query: Column, context: Column, style: str = "detailed") -> Column:
    """What an answering model is asked; null for a blank context, which is answered without a model."""
    if style not in STYLES:
        raise ValueError(f"unknown style {style!r}; one of {STYLES}")
    parts = [F.lit("Answer from the context alone; cite its sections."), F.concat(F.lit("Context:\n"), context), F.concat(F.lit("Question: "), query), F.lit(f"Style: {style}")]
    return F.when(F.length(tx.strip(F.coalesce(context, F.lit("")))) > 0, F.array_join(F.array(*parts), "\n\n"))


def answer_kind(query: Column, force_json: Column | bool | None = None, enabled: bool = False) -> Column:
    """``json`` if wanted (forced, else enabled) and the query is educational, else ``text``."""
    wanted = F.coalesce(force_json if isinstance(force_json, Column) else F.lit(force_json).cast("boolean"), F.lit(enabled))
    return F.when(wanted & tx.is_educational(query), "json").otherwise("text")


def dispatch(rows: DataFrame, text_model: Callable[[str, str], str], json_model: Callable[[str, str], str], force_json: bool | None = None, enabled: bool = False) -> DataFrame:
    """(rows.., kind, answer): every query by the model of its kind; educational JSON is enriched.

    ``rows`` has query and context. A blank context is answered without a model.
    """
    asked = rows.withColumn("kind", answer_kind(F.col("query"), force_json, enabled)).withColumn("blank", F.length(tx.strip(F.coalesce("context", F.lit("")))) == 0)

    def model(kind: str, query: str, context: str) -> str:
        return (json_model if kind == "json" else text_model)(query, context)

    said = call(asked.where("NOT blank"), model, ["kind", "query", "context"], "answer").drop("blank")
    said = media.enrich_questions(said, "answer").withColumn("answer", F.col("enriched")).drop("enriched")
    missing = F.when(F.col("kind") == "json", '{"error": "Context not found"}').otherwise("Context not found")
    blank = asked.where("blank").drop("blank").select("*", missing.alias("answer"), F.lit("SUCCESS").alias("status"), F.lit(None).cast("string").alias("error"))
    return said.unionByName(blank)


def critic(answers: DataFrame, model: Callable[[str, str, str], str] | None, enabled: bool = True) -> DataFrame:
    """``answers`` (query, context, answer) with struct ``critic``; null where the model is off, fails or says no JSON."""
    if not available(model, enabled):
        return answers.withColumn("critic", F.lit(None).cast(CRITIC))
    said = call(answers, model, ["query", "context", "answer"], "_said")
    json = tx.strip_fences(F.col("_said"))
    return said.withColumn("critic", F.when(tx.is_json(json), F.from_json(json, CRITIC))).drop("_said", "status", "error")


def triplets(texts: DataFrame, model: Callable[[str], str], key: str = "chunk_id") -> DataFrame:
    """(key, src, dst, label) of the relations that a model's JSON graph of each text names."""
    said = call(texts.select(key, "text"), model, ["text"], "_said")
    graph = F.from_json(tx.strip_fences(F.col("_said")), TRIPLETS)
    return said.select(key, F.explode(graph["edges"]).alias("e")).select(key, F.col("e.source").alias("src"), F.col("e.target").alias("dst"), F.col("e.label").alias("label")).where("src IS NOT NULL AND dst IS NOT NULL")


def worth_extracting(sections: DataFrame) -> DataFrame:
    """Sections with flags whether a model is to look for authorities, penalties or definitions in them."""
    low = F.lower(F.concat_ws(" ", "title", "content"))
    words = {"authorities": legal.AUTHORITY_TYPES, "penalties": legal.PENALTY_TEXT, "definitions": ["means", "definition"]}
    return sections.withColumns({f"ask_{name}": reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in of]) for name, of in words.items()})


def extract_acts(documents: DataFrame, model: Callable[[str], str]) -> DataFrame:
    """(doc_id, metadata, sections, authorities, penalties, definitions, cross_references, chapters, status, error) by a model.

    The model answers a text with JSON. Sections that name a chapter are grouped into chapters in the order in
    which the chapters come up.
    """
    said = call(documents.select("doc_id", "text"), model, ["text"], "_said")
    parsed = said.withColumn("x", F.from_json(tx.strip_fences(F.col("_said")), EXTRACTED)).select("doc_id", "x.*", "status", "error")
    rows = parsed.select("doc_id", F.posexplode("sections").alias("pos", "s")).select("doc_id", "pos", "s.number", "s.chapter")
    grouped = group_sections(rows).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "number", "title", "sections"))).alias("chapters"))
    return parsed.join(grouped, "doc_id", "left").withColumn("chapters", F.coalesce("chapters", F.array().cast("array<struct<pos:int,number:string,title:string,sections:array<string>>>")))


def group_sections(sections: DataFrame) -> DataFrame:
    """Chapters (doc_id, pos, number, title, sections) of sections (doc_id, pos, number, chapter); a blank chapter groups nothing."""
    named = sections.where(F.coalesce(F.col("chapter"), F.lit("")) != "")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "number"))), lambda x: x["number"])
    return named.groupBy("doc_id", F.col("chapter")).agg(F.min("pos").alias("pos"), listed.alias("sections")).select("doc_id", "pos", F.col("chapter").alias("number"), F.concat(F.lit("CHAPTER "), "chapter").alias("title"), "sections")
