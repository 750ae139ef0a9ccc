"""From raw documents to token ids: quality filter, near-duplicate removal, redaction, mixing, encoding.

All stages read documents (doc_id, text, lang, source, n_chars); other columns, whatever their names, are ignored. A null
text counts as an empty one and stays null while its row stays; null ids, languages and sources are values of their
own. Whole texts are used, however long. Rows that are equal in every column are each processed. An empty table
gives an empty result in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import lattice, mixing, pii, probminhash, quality
from lexloom.llm.common import arrow_rows, discard, materialise, table

#: Quality score from which a document stays, and how often a source may be repeated at most.
THRESHOLD, REPEATS = 0.3, 1.25
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject: score >= THRESHOLD, so a score at the threshold stays.

    Empty and null texts all have the score of the model's bias. Without labels every score is 0.5 and all stay.
    """
    arrow_rows(spark, 1000)
    scored = quality.classify(docs.select(COLUMNS), table(spark, sf_dir, "labels"), THRESHOLD)
    return scored.where("predicted = 1").select(COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the least doc_id (of its rows, see keep_one, one). Rows without an id stay.

    Null, empty and blank texts are one class. Repeated rows are copies, so one of them stays.
    """
    arrow_rows(spark, 1000)
    return probminhash.keep_one(docs.select(COLUMNS)).select(COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, personal data replaced by its kind in brackets; n_chars is the new length where something was replaced.

    Overlapping spans become one, of the kind that starts first (of equal starts the shorter, then the first by name).
    """
    arrow_rows(spark, 1000)
    return pii.redact(docs.select(COLUMNS), pii.find(docs)).select(COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture draws them; sources meet their target weights.

    A null source is one source. Ties in the order of a permutation go to the smaller id. Documents without tokens come with
    every whole pass of their source; a table without any tokens is drawn once as it is.
    """
    drawn = mixing.mix(docs, repeats=REPEATS).groupBy("doc_id", "key").agg(F.count("*").cast("int").alias("copies"))
    # Repeated rows of one id and text were drawn one by one; each of the rows takes its share.
    docs = docs.select(*COLUMNS, F.xxhash64("text").alias("key"))
    rows = docs.groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(F.count("*").alias("rows"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))  # a null id is an id of its own
    share = drawn.join(rows, same).select("_id", "_key", F.ceil(F.col("copies") / F.col("rows")).cast("int").alias("times"))
    found = docs.join(share, same)
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select(COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's piece ids (doc_id, lang, source, n_pieces, ids, round_trip); texts without characters have none."""
    arrow_rows(spark, 500)
    encoded = lattice.encode(docs.select("doc_id", "text", "lang", "source"))
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_pieces"), "ids", "round_trip")


STAGES = [
    ("quality classifier", quality_stage),
    ("near-duplicate removal", near_dedup_stage),
    ("personal data", pii_stage),
    ("source mixing", mixing_stage),
    ("sentencepiece encoding", encoding_stage),
]
#: Training, verification and the bisected exponent can't be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        given, docs = docs, materialise(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        if i:
            discard(given)  # the stage before wrote it, and nothing reads it any more
    return STAGES[-1][1](spark, docs, sf_dir)
