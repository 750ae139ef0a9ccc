"""Retrieval queries over embeddings, documents, labels and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ann, retrieve
from ..session import scratch
from .book import Book, table

book = Book()

#: Every query's cosine with every vector, rounded, ranked with ties to the smaller id.
_SCORED = """v AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
s AS (SELECT q.id AS query_id, c.id, c.label, round(list_cosine_similarity(q.e, c.e), 6) AS score FROM v q JOIN v c ON {on} WHERE q.id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM s)"""
_ALL, _OTHERS, _LABELS = _SCORED.format(on="true"), _SCORED.format(on="q.id <> c.id"), _SCORED.format(on="c.label IN (1, 2, 3)")


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    return rows, rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding")


@book.query(f"WITH {_ALL} SELECT query_id, rank, id, label, score FROM r WHERE rank <= 5")
def vector_topk(spark, sf_dir):
    return retrieve.vector_topk(*_vectors(spark, sf_dir), 5)


def _indexed(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    vectors, queries = _vectors(spark, sf_dir)
    path = scratch(spark, "inverted_file")
    ann.build(vectors, path)
    return path, queries


@book.query()
def ann_topk(spark, sf_dir):
    """Top 5 in the probed lists of an index over all vectors; a test measures the recall against vector_topk."""
    path, queries = _indexed(spark, sf_dir)
    return ann.search(spark, path, queries, 5).select("query_id", "rank", "id", "label", "score")


@book.query(f"WITH {_ALL} SELECT query_id, rank, id, label, score FROM r WHERE rank <= 5")
def ann_exact(spark, sf_dir):
    """The same index with its exact switch."""
    path, queries = _indexed(spark, sf_dir)
    return ann.search(spark, path, queries, 5, exact=True).select("query_id", "rank", "id", "label", "score")


@book.query(f"WITH {_LABELS} SELECT query_id, rank, id, label, score FROM r WHERE rank <= 5")
def ann_every_list(spark, sf_dir):
    """All lists probed, rows filtered before the search: nothing can be missed."""
    path, queries = _indexed(spark, sf_dir)
    return ann.search(spark, path, queries, 5, probes=ann.MAX_LISTS, where=F.col("label").isin(1, 2, 3)).select("query_id", "rank", "id", "label", "score")


@book.query(f"WITH {_LABELS} SELECT query_id, rank, id, label, score FROM r WHERE rank <= 5")
def vector_topk_prefilter(spark, sf_dir):
    return retrieve.vector_topk(*_vectors(spark, sf_dir), 5, F.col("label").isin(1, 2, 3), "pre")


@book.query(f"WITH {_ALL} SELECT query_id, rank, id, label, score FROM r WHERE rank <= 5 AND label IN (1, 2, 3)")
def vector_topk_postfilter(spark, sf_dir):
    return retrieve.vector_topk(*_vectors(spark, sf_dir), 5, F.col("label").isin(1, 2, 3), "post")


@book.query(f"WITH {_OTHERS} SELECT query_id, id, round((1 + score) / 2, 6) AS graph_score FROM r WHERE rank <= 10 AND score >= 0.3")
def vector_threshold(spark, sf_dir):
    hits = retrieve.threshold(retrieve.vector_topk(*_vectors(spark, sf_dir), 10, exclude_self=True), 0.3)
    return hits.select("query_id", "id", retrieve.graph_score(F.col("score")).alias("graph_score"))


@book.query(f"WITH {_OTHERS} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY (label <> 3)::INTEGER, rank)::INTEGER AS position, id, label, score FROM r WHERE rank <= 5 AND score >= 0.2")
def intent_partition(spark, sf_dir):
    """Top 5 of each query without itself, over the threshold, label 3 first."""
    hits = retrieve.threshold(retrieve.vector_topk(*_vectors(spark, sf_dir), 5, exclude_self=True), 0.2)
    return retrieve.intent_partition(hits, F.col("label") == 3).select("query_id", "position", "id", "label", "score")


@book.query(f"WITH {_OTHERS} SELECT q.id AS query_id, coalesce(max(score), 0) AS confidence FROM (SELECT id FROM v WHERE id % 50 = 0) q LEFT JOIN (SELECT * FROM r WHERE rank <= 3 AND score >= 0.36) h ON h.query_id = q.id GROUP BY 1")
def confidence_max(spark, sf_dir):
    vectors, queries = _vectors(spark, sf_dir)
    return retrieve.confidence(retrieve.threshold(retrieve.vector_topk(vectors, queries, 3, exclude_self=True), 0.36), queries)


@book.query(f"""WITH {_OTHERS}, f AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY rank) AS n FROM r WHERE rank <= 20)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank)::INTEGER AS rank, id, label, score FROM f WHERE n = 1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 5""")
def dedupe_first(spark, sf_dir):
    hits = retrieve.vector_topk(*_vectors(spark, sf_dir), 20, exclude_self=True)
    return retrieve.dedupe(hits, "label", 5).select("query_id", "rank", "id", "label", "score")


def _feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as a feedback log: three neighbouring documents a row."""
    ids = F.array(F.col("doc_id"), F.col("doc_id") + 1, F.col("doc_id") + 1, F.col("doc_id") + 2)
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("feedback_id"), ids.alias("doc_ids"), F.col("quality").alias("label"), F.concat(F.lit("c"), (F.col("doc_id") % 7).cast("string")).alias("collection"))


_BAYES = "fb AS (SELECT d AS doc_id, (sum((quality = 1)::INTEGER) + 1) / (count(*) + 2) AS feedback_score FROM (SELECT quality, unnest([doc_id, doc_id + 1, doc_id + 2]) AS d FROM labels) GROUP BY 1)"


@book.query(f"WITH {_BAYES} SELECT doc_id, feedback_score FROM fb")
def feedback_bayes(spark, sf_dir):
    return retrieve.feedback_scores(_feedback(spark, sf_dir))


@book.query("SELECT count(*)::BIGINT AS total, count_if(quality = 1)::BIGINT AS positive, count_if(quality <> 1)::BIGINT AS negative, count_if(quality = 1) / count(*) AS positive_ratio, count(DISTINCT doc_id % 7)::BIGINT AS collections FROM labels")
def feedback_stats(spark, sf_dir):
    return retrieve.feedback_stats(_feedback(spark, sf_dir))


@book.query("""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), s AS (
SELECT q.vec_id AS query_id, f.vec_id AS feedback_id, round(list_cosine_similarity(f.e, q.e), 6) AS similarity FROM v f JOIN v q ON f.label = q.label AND q.vec_id % 50 = 0)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, feedback_id)::INTEGER AS rank FROM s WHERE similarity >= 0.25""")
def feedback_similar(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    feedback = rows.select(F.col("vec_id").alias("feedback_id"), F.col("label").alias("collection"), F.col("embedding").alias("q_vec"))
    query = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("collection"), F.col("embedding").alias("q_vec"))
    return retrieve.similar_feedback(feedback, query, 0.25).select("query_id", "feedback_id", "similarity", "rank")


@book.query(f"""WITH {_OTHERS}, {_BAYES},
rr AS (SELECT r.query_id, r.id, r.score, ((r.id * 7 + r.query_id) % 10) / 10 AS rerank_score, rank FROM r WHERE rank <= 10),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS rr_rank FROM rr QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) <= 5),
f AS (SELECT query_id, id, score, rerank_score, coalesce(feedback_score, 0.5) AS feedback_score, rr_rank,
  round(0.45 * score + 0.35 * rerank_score + 0.20 * coalesce(feedback_score, 0.5), 6) AS final_score FROM top LEFT JOIN fb ON fb.doc_id = top.id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, rr_rank)::INTEGER AS rank, id, final_score FROM f""")
def rerank_blend(spark, sf_dir):
    """Retrieve 10, rerank to 5 by a plugged-in scorer, blend with feedback."""
    hits = retrieve.vector_topk(*_vectors(spark, sf_dir), 10, exclude_self=True)
    top = retrieve.rerank(hits, lambda q, t: ((t * 7 + q) % 10) / 10, "query_id", "id", 5)
    out = retrieve.blend(top, retrieve.feedback_scores(_feedback(spark, sf_dir)), "id")
    return out.select("query_id", "rank", "id", "final_score")


@book.query(f"""WITH {_OTHERS}, h AS (SELECT query_id, rank, id, score FROM r WHERE rank <= 5 AND score >= 0.38),
e AS (SELECT id AS query_id, label FROM v WHERE id % 50 = 0 AND label <> 0 AND id NOT IN (SELECT query_id FROM h)),
p AS (SELECT label, id, row_number() OVER (PARTITION BY label ORDER BY t DESC NULLS FIRST, id)::INTEGER AS rank FROM (SELECT *, CASE WHEN id % 50 <> 7 THEN id % 13 END AS t FROM v))
SELECT query_id, rank, id, score, false AS fallback FROM h UNION ALL SELECT e.query_id, p.rank, p.id, 0.95, true FROM e JOIN p USING (label) WHERE p.rank <= 3""")
def fallback_latest(spark, sf_dir):
    vectors, queries = _vectors(spark, sf_dir)
    hits = retrieve.threshold(retrieve.vector_topk(vectors, queries, 5, exclude_self=True), 0.38)
    asked = vectors.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.when(F.col("label") != 0, F.col("label")).alias("collection_id"))
    chunks = vectors.select("id", F.col("label").alias("collection_id"), F.when(F.col("id") % 50 != 7, F.col("id") % 13).alias("indexed_at"))
    return retrieve.latest_fallback(hits, asked, chunks, 3)


@book.query(f"""WITH {_OTHERS}, h AS (SELECT query_id, rank, id, score, CASE WHEN label = 0 THEN repeat(chr(1), 9) ELSE 'text ' || (id % 40) END AS text, label FROM r WHERE rank <= 6 AND score >= 0.34),
u AS (SELECT *, row_number() OVER (PARTITION BY query_id, text ORDER BY rank) AS n FROM h WHERE label <> 0),
k AS (SELECT query_id, CASE WHEN label = 5 THEN '[Image Content]: ' || text ELSE text END AS text, rank FROM u WHERE n = 1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 5),
c AS (SELECT query_id, first(text ORDER BY rank) AS said, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context, count(*) AS n FROM k GROUP BY 1),
b AS (SELECT query_id, max(score) AS best FROM h GROUP BY 1)
SELECT q.id AS query_id, CASE WHEN best IS NULL THEN 'Context not found' WHEN n IS NULL THEN 'Context corrupted' ELSE said END AS answer, CASE WHEN n > 0 THEN best ELSE 0 END AS confidence,
  coalesce(n, 0) > 0 AS is_relevant, coalesce(n, 0)::BIGINT AS n_chunks, coalesce(context, '') AS context FROM (SELECT id FROM v WHERE id % 50 = 0) q LEFT JOIN b ON b.query_id = q.id LEFT JOIN c ON c.query_id = q.id""")
def query_response(spark, sf_dir):
    vectors, queries = _vectors(spark, sf_dir)
    hits = retrieve.vector_topk(vectors, queries, 6, exclude_self=True)
    hits = hits.withColumns(
        {
            "text": F.when(F.col("label") == 0, F.expr("repeat(chr(1), 9)")).otherwise(F.concat(F.lit("text "), (F.col("id") % 40).cast("string"))),
            "chunk_type": F.when(F.col("label") == 5, "image").otherwise("concept"),
        }
    )
    return retrieve.respond(hits, queries.select("query_id"), least=0.34)


@book.query("""
WITH q AS (SELECT event_id, list_distinct(list_filter(string_split_regex(lower(event_type || ' ' || (event_id % 9)), '\\W+'), lambda w: w <> '')) AS w, string_split_regex(lower(props || ' ' || event_type), '\\W+') AS t FROM events)
SELECT event_id, round(len(list_filter(w, lambda x: list_contains(t, x))) / len(w), 6) AS overlap FROM q""")
def rerank_overlap(spark, sf_dir):
    q = F.concat_ws(" ", "event_type", (F.col("event_id") % 9).cast("string"))
    t = F.concat_ws(" ", "props", "event_type")
    return table(spark, sf_dir, "events").select("event_id", F.round(retrieve.word_overlap(q, t), 6).alias("overlap"))


QUERIES, ORACLE_SQL = book.QUERIES, book.ORACLE_SQL
