"""Batched retrieval: filtered vector top-k, intent order, reranking, feedback, thresholds, answers.

Queries come as a frame and are answered together. Queries and chunks are dealt to a grid of blocks, and a
block of queries meets a block of chunks in numpy products; only the k best of each block go on to the global ranking, so the shuffle
carries k rows for a query and block, not one for a query and chunk.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from ..session import materialise, ship_package

#: Queries and chunks of a block, on average: no task holds all of either side.
QUERY_BLOCK, CHUNK_BLOCK = 1024, 8192
#: Decimals of a score; ranks are decided on rounded scores, so every engine agrees on ties.
DIGITS = 6


def _matrices(ids: pa.ChunkedArray, vectors: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors by vector length."""
    own, lists = ids.to_numpy(), vectors.combine_chunks()
    own = own.astype(str) if own.dtype == object else own  # sorts by code points, as Spark does
    offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
    lengths, out = np.diff(offsets), {}
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        out[int(d)] = own[rows], flat[offsets[:-1][rows][:, None] + np.arange(d)[None, :]].reshape(len(rows), d)
    return out


def best_of_block(k: int, exclude_self: bool, text_ids: bool = False):
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.string() if text_ids else pa.int64()), ("score", pa.float64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        chunks = _matrices(right["id"], right["v"]) if left.num_rows and right.num_rows else {}
        for d, (q_ids, queries) in (_matrices(left["query_id"], left["q"]) if chunks else {}).items():
            if d not in chunks:
                continue
            ids, matrix = chunks[d]
            norms = np.linalg.norm(matrix, axis=1)
            for start in range(0, len(q_ids), 128):
                part = queries[start : start + 128]
                bottom = np.linalg.norm(part, axis=1)[:, None] * norms[None, :]
                with np.errstate(divide="ignore", invalid="ignore"):
                    scores = np.where(bottom > 0, part @ matrix.T / bottom, 0.0)
                scores = np.round(np.nan_to_num(scores), DIGITS)
                for q, row in zip(q_ids[start : start + 128], scores):
                    own = np.flatnonzero(ids != q) if exclude_self else np.arange(len(ids))
                    if len(own) > k:
                        own = own[row[own] >= np.partition(row[own], len(own) - k)[len(own) - k]]
                    best = own[np.lexsort((ids[own], -row[own]))[:k]]
                    found.append((np.full(len(best), q), ids[best], row[best]))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.empty(0)] * 3
        return pa.table([pa.array(c.astype(t.to_pandas_dtype())) for c, t in zip(columns, schema.types)], schema=schema)

    return run


def one_per_id(chunks: DataFrame) -> DataFrame:
    """Rows with an id and a vector, one for each id: the least by all columns that can be ordered."""
    rows = chunks.where(F.col("id").isNotNull() & F.col("embedding").isNotNull())
    n, ids = rows.agg(F.count("*"), F.count_distinct("id")).first()
    if n == ids:
        return rows  # the usual case: nothing to reduce, no payload to shuffle
    plain = [F.col(f"`{f.name}`") for f in rows.schema.fields if f.name not in ("id", "embedding") and not isinstance(f.dataType, MapType)]
    others = F.struct(*[F.col(f"`{f.name}`") for f in rows.schema.fields if f.name != "id"])
    picked = rows.groupBy("id").agg(F.min_by(others, F.struct(F.col("embedding"), *plain)).alias("_row"))
    return picked.select("id", "_row.*").select(*rows.columns)


def _best(queries: DataFrame, n_queries: int, chunks: DataFrame, n_chunks: int, k: int, exclude_self: bool) -> DataFrame:
    """(query_id, id, score, rank) of the k best chunks (id, v) of each query (query_id, q), block by block."""
    kind = "string" if dict(chunks.dtypes)["id"] == "string" else "long"
    q_lanes, c_lanes = max(1, math.ceil(n_queries / QUERY_BLOCK)), max(1, math.ceil(n_chunks / CHUNK_BLOCK))
    lane = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("ql", lane("query_id", q_lanes)).withColumn("cl", every(c_lanes))
    right = chunks.withColumn("cl", lane("id", c_lanes)).withColumn("ql", every(q_lanes))
    partial = left.groupBy("ql", "cl").cogroup(right.groupBy("ql", "cl")).applyInArrow(best_of_block(k, exclude_self, kind == "string"), f"query_id long, id {kind}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _nearest(queries: DataFrame, chunks: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    """What ``_best`` returns; where most vectors of a side repeat, each is compared once.

    Equal vectors have equal scores. Those of chunks are stood for by their least id and bring the least k of their ids back,
    which are all that can be among a query's k best; those of queries share their hits. Where a query's own id takes no
    part, one hit more is sought and its own left out.
    """
    counted = lambda rows, v: rows.agg(F.count("*"), F.approx_count_distinct(F.xxhash64(v))).first()
    (n_queries, q_kinds), (n_chunks, c_kinds) = counted(queries, "q"), counted(chunks, "v")
    if 2 * c_kinds > n_chunks and 2 * q_kinds > n_queries:
        return _best(queries, n_queries, chunks, n_chunks, k, exclude_self)
    wide = k + 1 if exclude_self else k
    same = Window.partitionBy("v").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = chunks.withColumns({"_n": F.row_number().over(same), "head": F.first("id").over(same)}).where(F.col("_n") <= wide)
    near = materialise(near.select("head", "id", F.when(F.col("_n") == 1, F.col("v")).alias("v")), "nearest")
    heads = near.where("v IS NOT NULL").select("id", "v")
    asked = materialise(queries.groupBy("q").agg(F.min("query_id").alias("query_id")).select("query_id", "q"), "asked")
    found = _best(asked, asked.count(), heads, heads.count(), wide, False).select(F.col("query_id").alias("asked"), F.col("id").alias("head"), "score")
    first = Window.partitionBy("asked").orderBy(F.desc("score"), "id")
    found = found.join(near.select("head", "id"), "head").withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= wide)
    members = queries.join(asked.select("q", F.col("query_id").alias("asked")), "q").select("query_id", "asked")
    hits = members.join(found, "asked")
    if exclude_self and dict(chunks.dtypes)["id"] != "string":
        hits = hits.where(F.col("id") != F.col("query_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return hits.select("query_id", "id", "score", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)


def vector_topk(
    chunks: DataFrame,
    queries: DataFrame,
    k: int = 5,
    where: Column | None = None,
    filter_mode: str = "pre",
    exclude_self: bool = False,
) -> DataFrame:
    """The k most similar chunks of each query: (query_id, rank, chunk columns without the vector, score).

    ``chunks`` has id (a number or a string) and embedding, ``queries`` query_id and embedding; both are dealt to a
    grid of bounded blocks, so neither is bounded in number. Vectors meet vectors of their own length.
    Of chunks that share an id one takes part, the least by its columns, so no id fills two places.
    ``where`` filters chunks: with mode ``pre`` before the search, with ``post`` the k hits (may leave
    fewer). Scores are cosines rounded to 6 decimals, ties go to the smaller id.
    """
    pool = one_per_id(chunks.where(where) if where is not None and filter_mode == "pre" else chunks)
    kind = "string" if dict(pool.dtypes)["id"] == "string" else "long"
    side = lambda df, name, vector, kind: df.where(F.col(name).isNotNull() & F.col("embedding").isNotNull()).select(
        F.col(name).cast(kind).alias(name), F.col("embedding").cast("array<double>").alias(vector)
    )
    left, right = side(queries, "query_id", "q", "long"), side(pool, "id", "v", kind)
    ship_package(pool.sparkSession)
    ranked = _nearest(side(queries, "query_id", "q", "long"), side(pool, "id", "v", kind), k, exclude_self)
    payload = pool.drop("embedding")
    if payload.columns != ["id"]:
        ranked = ranked.join(payload, "id")
    if where is not None and filter_mode == "post":
        ranked = ranked.where(where)
    return ranked


def threshold(hits: DataFrame, least: float = 0.4) -> DataFrame:
    """Hits whose score reaches the relevance threshold; a missing score counts as 0."""
    return hits.where(F.coalesce(F.col("score"), F.lit(0.0)) >= least)


def graph_score(score: Column) -> Column:
    """V3: a cosine as the graph store's score, (1 + s) / 2 to 6 decimals; halves of the scaled value go up."""
    scale = F.lit(10.0**DIGITS)
    return F.floor((1 + score) / 2 * scale + 0.5) / scale


def intent_partition(hits: DataFrame, wanted: Column, limit: int | None = None) -> DataFrame:
    """Hits of the wanted type first, else in the order of ``rank``: a new column ``position``."""
    order = Window.partitionBy("query_id").orderBy(F.when(wanted, 0).otherwise(1), "rank")
    out = hits.withColumn("position", F.row_number().over(order))
    return out if limit is None else out.where(F.col("position") <= limit)


def rerank(hits: DataFrame, scorer: Callable[[Column, Column], Column] | None, query: str = "query", text: str = "text", k: int = 5) -> DataFrame:
    """V6/L1: hits with rerank_score and new ranks, best k of each query; ties keep the input order.

    ``scorer`` maps the query's and the hit's text columns to a double (a pandas UDF around a model fits).
    Without one the first k stay in order and rerank_score is the original score.
    """
    k = k or 5
    score = F.col("score") if scorer is None else scorer(F.col(query), F.col(text))
    scored = hits.withColumn("rerank_score", score)
    by = [F.col("rank")] if scorer is None else [F.desc_nulls_last("rerank_score"), F.col("rank")]
    placed = scored.withColumn("_place", F.row_number().over(Window.partitionBy("query_id").orderBy(*by)))
    return placed.where(F.col("_place") <= k).drop("rank").withColumnRenamed("_place", "rank")


def word_overlap(query: Column, text: Column) -> Column:
    """The deterministic stand-in for a cross-encoder: share of the query's words that the text has."""
    q = F.array_distinct(F.filter(F.split(F.lower(query), r"\W+"), lambda w: w != ""))
    t = F.split(F.lower(text), r"\W+")
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, t)) / F.size(q))


def feedback_scores(feedback: DataFrame) -> DataFrame:
    """A5: (doc_id, feedback_score) = (p + 1) / (n + 2) over rows (doc_ids array, label 0/1)."""
    seen = feedback.select(F.explode(F.array_distinct("doc_ids")).alias("doc_id"), "label")
    positive = F.sum((F.coalesce("label", F.lit(0)) == 1).cast("int"))
    return seen.groupBy("doc_id").agg(((positive + 1) / (F.count("*") + 2)).alias("feedback_score"))


def feedback_stats(feedback: DataFrame) -> DataFrame:
    """Totals, positive share and collections of the feedback log."""
    positive = F.count_if(F.col("label") == 1)
    return feedback.agg(
        F.count("*").alias("total"), positive.alias("positive"), (F.count("*") - positive).alias("negative"),
        F.when(F.count("*") > 0, positive / F.count("*")).otherwise(0.0).alias("positive_ratio"), F.count_distinct("collection").alias("collections"),
    )


def _like(least: float):
    schema = pa.schema([("query_id", pa.int64()), ("feedback_id", pa.int64()), ("similarity", pa.float64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        chunks = _matrices(right["feedback_id"], right["v"]) if left.num_rows and right.num_rows else {}
        for d, (q_ids, queries) in (_matrices(left["query_id"], left["q"]) if chunks else {}).items():
            if d not in chunks:
                continue
            ids, matrix = chunks[d]
            norms = np.linalg.norm(matrix, axis=1)
            for start in range(0, len(q_ids), 128):
                part = queries[start : start + 128]
                bottom = np.linalg.norm(part, axis=1)[:, None] * norms[None, :]
                with np.errstate(divide="ignore", invalid="ignore"):
                    scores = np.round(np.nan_to_num(np.where(bottom > 0, part @ matrix.T / bottom, 0.0)), DIGITS)
                q, f = np.nonzero(scores >= least)
                found.append((q_ids[start : start + 128][q], ids[f], scores[q, f]))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.empty(0)] * 3
        return pa.table([pa.array(c.astype(t.to_pandas_dtype())) for c, t in zip(columns, schema.types)], schema=schema)

    return run


#: Pivots at most, and vectors that they are chosen from.
PIVOTS, PIVOT_SAMPLE = 64, 2048
#: What rounded scores and angles may be off by.
SLACK = 2e-6


def choose_pivots(rows: DataFrame, vector: str, n: int) -> np.ndarray:
    """At most ``n`` unit vectors that lie far apart, from a bounded sample of the commonest length of ``vector``."""
    sample = [r[0] for r in rows.orderBy(F.xxhash64(vector)).limit(PIVOT_SAMPLE).select(vector).collect()]
    sizes = [len(v) for v in sample]
    dim = max(set(sizes), key=sizes.count, default=0)
    units = np.array([v for v in sample if len(v) == dim], np.float64).reshape(-1, dim)
    norms = np.linalg.norm(units, axis=1)
    units = units[np.isfinite(norms) & (norms > 0)]
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    chosen, nearest = [0] if len(units) else [], np.full(len(units), -2.0)
    while 0 < len(chosen) < min(n, len(units)):
        nearest = np.maximum(nearest, units @ units[chosen[-1]])
        if nearest.min() >= 1 - SLACK:
            break
        chosen.append(int(np.argmin(nearest)))
    return units[chosen]


def _angles(vector: str, pivots: np.ndarray):
    """Adds the nearest pivot and the angle to every pivot; -1 and null for a vector without a direction or of another length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            regions, angles = [], []
            for v in batch[vector]:
                v = np.array(v.as_py(), np.float64)
                norm = np.linalg.norm(v)
                if len(v) != pivots.shape[1] or not len(pivots) or not np.isfinite(norm) or not norm > 0:
                    regions.append(-1)
                    angles.append(None)
                    continue
                own = np.arccos(np.clip(pivots @ (v / norm), -1.0, 1.0))
                regions.append(int(np.argmin(own)))
                angles.append(own.tolist())
            columns = [*batch.columns, pa.array(regions, pa.int32()), pa.array(angles, pa.list_(pa.float64()))]
            yield pa.record_batch(columns, names=[*batch.schema.names, "region", "angles"])

    return run


def _blocks(rows: DataFrame, name: str, vector: str, size: int, pivots: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """Rows with their ``block`` of about ``size`` rows of one collection and region, and blocks with bounds of their angles."""
    named = rows.mapInArrow(_angles(vector, pivots), f"collection {dict(rows.dtypes)['collection']}, {name} long, {vector} array<double>, region int, angles array<double>")
    named = materialise(named, f"blocks_{vector}")
    lanes = named.groupBy("collection", "region").agg(F.ceil(F.count("*") / F.lit(size)).alias("lanes"))
    named = named.join(lanes, ["collection", "region"])
    named = named.withColumn("block", F.concat_ws("_", "region", F.pmod(F.xxhash64(name), F.col("lanes"))))
    # Angles are combined before the shuffle: it carries a row for each block, pivot and task.
    seen = named.select("collection", "block", F.posexplode("angles").alias("pivot", "angle")).groupBy("collection", "block", "pivot")
    bounds = seen.agg(F.min("angle").alias("low"), F.max("angle").alias("high")).groupBy("collection", "block")  # PIVOTS at most of a block
    bounds = bounds.agg(F.array_sort(F.collect_list(F.struct("pivot", "low", "high"))).alias("bounds"))
    blocks = named.select("collection", "block").distinct().join(bounds, ["collection", "block"], "left")
    return named.select("collection", "block", name, vector), blocks


def meeting(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """Pairs of blocks (collection, q_block, f_block, meets): false where no two vectors of them can be as similar as ``least``.

    Angles obey the triangle inequality: two vectors are at least as far apart as their angles to any pivot differ. Zero vectors
    and such of other lengths have no bounds and meet everything.
    """
    limit = math.acos(min(1.0, max(-1.0, least - SLACK))) + SLACK
    pairs = left.select("collection", F.col("block").alias("q_block"), F.col("bounds").alias("q")).join(
        right.select("collection", F.col("block").alias("f_block"), F.col("bounds").alias("f")), "collection"
    )
    apart = F.zip_with("q", "f", lambda a, b: F.greatest(a["low"] - b["high"], b["low"] - a["high"]))
    far = F.exists(apart, lambda x: x > limit)
    return pairs.select("collection", "q_block", "f_block", (~F.coalesce(far, F.lit(False))).alias("meets"))


def similar_feedback(feedback: DataFrame, query: DataFrame, least: float = 0.8, query_block: int = QUERY_BLOCK, chunk_block: int = CHUNK_BLOCK) -> DataFrame:
    """V4: (query_id, feedback_id, similarity, rank) of feedback of the query's collection whose vector is similar enough.

    ``query`` holds (query_id, collection, q_vec), ``feedback`` (feedback_id, collection, q_vec). A collection's rows are dealt
    by their nearest pivot, and within it by hash, to blocks of bounded size on either side, so a collection with a third
    of all rows fits many tasks; blocks that ``meeting`` finds too far apart never meet, and only pairs above the limit
    leave the others. Null collections and vectors match nothing.
    """
    found, _ = similar_and_blocks(feedback, query, least, query_block, chunk_block)
    return found


def similar_and_blocks(feedback: DataFrame, query: DataFrame, least: float = 0.8, query_block: int = QUERY_BLOCK, chunk_block: int = CHUNK_BLOCK) -> tuple[DataFrame, DataFrame]:
    """What ``similar_feedback`` returns, and its pairs of blocks, met or skipped."""
    side = lambda df, name, vector: df.where(F.col("collection").isNotNull() & F.col("q_vec").isNotNull()).select(
        "collection", F.col(name).cast("long").alias(name), F.col("q_vec").cast("array<double>").alias(vector)
    )
    left, right = side(query, "query_id", "q"), side(feedback, "feedback_id", "v")
    ship_package(left.sparkSession)
    # One collection as large as a block needs no pivot; a larger one gets a region for each block it fills.
    fullest = right.groupBy("collection").count().agg(F.max("count")).first()[0] or 0
    wanted = min(PIVOTS, math.ceil(fullest / chunk_block))
    pivots = choose_pivots(right, "v", wanted) if wanted > 1 else np.empty((0, 0))
    left, q_blocks = _blocks(left, "query_id", "q", query_block, pivots)
    right, f_blocks = _blocks(right, "feedback_id", "v", chunk_block, pivots)
    pairs = materialise(meeting(q_blocks, f_blocks, least), "block_pairs")
    met = pairs.where("meets").select("collection", "q_block", "f_block")
    left = left.withColumnRenamed("block", "q_block").join(met, ["collection", "q_block"])
    right = right.withColumnRenamed("block", "f_block").join(met, ["collection", "f_block"])
    keys = ["collection", "q_block", "f_block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_like(least), "query_id long, feedback_id long, similarity double")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "feedback_id")
    return found.withColumn("rank", F.row_number().over(order)), pairs


def blend(hits: DataFrame, scores: DataFrame, key: str = "file_id") -> DataFrame:
    """final_score = 0.45 original + 0.35 rerank + 0.20 feedback (0.5 if unknown), new ranks."""
    joined = hits.join(scores.withColumnRenamed("doc_id", key), key, "left")
    joined = joined.withColumn("feedback_score", F.coalesce("feedback_score", F.lit(0.5)))
    final = 0.45 * F.col("score") + 0.35 * F.coalesce("rerank_score", "score") + 0.20 * F.col("feedback_score")
    joined = joined.withColumn("final_score", F.round(final, DIGITS))
    order = Window.partitionBy("query_id").orderBy(F.desc("final_score"), "rank")
    return joined.withColumn("_place", F.row_number().over(order)).drop("rank").withColumnRenamed("_place", "rank")


def dedupe(hits: DataFrame, text: str = "text", limit: int | None = 5) -> DataFrame:
    """The first hit of each text by rank, then the first ``limit`` of each query; ranks are closed up."""
    first = Window.partitionBy("query_id", text).orderBy("rank")
    kept = hits.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    placed = kept.withColumn("_place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    placed = placed if limit is None else placed.where(F.col("_place") <= limit)
    return placed.drop("rank").withColumnRenamed("_place", "rank")


def confidence(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """A4: (query_id, confidence): the best score, 0 for a query without hits."""
    best = hits.groupBy("query_id").agg(F.max("score").alias("best"))
    return queries.select("query_id").join(best, "query_id", "left").select("query_id", F.coalesce("best", F.lit(0.0)).alias("confidence"))


def latest_fallback(primary: DataFrame, queries: DataFrame, chunks: DataFrame, limit: int = 5, score: float = 0.95) -> DataFrame:
    """L3/L4: for queries without hits, the newest chunks of their collection with a constant score.

    ``queries`` has (query_id, collection_id; null: none wanted), ``chunks`` (collection_id, id, indexed_at);
    chunks without a time come first, as in the graph store's descending order.
    """
    empty = queries.where("collection_id IS NOT NULL").join(primary.select("query_id").distinct(), "query_id", "left_anti")
    newest = Window.partitionBy("collection_id").orderBy(F.desc_nulls_first("indexed_at"), "id")
    pool = chunks.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= limit)
    extra = empty.join(pool, "collection_id").select("query_id", "rank", "id", F.lit(score).alias("score"), F.lit(True).alias("fallback"))
    return primary.select("query_id", "rank", "id", "score", F.lit(False).alias("fallback")).unionByName(extra)


NOT_FOUND, CORRUPTED = "Context not found", "Context corrupted"


def respond(hits: DataFrame, queries: DataFrame, answer: Callable[[Column, Column], Column] | None = None, least: float = 0.4) -> DataFrame:
    """One row per query: prompt context, answer, confidence, relevance and number of chunks.

    Hits carry query_id, rank, score, text, chunk_type. Image texts are tagged. Without relevant hits the
    answer is NOT_FOUND, with none of valid text CORRUPTED; else ``answer(query, context)``, by default
    the first chunk's text.
    """
    from ..functions.text import is_valid

    relevant = threshold(hits, least)
    counted = relevant.groupBy("query_id").agg(F.count("*").alias("n_relevant"), F.max("score").alias("best"))
    usable = dedupe(relevant.where(is_valid(F.col("text"))), "text", 5)
    tagged = F.when(F.col("chunk_type") == "image", F.concat(F.lit("[Image Content]: "), F.col("text"))).otherwise(F.col("text"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", tagged.alias("text"))))  # at most 5 of a query
    context = usable.groupBy("query_id").agg(F.transform(ordered, lambda x: x["text"]).alias("chunks"))
    out = queries.join(counted, "query_id", "left").join(context, "query_id", "left")
    n = F.coalesce(F.size("chunks"), F.lit(0))
    n = F.when(F.col("chunks").isNull(), 0).otherwise(n)
    prompt = F.array_join("chunks", "\n\n")
    said = F.col("chunks")[0] if answer is None else answer(F.col("query"), prompt)
    return out.select(
        "query_id", F.when(F.col("n_relevant").isNull(), NOT_FOUND).when(n == 0, CORRUPTED).otherwise(said).alias("answer"),
        F.when(n > 0, F.col("best")).otherwise(0.0).alias("confidence"), (n > 0).alias("is_relevant"), n.cast("long").alias("n_chunks"), F.coalesce(prompt, F.lit("")).alias("context"),
    )
