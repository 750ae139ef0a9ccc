"""The thirteen queries of this subpackage, and SQL for those that DuckDB can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, collocations, golden, iblt, langid, lattice, mixing, packing, pii, probminhash, quality, urlrules, vafile
from .common import arrow_rows, fold, table


def op1_vafile_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_rows(spark, 10_000)
    vectors = table(spark, sf_dir, "embeddings")
    found = vafile.top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_rows(spark, 1000)
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.classify(documents, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "confidence")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_rows(spark, 1000)
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.identify(documents.select("doc_id", "text"), langid.train(documents))
    return found.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_rows(spark, 10_000)
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    turns = chat.canonical_turns(chat.conversation_records(rows))
    return chat.read_back(chat.format_turns(turns))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_rows(spark, 1000)
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [pii.count_of(F.col("base"), k).alias(f"n_{k}") for k in pii.KINDS]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(pii.joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        pii.joined(pii.all_spans()).alias("spans"),
        F.size("keys").cast("long").alias("n_keys"),
        F.size("found").cast("long").alias("n_found"),
        F.size(pii.all_spans()).cast("long").alias("n_spans"),
    )


def op7_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "tokens", "epoch")


def op8_iblt_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.compare(table(spark, sf_dir, "documents"))


def op9_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_rows(spark, 1000)
    return probminhash.classes(table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_rows(spark, 500)
    encoded = lattice.encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "round_trip")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def op12_golden_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = golden.survivors(table(spark, sf_dir, "clients"))
    cents = F.floor(F.lit(100.0) * F.col("balance") + F.lit(0.5)).cast("long").alias("balance_cents")
    return found.select(
        "cluster_id", "n_records", "n_stale", "name", "email", "segment", "city", "nation_id", cents, "name_from", "email_from", "segment_from", "balance_from", "address_from"
    )


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenise(table(spark, sf_dir, "documents"))
    placed = packing.place(pieces)
    # Only digests of the ids meet their places; pack() joins the ids themselves.
    digests = pieces.select("key", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return digests.join(placed, "key").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES = {f.__name__: f for f in (op1_vafile_topk, op2_quality_classifier, op3_url_rules, op4_language_id, op5_chat_format, op6_pii, op7_temperature_mix, op8_iblt_fingerprints, op9_probminhash, op10_sentencepiece, op11_collocations, op12_golden_record, op13_best_fit_packing)}

ORACLE_SQL = {
    "op1_vafile_topk": """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0
)
SELECT query_id, row_number() OVER w::INTEGER AS rank, vec_id, coalesce(score, 0) AS score
FROM scored WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 20""",
    "op5_chat_format": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(x) + length(regexp_replace(x, '[^\\]', '', 'g'))
    + len(regexp_extract_all(replace(x, '\', '\\'), '<\|(?:turn|text|end|im_start|im_end|endoftext)\|>|</?s>|\[/?INST\]|<</?SYS>>')) AS size
  FROM (SELECT *, role || chr(1) || text AS x FROM c)
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(size - 1 + 23)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""",
    "op11_collocations": r"""
WITH piece AS (
  SELECT lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM (SELECT coalesce(lang, 'und') AS lang, coalesce(text, '') AS text FROM documents)
), words AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM piece
), gram AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words), (VALUES (1), (2), (3), (4)) AS s(k) WHERE i + k - 1 <= len(w)
), f AS (
  SELECT lang, k, phrase, count(*)::BIGINT AS a FROM gram GROUP BY ALL HAVING count(*) >= 30
), total AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang
), part AS (
  SELECT *, string_split(phrase, ' ') AS w FROM f
), ends AS (
  SELECT lang, phrase, a, c, array_to_string(w[1 : c], ' ') AS head, array_to_string(w[c + 1 :], ' ') AS tail
  FROM (SELECT lang, phrase, a, w, unnest(range(1, k)) AS c FROM part WHERE k > 1)
), cut AS (
  SELECT e.lang, e.phrase, e.a, e.c, l.a AS l, r.a AS r, ((2000000::HUGEINT * e.a) // (l.a::HUGEINT + r.a))::BIGINT AS score
  FROM ends e JOIN f l ON l.lang = e.lang AND l.phrase = e.head JOIN f r ON r.lang = e.lang AND r.phrase = e.tail
), best AS (
  SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
), covered AS (
  SELECT DISTINCT s.lang, s.phrase
  FROM f s JOIN (
    SELECT lang, a, array_to_string(w[i : i + m - 1], ' ') AS phrase
    FROM (SELECT lang, a, w, k, unnest(range(1, k)) AS i FROM part WHERE k > 2), (VALUES (2), (3)) AS s(m) WHERE m < k AND i + m - 1 <= k
  ) b ON s.lang = b.lang AND s.phrase = b.phrase AND 100 * b.a >= 80 * s.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best JOIN total USING (lang) ANTI JOIN covered USING (lang, phrase)
QUALIFY rank <= 2000""",
    "op12_golden_record": r"""
WITH r AS (
  SELECT coalesce(master_id, client_id) AS cluster_id, client_id, updated_at, nation_id, balance,
    CASE WHEN regexp_matches(name, '[^\x20\x09-\x0D]') THEN name END AS name, CASE WHEN regexp_matches(email, '[^\x20\x09-\x0D]') THEN email END AS email,
    CASE WHEN regexp_matches(city, '[^\x20\x09-\x0D]') THEN city END AS city, CASE WHEN regexp_matches(segment, '[^\x20\x09-\x0D]') THEN segment END AS segment,
    CASE source WHEN 'crm' THEN 0 WHEN 'web' THEN 1 WHEN 'store' THEN 2 WHEN 'partner' THEN 3 ELSE 4 END AS trust,
    max(updated_at) OVER (PARTITION BY coalesce(master_id, client_id)) AS latest
  FROM clients
), recent AS (
  SELECT *, updated_at IS NULL OR updated_at < latest - INTERVAL 1440 HOURS AS stale,
    row_number() OVER (PARTITION BY cluster_id ORDER BY updated_at DESC NULLS LAST, trust, client_id NULLS LAST) AS by_recent
  FROM r
), trusted AS (
  SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY stale, trust, by_recent) AS by_trust FROM recent
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY length(name) DESC NULLS LAST, by_trust) AS by_name,
    row_number() OVER (PARTITION BY cluster_id ORDER BY (city IS NOT NULL)::INT + (nation_id IS NOT NULL)::INT DESC, by_trust) AS by_address,
    first_value(segment) OVER (PARTITION BY cluster_id ORDER BY segment IS NULL, by_recent) AS chosen
  FROM trusted
), last AS (
  SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY balance IS NULL, segment IS DISTINCT FROM chosen, by_recent) AS by_balance FROM ranked
)
SELECT cluster_id, count(*)::BIGINT AS n_records, count(*) FILTER (stale)::BIGINT AS n_stale,
  max(name) FILTER (by_name = 1) AS name, arg_min(email, by_trust) FILTER (email IS NOT NULL) AS email, max(chosen) AS segment,
  max(city) FILTER (by_address = 1) AS city, max(nation_id) FILTER (by_address = 1) AS nation_id,
  floor(100.0::DOUBLE * max(balance) FILTER (by_balance = 1) + 0.5::DOUBLE)::BIGINT AS balance_cents,
  max(client_id) FILTER (by_name = 1 AND name IS NOT NULL) AS name_from, arg_min(client_id, by_trust) FILTER (email IS NOT NULL) AS email_from,
  arg_min(client_id, by_recent) FILTER (segment IS NOT NULL) AS segment_from, max(client_id) FILTER (by_balance = 1 AND balance IS NOT NULL) AS balance_from,
  max(client_id) FILTER (by_address = 1 AND (city IS NOT NULL OR nation_id IS NOT NULL)) AS address_from
FROM last GROUP BY cluster_id""",
}
