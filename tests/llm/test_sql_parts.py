"""Parts of the queries that SQL can express, against DuckDB; fingerprints against a plain restatement."""

from __future__ import annotations

import os
import struct

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from lexloom.llm import iblt, urlrules
from lexloom.llm.queries import QUERIES

SF = os.environ.get("LEXLOOM_TEST_SF", "/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@needs_tables
def test_given_rules_equal_sql(spark):
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}')"
    ordered = sorted(urlrules.RULES, key=lambda r: -len(r[0]))
    case = " ".join(f"WHEN {fits(*r.split('/', 1))} THEN '{r}'" for r, _ in ordered)
    sql = f"""WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM '{SF}/pages.parquet'),
    h AS (SELECT page_id, lower(regexp_extract(rest, '^[^/?#]*')) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)
    SELECT page_id, host, path, CASE {case} END AS rule FROM h"""
    found = QUERIES["op3_url_rules"](spark, SF).collect()
    assert sorted((r.page_id, r.host, r.path, r.rule or "") for r in found) == sorted((i, h, p, r or "") for i, h, p, r in duckdb.sql(sql).fetchall())
    verdicts = dict(urlrules.RULES)
    assert all(r.verdict == verdicts[r.rule] for r in found if r.rule) and {r.verdict for r in found} <= {"allow", "block"}


@needs_tables
def test_edited_digests_equal_sql(spark):
    sql = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM '{SF}/documents.parquet'), n AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id), (SELECT arg_min(text, doc_id) FROM d)) AS next FROM d),
    c AS (SELECT *, floor(length(text) / 4)::INTEGER AS k FROM n)
    SELECT doc_id, length(text)::BIGINT, sha256(substr(text, 1, length(text) - k) || substr(next, 1, k)) FROM c"""
    found = QUERIES["op8_iblt_fingerprints"](spark, SF).select("doc_id", "n_chars", "edited_sha256").collect()
    assert sorted(map(tuple, found)) == sorted(duckdb.sql(sql).fetchall())


@needs_tables
def test_ip_counts_equal_sql(spark):
    sql = f"""SELECT doc_id, len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)'), lambda m: len(list_filter(string_split(m, '.'), lambda p: try_cast(p AS HUGEINT) <= 255)) = 4)) AS n_ip,
    len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+')) AS n_email FROM '{SF}/documents.parquet'"""
    found = QUERIES["op6_pii"](spark, SF).select("doc_id", "n_ip", "n_email").collect()
    assert sorted(map(tuple, found)) == sorted(duckdb.sql(sql).fetchall())


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def _hash(*values: int | str | tuple) -> int:
    """Spark's xxhash64 of longs, ints (as 1-tuples) and strings one after another."""
    seed = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else struct.pack("<i", v[0]) if isinstance(v, tuple) else struct.pack("<q", v)
        seed = xxhash.xxh64_intdigest(raw, seed)
    return _signed(seed)


def _paragraphs(text: str) -> list[str]:
    out = []
    for line in text.split("\n"):
        words = line.split()
        # A paragraph keeps the spaces between its words.
        at = 0
        for start in range(0, len(words), iblt.WORDS):
            part = words[start : start + iblt.WORDS]
            begin = line.index(part[0], at)
            at = begin
            for w in part:
                at = line.index(w, at) + len(w)
            out.append(line[begin:at])
    return out


def _table(text: str) -> str:
    digests = list(dict.fromkeys(_hash(p) for p in _paragraphs(text)))
    cells = [[0, 0, 0] for _ in range(iblt.PARTS * iblt.BASE)]
    for d in digests:
        for part in range(iblt.PARTS):
            cell = cells[_hash(d, (part,), (iblt.BASE,)) % iblt.BASE + part * iblt.BASE]
            cell[0] += 1
            cell[1] ^= d
            cell[2] ^= _hash(d, (7,))
    text = lambda n: format(n & ((1 << 64) - 1), "X")
    return "-".join(":".join(map(text, c)) for c in cells) + f"-{len(digests)}"


def test_fingerprints_equal_a_plain_restatement(spark):
    texts = ["", "one", " ".join(f"w{i}" for i in range(50)), "a  b\tc\n\nd e\n" * 3, "é ☃ 日本\n" + "x" * 5000, "same line\nsame line\nother"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    found = {r.i: r.f for r in rows.select("i", iblt.fingerprint(iblt.digests(F.col("text"))).alias("f")).collect()}
    assert found == {i: _table(t) for i, t in enumerate(texts)}


@needs_tables
def test_neighbours_of_a_table_do_not_depend_on_the_ranges(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    digests = [sorted(map(tuple, iblt.neighbours(documents, size).select("doc_id", F.md5("text"), F.md5("next_text")).collect())) for size in (100, iblt.RANGE)]
    assert digests[0] == digests[1]
