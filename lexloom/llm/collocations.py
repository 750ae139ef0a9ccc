"""Phrase collocations by Apriori level-wise passes.

Level 1 counts the words of each language. Every frequent phrase of a level gets a number, and the corpus is kept as arrays
of those numbers, one for the phrase that starts at each place. A phrase of k words is then a pair of adjacent numbers
of level k - 1: it is emitted only where both of its overlapping subphrases are frequent. So every level is the same
pass: look pairs up in the level's table, keep the runs of frequent ones, count adjacent pairs, keep the frequent.

The table of a level goes to the workers in parts of a bounded size, one pass over the corpus for each part; in most
corpora there is one. Counts are combined in the workers and again before the shuffle, so no phrase is hot. Cuts are
scored from counts that the level tables carry along.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, discard, materialise, numbered, packed

#: Occurrences from which a phrase is frequent, and its words at most.
LEAST, LONGEST = 30, 4
#: A phrase gives way to a longer one that has at least this many hundredths of its occurrences.
COVER = 80
#: Phrases returned for each language.
TOP = 2000
#: Rows and bytes of a level's table that travel to the workers at a time, about: words are in a dictionary there, so twice the rows of pairs take less.
PART_ROWS, PART_BYTES = 1_000_000, 64 << 20
#: Words or pairs that a task counts before it passes the counts on; numbers in a row of the corpus, about. Spark reads
#: thousands of rows at once into memory, so these are short: 4,096 of 8 KB, and as much again where the table has parts.
WORDS_HELD, PAIRS_HELD, ROW = 150_000, 1_500_000, 1 << 10
#: Bytes of a row group of the corpus: a task that writes or reads one holds it in memory.
ROW_GROUP = 16 << 20

_ENDS = b".,;:!?\n\x0b\x0c\r"
#: Each byte of a text: A-Z in lower case, ends of pieces as \n. Other bytes, and so other characters, stay.
_PLAIN = bytes(10 if b in _ENDS else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Stands between pieces; no byte of UTF-8.
_BREAK = b"\xff"


def tokens(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text; _BREAK stands where a piece ends. Splitting bytes at white space leaves only space and tab here."""
    return text.translate(_PLAIN).replace(b"\n", b" \xff ").split()


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    yield from zip(batch["lang"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), strict=True)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n), combined for as many words as a task may hold; a null word has the number of all words."""
    held: dict[str, Counter] = {}
    read = 0

    def taken() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            counts.pop(_BREAK, None)
            counts[None] = counts.total()
            while part := list(islice(counts.items(), 1 << 14)):  # what was sent is let go of
                for word, _ in part:
                    del counts[word]
                words, n = zip(*part, strict=True)
                yield pa.record_batch([pa.array([lang] * len(n), pa.string()), pa.array(words, pa.string()), pa.array(n, pa.int64())], names=["lang", "word", "n"])
        held.clear()

    for batch in batches:
        for lang, text in _rows(batch):
            held.setdefault(lang, Counter()).update(tokens(text))
            read += len(text)
        if sum(map(len, held.values())) >= WORDS_HELD or read >= PART_BYTES:
            yield from taken()
            read = 0
    yield from taken()


def _runs(ids: np.ndarray) -> np.ndarray:
    """Runs of at least two numbers, -1 in front of each; other numbers can't be part of a longer phrase."""
    pair = (ids[:-1] >= 0) & (ids[1:] >= 0)
    keep = np.zeros(len(ids), bool)
    keep[:-1] |= pair
    keep[1:] |= pair
    before = np.zeros(len(ids), bool)
    before[:-1] = keep[1:] & ~keep[:-1]
    return np.where(keep, ids, -1)[keep | before]


def _blobs(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Numbers as int64 bytes in rows that end at ``ends``."""
    offsets = np.concatenate([[0], ends]) * 8
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(ids.astype(np.int64).tobytes())]).cast(pa.binary())


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of int64 bytes, and where its rows end."""
    blobs = column.to_pylist()
    return np.frombuffer(b"".join(blobs), np.int64), np.cumsum([len(b) // 8 for b in blobs], dtype=np.int64)


def _together(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places whose number and the next one are of one row and both frequent."""
    ok = (ids[:-1] >= 0) & (ids[1:] >= 0)
    ok[ends[(ends > 0) & (ends < len(ids))] - 1] = False
    return np.flatnonzero(ok)


def _codes(x: np.ndarray, y: np.ndarray, known: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """A number for each pair, the same for pairs that are equal. Numbers beyond 31 bits are replaced by their places in ``known``; others there have none (-1)."""
    if known is None:
        return (x << 32) | y
    parts, miss = [], np.zeros(len(x), bool)
    for values, of in zip((x, y), known, strict=True):
        at = np.minimum(np.searchsorted(of, values), len(of) - 1)
        miss |= of[at] != values
        parts.append(at)
    return np.where(miss, -1, parts[0] * len(known[1]) + parts[1])


def _wide(*values: np.ndarray) -> bool:
    return any(len(v) and int(v.max()) >> 31 for v in values)


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(x, y, n) of adjacent numbers, combined for as many pairs as a task may hold."""
    small: list[np.ndarray] = []  # codes of pairs of numbers below 31 bits: half the memory
    large: list[tuple[np.ndarray, np.ndarray]] = []

    def sent(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(n), 1 << 18):
            cut = slice(at, at + (1 << 18))
            yield pa.record_batch([pa.array(c[cut], pa.int64()) for c in (x, y, n)], names=["x", "y", "n"])

    def taken() -> Iterator[pa.RecordBatch]:
        if small:
            codes = np.concatenate(small)
            small.clear()
            codes.sort()
            first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
            n, codes = np.diff(np.append(first, len(codes))), codes[first]
            yield from sent(codes >> 32, codes & 0xFFFFFFFF, n)
        if large:
            x, y = (np.concatenate(c) for c in zip(*large, strict=True))
            large.clear()
            _, first, n = np.unique(_codes(x, y, (np.unique(x), np.unique(y))), return_index=True, return_counts=True)
            yield from sent(x[first], y[first], n)

    _word_table.cache_clear()  # workers live on; the tables of the level below aren't needed any more
    _pair_table.cache_clear()
    for batch in batches:
        if batch.num_rows:
            ids, ends = _numbers(batch["ids"])
            at = _together(ids, ends)
            x, y = ids[at], ids[at + 1]
            if _wide(x, y):
                large.append((x, y))
            elif len(at):
                small.append(_codes(x, y))
        if sum(map(len, small)) + sum(2 * len(x) for x, _ in large) >= PAIRS_HELD:
            yield from taken()
    yield from taken()


@lru_cache(maxsize=1)
def _word_table(blob: bytes) -> dict[str, dict[bytes, int]]:
    out: dict[str, dict[bytes, int]] = {}
    for batch in pa.ipc.open_stream(blob):
        for lang, word, i in zip(batch["lang"].to_pylist(), batch["phrase"].cast(pa.binary()).to_pylist(), batch["id"].to_pylist(), strict=True):
            out.setdefault(lang, {})[word] = i
    return out


@lru_cache(maxsize=1)
def _pair_table(blob: bytes) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray] | None]:
    """Sorted codes of pairs, their numbers, and what _codes needs."""
    rows = pa.ipc.open_stream(blob).read_all()
    x, y, ids = (rows[c].to_numpy().astype(np.int64, copy=False) for c in ("x", "y", "id"))
    known = (np.unique(x), np.unique(y)) if _wide(x, y) else None
    codes = _codes(x, y, known)
    if np.all(codes[1:] > codes[:-1]):
        return codes, np.array(ids), known
    order = np.argsort(codes)
    return codes[order], ids[order], known


def _of_words(batch: pa.RecordBatch, blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    table, parts = _word_table(blob), []
    for lang, text in _rows(batch):
        words = tokens(text)
        words.append(_BREAK)
        parts.append(np.fromiter(map(table.get(lang, {}).get, words, repeat(-1)), np.int64, len(words)))
    return np.concatenate(parts), np.cumsum([len(p) for p in parts], dtype=np.int64)


def _of_pairs(batch: pa.RecordBatch, blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    codes, numbers, known = _pair_table(blob)
    ids, ends = _numbers(batch["ids"])
    out, at = np.full(len(ids), -1, np.int64), _together(ids, ends)
    if len(at) and len(codes):
        x, y = ids[at], ids[at + 1]
        if known is None and _wide(x, y):  # a part of small numbers: larger ones aren't in it
            small = (x >> 31 == 0) & (y >> 31 == 0)
            at, x, y = at[small], x[small], y[small]
        asked = _codes(x, y, known)
        place = np.minimum(np.searchsorted(codes, asked), len(codes) - 1)
        out[at] = np.where(codes[place] == asked, numbers[place], -1)
    return out, ends


def _encode(of, sent, first: bool, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, ends = of(batch, sent.value)
            if not first:
                before, _ = _numbers(batch["found"])
                ids = np.where(before >= 0, before, ids)
            if last:
                ids = _runs(ids)
                if len(ids):  # rows are cut in front of runs
                    starts = np.flatnonzero(ids < 0)
                    cuts = starts[np.unique(np.searchsorted(starts, np.arange(ROW, starts[-1] + 1, ROW)))]
                    yield pa.record_batch([_blobs(ids, np.append(cuts, len(ids)))], names=["ids"])
            else:
                kept = [c for c in batch.schema.names if c != "found"]
                yield pa.record_batch([*(batch[c] for c in kept), _blobs(ids, ends)], names=[*kept, "found"])

    return run


def encoded(corpus: DataFrame, level: DataFrame, of, key: list[str]) -> DataFrame:
    """(ids) of a corpus by a level's table, in as many passes as the table has parts."""
    spark = corpus.sparkSession
    size = level.agg(F.count("*").alias("n"), F.sum(sum((F.length(F.col(c).cast("binary")) if c == "phrase" else F.lit(8) for c in key), F.lit(8))).alias("bytes")).first()
    pairs = key == ["x", "y"]
    parts = max(1, math.ceil(size["n"] / (2 * PART_ROWS if pairs else PART_ROWS)), math.ceil((size["bytes"] or 0) / PART_BYTES))
    base = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in corpus.schema.fields)
    for i in range(parts):
        part = level.where(F.pmod(F.xxhash64(*key), F.lit(parts)) == i).select("id", *key).toArrow()  # bounded: see PART_ROWS
        part = part.sort_by([(c, "ascending") for c in key]) if pairs else part  # sorted once, not in every worker
        # In small batches: a worker makes objects of one at a time.
        sent, last = spark.sparkContext.broadcast(packed(pa.Table.from_batches(part.to_batches(1 << 16), part.schema))), i == parts - 1
        del part
        passed = corpus.mapInArrow(_encode(of, sent, i == 0, last), "ids binary" if last else f"{base}, found binary")
        if not last:
            given, corpus = corpus, materialise(passed, f"collocations_part_{i}", ROW_GROUP)
            if i:
                discard(given)
    return passed


def level_tables(documents: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) and the tables of the levels 1, 2, ... (the last may be empty; there are none behind it).

    A table has id, lang, phrase, last (word), a (occurrences), pre and suf (occurrences of its first and last 1, 2, ...
    words, itself included), within (level and id of every phrase of at least two words that it holds).
    """
    spark = documents.sparkSession
    arrow_rows(spark, 1000, 4 << 20)
    texts = documents.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where("text <> ''")
    counted = texts.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = numbered(counted.where(F.col("word").isNull() | (F.col("n") >= least)), "collocations_1", "id")
    totals = counted.where("word IS NULL").select("lang", "n")
    alone = F.array("n")
    none = F.array().cast("array<struct<k:int,id:bigint>>")
    levels = [counted.where("word IS NOT NULL").select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), F.col("n").alias("a"), alone.alias("pre"), alone.alias("suf"), none.alias("within"))]
    corpus, of, key = texts, _of_words, ["lang", "phrase"]
    for k in range(2, longest + 1):
        below = levels[-1]
        # Written at every level: encoding and counting in one stage would take two Python workers a core.
        given, corpus = corpus, materialise(encoded(corpus, below, of, key), f"collocations_corpus_{k - 1}", ROW_GROUP)
        # The workers have combined a task's pairs already, so a second combination before the shuffle would only hold memory.
        pairs = corpus.mapInArrow(_count_pairs, "x long, y long, n long").repartition("x", "y").groupBy("x", "y").agg(F.sum("n").alias("a")).where(F.col("a") >= least)
        x = below.select(F.col("id").alias("x"), "lang", "phrase", "pre", F.col("within").alias("in_x"))
        y = below.select(F.col("id").alias("y"), "last", "suf", F.col("within").alias("in_y"))
        inside = F.array(*[F.struct(F.lit(k - 1).alias("k"), F.col(c).alias("id")) for c in ("x", "y")]) if k > 2 else none
        found = pairs.join(x, "x").join(y, "y").select(
            "x", "y", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "a",
            F.concat("pre", F.array("a")).alias("pre"), F.concat("suf", F.array("a")).alias("suf"), F.concat(inside, "in_x", "in_y").alias("within"),
        )
        levels.append(numbered(found, f"collocations_{k}", "id"))
        if k > 2:
            discard(given)
        if levels[-1].isEmpty():
            break
        of, key = _of_pairs, ["x", "y"]
    return totals, levels


def _score(l: Column, r: Column) -> Column:
    """floor(2000000 * a / (l + r)), in decimals: the product may pass 64 bits."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", F.lit(2_000_000).cast("decimal(7,0)") * wide(F.col("a")), wide(l) + wide(r))


def mine(documents: DataFrame, least: int = LEAST, longest: int = LONGEST, cover: int = COVER, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of 2 to ``longest`` words.

    ``documents`` holds lang and text; other columns are ignored. A null text counts as empty, a null lang as ``und``.
    Repeated rows count one by one. l and r are the occurrences of the two parts of the lowest-scoring cut (of equal scores
    the first). Phrases that hold only infrequent words, and languages without a phrase, have no rows; nor has an empty table.
    """
    spark = documents.sparkSession
    totals, levels = level_tables(documents, least, longest)
    columns = ["id", "lang", "phrase", "a", "pre", "suf", "within"]
    found = [t.select(F.lit(k).alias("k"), *columns) for k, t in enumerate(levels, 1) if k > 1]
    phrases = found[0]
    for t in found[1:]:
        phrases = phrases.unionByName(t)
    longer = phrases.select("a", F.explode("within").alias("in")).groupBy("in.k", "in.id").agg(F.max("a").alias("longer"))
    kept = phrases.join(longer, ["k", "id"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < cover * F.col("a")))

    def cut(i: Column) -> Column:
        l, r = F.element_at("pre", i), F.element_at("suf", F.col("k") - i)
        return F.struct(_score(l, r).alias("score"), i.alias("i"), l.alias("l"), r.alias("r"))

    scored = kept.select("lang", "phrase", "a", F.array_min(F.transform(F.sequence(F.lit(1), F.col("k") - 1), cut)).alias("cut"))
    scored = scored.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    # The first of every lane, then of the language: no task orders all phrases of a language.
    lanes = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    scored = scored.withColumn("lane", F.pmod(F.xxhash64("phrase"), F.lit(lanes)))
    for by in (["lang", "lane"], ["lang"]):
        scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
    return scored.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
