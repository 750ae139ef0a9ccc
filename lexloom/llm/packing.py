"""Packing documents into sequences of a fixed capacity, by bulk-synchronous best fit.

Documents become token ids and an end mark; only those beyond the capacity are cut. Pieces are range-sorted by falling
length and numbered once. Gaps (the free ends of open sequences) are range-sorted by size and numbered in every round.
A round is a successor sweep: from the longest piece down, each takes the smallest gap that holds it, and with it the
pieces that follow, as many as surely fit. Pieces of one length and gaps of one size are told apart by rank alone, so the sweep
decides over at most ``capacity`` sizes which ranks meet, and Spark matches pieces and gaps by rank, wherever they lie.
Then gaps shrink, and the next round sorts them again. Lengths are taken in bands, each down to half of the one above: a band's
rounds end when none of its pieces fits a gap, and what is left opens sequences. A gap that takes pieces is left with less
than it took, so a band needs few rounds, and their number doesn't grow with the input.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch
from .common import arrow_rows, materialise, numbered

TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"
CAPACITY, END_ID = 4096, 1
#: Words a worker keeps with their ids.
CACHE = 400_000

# What the fast path knows of the tokenizer file: fixed values.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORD_END = "</w>"
# End of fixed values.
#: Texts of these characters need no normaliser but lower case; of them, the same words as by _PATTERN.
_simple = re.compile("[\n\t -~À-ÖØ-öø-ÿ]*").fullmatch
_words = re.compile(r"[a-zß-öø-ÿ]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^a-zß-öø-ÿ0-9\s]+").findall


class Encoder:
    """Ids of texts as bytes (little-endian, four an id), equal to the tokenizer's own.

    Words are encoded once and kept. A tokenizer of lower-cased words (the default one) is split into words here, and its
    pair merges run over all new words of a batch at once; every other text or tokenizer goes through the library as it is.
    """

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.whole, self.cache, self.merges = Tokenizer.from_str(file), {}, None
        described = json.loads(file)
        split = (described.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        kinds = [n["type"] for n in (described.get("normalizer") or {}).get("normalizers", [])]
        if described["model"].get("end_of_word_suffix") == _WORD_END and kinds == ["NFC", "Replace", "Lowercase"] and split[0].get("pattern") == {"Regex": _PATTERN}:
            self.special = [t["content"] for t in described.get("added_tokens", [])]
            self._merging(described["model"]["vocab"])

    def _merging(self, vocab: dict[str, int]) -> None:
        """The vocabulary as bytes by rank; a line feed, which no word holds, stands for the end of a word."""
        import tiktoken

        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that the vocabulary writes as themselves
        other = [b for b in range(256) if b not in plain]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
        ranks, ends = {}, np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            end = token.endswith(_WORD_END)
            body = token.removesuffix(_WORD_END)
            if token in self.special or not body or not all(c in byte for c in body):
                continue
            raw = bytes(byte[c] for c in body)
            if b"\n" not in raw or (raw == b"\n" and not end):
                ranks[raw + b"\n" * end] = i
                ends[i] = end
        self.merges, self.ends = tiktoken.Encoding("words", pat_str="[^\n]*\n", mergeable_ranks=ranks, special_tokens={}), ends

    def _learn(self, words: list[str]) -> None:
        ids = np.array(self.merges.encode_ordinary("\n".join(words) + "\n"), "<u4")
        raw, cuts = ids.tobytes(), (np.flatnonzero(self.ends[ids]) * 4 + 4).tolist()
        at = 0
        for word, cut in zip(words, cuts, strict=True):
            self.cache[word] = raw[at:cut]
            at = cut

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, without special tokens around it."""
        easy = [self.merges is not None and _simple(t) is not None and not any(s in t for s in self.special) for t in texts]
        hard = [t for t, e in zip(texts, easy, strict=True) if not e]
        others = iter(self.whole.encode_batch(hard, add_special_tokens=False) if hard else ())
        split = [_words(t.lower()) if e else None for t, e in zip(texts, easy, strict=True)]
        new = {w for words in split if words for w in words if w not in self.cache}
        if len(self.cache) + len(new) > CACHE:
            self.cache = {}
            new = {w for words in split if words for w in words}
        if new:
            self._learn(list(new))
        known = self.cache.__getitem__
        return [np.array(next(others).ids, "<u4").tobytes() if words is None else b"".join(map(known, words)) for words in split]


@lru_cache(maxsize=1)
def _encoder(file: str) -> Encoder:
    return Encoder(file)


def _pieces(sent, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, mark, size = _encoder(sent.value).encode, end_id.to_bytes(4, "little"), 4 * capacity
        for batch in batches:
            at, piece, ids = [], [], []
            for row, raw in enumerate(encode([t or "" for t in batch["text"].to_pylist()])):
                raw += mark
                for n, start in enumerate(range(0, len(raw), size)):
                    at.append(row)
                    piece.append(n)
                    ids.append(raw[start : start + size])
            lengths = pa.array([len(b) // 4 for b in ids], pa.int64())
            starts = pa.array([n * capacity for n in piece], pa.int64())
            yield pa.record_batch([batch["doc_id"].take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), starts, lengths, pa.array(ids, pa.binary())], names=["doc_id", "piece", "start", "length", "ids"])

    return run


def tokenise(documents: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces (key, doc_id, piece, start, length, ids) of every whole document, written once; ids are little-endian, four bytes each.

    A null text counts as empty and is one piece of the end mark. Repeated rows are documents of their own: ``key``
    tells all pieces apart. Columns but doc_id and text are ignored.
    """
    spark = documents.sparkSession
    arrow_rows(spark, 500)
    with open(tokenizer) as f:  # the driver reads the file, workers get it
        sent = spark.sparkContext.broadcast(f.read())
    rows = documents.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    cut = rows.mapInArrow(_pieces(sent, capacity, end_id), f"doc_id {kind}, piece int, start long, length long, ids binary")
    cut = cut.withColumn("key", F.monotonically_increasing_id())
    path = scratch(spark, "pack_pieces")
    cut.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(cut.schema).parquet(path)


class Met(NamedTuple):
    """What a sweep matched, in terms of j: the place of a piece among the band's unplaced ones, by falling length.

    By run: pieces j = first .. first + n - 1 go to gaps from rank ``gap`` on, ``each`` consecutive ones to a gap.
    By length that the band has: the least j (``j``), its rank among all pieces (``rank``), tokens before it (``before``).
    """

    first: np.ndarray
    n: np.ndarray
    each: np.ndarray
    gap: np.ndarray
    size: np.ndarray
    j: np.ndarray
    rank: np.ndarray
    before: np.ndarray

    def tokens_before(self, j: np.ndarray) -> np.ndarray:
        of = np.maximum(np.searchsorted(self.j, j, "right") - 1, 0)
        return self.before[of] + (j - self.j[of]) * self.size[of]


def sweep(left: np.ndarray, at: np.ndarray, low: int, high: int, gaps: np.ndarray, number: int | None = None) -> Met:
    """One successor sweep over the sizes of a band: pieces of high .. low + 1, left[s] of them, the first of rank at[s].

    gaps[g] gaps of size g are ranked by rising size; with ``number`` every piece left opens new sequences, numbered from there on.
    A piece of length s takes the smallest gap of at least s, together with the pieces behind it, as many as surely fit (g // s).
    ``left``, ``at`` and ``gaps`` move on.
    """
    capacity = len(gaps) - 1
    sizes = np.array([s for s in range(high, low, -1) if left[s]], np.int64)
    counts = left[sizes]
    firsts, tokens = np.cumsum(counts) - counts, np.cumsum(counts * sizes) - counts * sizes
    given, ranks, stack, runs, pushed, c, used = gaps.copy(), np.cumsum(gaps) - gaps, [], [], capacity + 1, 0, 0
    starts = at[sizes].copy()
    while c < len(sizes):
        s, rest = int(sizes[c]), int(counts[c]) - used
        if not rest:
            c, used = c + 1, 0
            continue
        for g in range(pushed - 1, s - 1, -1):
            if given[g] and number is None:
                stack.append([g, int(ranks[g]), int(given[g])])  # the smallest gap that holds s is on top
        pushed = min(pushed, s)
        if number is None and not stack:
            c, used = c + 1, 0  # nothing holds them in this sweep
            continue
        g, rank, free = stack[-1] if number is None else (capacity, number, rest)
        each, j = g // s, int(firsts[c]) + used
        if full := min(free, rest // each):
            n, took = full * each, each * s
            left[s] -= n
            at[s] += n
            used += n
        else:  # the last of this length share a gap with longest pieces behind them
            full, n, took = 1, 0, 0
            while n < each and c < len(sizes):
                more = min(each - n, int(counts[c]) - used)
                left[sizes[c]] -= more
                at[sizes[c]] += more
                n, took, used = n + more, took + more * int(sizes[c]), used + more
                if used == counts[c]:
                    c, used = c + 1, 0
            each = n
        runs.append((j, n, each, rank))
        gaps[g - took] += full
        if number is not None:
            number += full
            continue
        gaps[g] -= full
        stack[-1][1:] = rank + full, free - full
        if not stack[-1][2]:
            stack.pop()
    return Met(*np.array(runs, np.int64).reshape(-1, 4).T, sizes, firsts, starts, tokens)


def _deal(met: Met):
    """(key, gap, offset, taken): the gap's rank (or a new sequence's number) of each piece, its place there, and, on a gap's first piece, the tokens it takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_size = np.full(int(met.size.max()) + 1, -1, np.int64)
        of_size[met.size] = np.arange(len(met.size))
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            of = np.where(length < len(of_size), of_size[np.minimum(length, len(of_size) - 1)], -1)
            j = np.where((of >= 0) & (rank >= met.rank[of]), met.j[of] + rank - met.rank[of], -1)
            of = np.maximum(np.searchsorted(met.first, j, "right") - 1, 0)
            i = j - met.first[of]
            here = (j >= 0) & (i >= 0) & (i < met.n[of])
            i, j, of = i[here], j[here], of[here]
            each = met.each[of]
            first = j - i % each
            last = np.minimum(first + each, met.first[of] + met.n[of])
            before = met.tokens_before(first)
            taken = np.where(j == first, met.tokens_before(last) - before, 0)
            columns = [batch["key"].to_numpy()[here], met.gap[of] + i // each, met.tokens_before(j) - before, taken]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["key", "gap", "offset", "taken"])

    return run


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(key, sequence_id, offset) for every row of ``pieces`` (key, length), each of 1 .. capacity tokens; offsets have no holes.

    Keys are distinct. Pieces of one length are dealt by key. No pieces, no rows. The driver holds counts by length and
    by size of gap, at most ``capacity`` of each, whatever the input.
    """
    spark = pieces.sparkSession
    rows = pieces.select("key", F.col("length").cast("long").alias("length"))
    ordered = rows.repartitionByRange(F.col("length").desc(), F.col("key")).sortWithinPartitions(F.col("length").desc(), F.col("key"))
    ordered = numbered(ordered, "pack_order", "rank")
    left = np.zeros(capacity + 1, np.int64)
    for r in ordered.groupBy("length").count().collect():  # a row a length
        left[r["length"]] = r["count"]
    at = np.cumsum(left[::-1])[::-1] - left  # rank of the first piece of each length
    gaps, open_gaps, placed, number, high = np.zeros(capacity + 1, np.int64), None, [], 0, capacity
    while high and left.any():
        low = high // 2
        inside = ordered.where((F.col("length") > low) & (F.col("length") <= high))
        while left[low + 1 : high + 1].any():
            met = sweep(left, at, low, high, gaps)
            if not len(met.n):
                break
            # The order of the sweep: by rising size. Which of equal gaps comes first doesn't matter.
            sized = numbered(open_gaps.repartitionByRange("free", "sequence_id").sortWithinPartitions("free", "sequence_id"), "pack_gaps", "gap")
            dealt = inside.mapInArrow(_deal(met), "key long, gap long, offset long, taken long").join(sized, "gap")
            placed.append(materialise(dealt.select("key", "sequence_id", (F.lit(capacity) - F.col("free") + F.col("offset")).alias("offset"), "taken"), "pack_placed"))
            shrunk = placed[-1].where("taken > 0").select("sequence_id", "taken")
            open_gaps = sized.drop("gap").join(shrunk, "sequence_id", "left").select("sequence_id", (F.col("free") - F.coalesce("taken", F.lit(0))).alias("free"))
            open_gaps, gaps = _usable(open_gaps, gaps, left)
        if left[low + 1 : high + 1].any():
            met = sweep(left, at, low, high, gaps, number)
            number += int(np.sum(-(-met.n // met.each)))
            opened = inside.mapInArrow(_deal(met), "key long, gap long, offset long, taken long").withColumnRenamed("gap", "sequence_id")
            placed.append(materialise(opened, "pack_opened"))
            fresh = placed[-1].where("taken > 0").select("sequence_id", (F.lit(capacity) - F.col("taken")).alias("free"))
            open_gaps, gaps = _usable(fresh if open_gaps is None else open_gaps.unionByName(fresh), gaps, left)
        high = low
    if not placed:
        return spark.createDataFrame([], "key long, sequence_id long, offset long")
    return reduce(DataFrame.unionByName, [t.select("key", "sequence_id", "offset") for t in placed])


def _usable(open_gaps: DataFrame, gaps: np.ndarray, left: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    """Without gaps that no piece left would fit."""
    least = int(np.flatnonzero(left)[0]) if left.any() else len(gaps)
    gaps = gaps.copy()
    gaps[:least] = 0
    return open_gaps.where(F.col("free") >= least), gaps


def pack(documents: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Every piece of ``tokenise`` with its sequence_id and offset there. Rules of odd rows are those of ``tokenise``."""
    pieces = tokenise(documents, tokenizer, capacity, end_id)
    return pieces.join(place(pieces, capacity), "key")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): the sequences of packed pieces, each of at most the capacity, ids as one binary."""
    rows = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("rows"))
    joined = F.aggregate("rows", F.lit(b"").cast("binary"), lambda a, r: F.concat(a, r["ids"]))
    return rows.select("sequence_id", "length", joined.alias("ids"))
