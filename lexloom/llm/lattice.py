"""SentencePiece encoding and decoding by relational lattices.

Text is cut into words (spaces kept in front, as the marker U+2581). A word's lattice: all substrings of
bounded length, equi-joined to the piece table; its edges are grouped by word and folded by Viterbi
with a higher-order aggregate. The fold keeps, for every position of the word, the best sum of scores and
the edge that reaches it; of equal sums the edge that starts first wins, as in the unigram encoder.
The most frequent words are encoded so once for the whole corpus. A word outside that dictionary is
encoded in its Arrow batch by the same rule: README has the figures of sending every word through the join.

Characters without a piece become byte pieces, and so does a U+2581 in the text, so decoding gives back
every text exactly. Scores are the piece file's own; no tokenizer is trained.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from array import array
from collections.abc import Iterator
from functools import cache, lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructType

from .common import materialise, texts

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Words of the dictionary at most: the most frequent ones. Its size is bounded, so that it may be broadcast.
DICTIONARY = 250_000
#: Longest word, in characters, that goes into the dictionary; longer ones are encoded in their batch.
LONGEST_WORD = 32
CACHE = 100_000
SPACE = "\u2581"
#: What the unigram encoder subtracts from the least score for an unknown character.
UNKNOWN = 10.0
_words = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: While words are cut, LITERAL stands for a U+2581 of the text itself and ESCAPE starts the pairs that stand
#: for these private characters. None of them has a piece, so each becomes bytes of what it stands for.
LITERAL, ESCAPE = "\U0010fffe", "\U0010fffd"
_STANDS = {LITERAL: SPACE, ESCAPE + "\U0010fffc": LITERAL, ESCAPE + "\U0010fffb": ESCAPE}
_marks = {v: k for k, v in _STANDS.items()}


class Pieces:
    """The piece table of a model: id and score of every ordinary piece, ids of the byte pieces."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int]):
        self.pieces, self.bytes = pieces, byte_ids
        if any(SPACE in p.lstrip(SPACE) for p in self.pieces):
            raise ValueError("a piece has a space behind other characters; words can't be encoded alone")
        if any(c in p for p in self.pieces for c in (LITERAL, ESCAPE)):
            raise ValueError("a piece holds a private character that marks words")
        self.longest = max(map(len, self.pieces))
        #: Pieces by their characters: a node holds the nodes that go on, and under "" its own piece's (id, score).
        self.trie: dict = {}
        for piece, found in self.pieces.items():
            node = self.trie
            for char in piece:
                node = node.setdefault(char, {})
            node[""] = found
        self.unknown = min(s for _, s in self.pieces.values()) - UNKNOWN
        self.by_id = {i: p.replace(SPACE, " ").encode() for p, (i, _) in self.pieces.items()}
        self.by_id |= {i: bytes([b]) for b, i in enumerate(self.bytes)}

    def encode_word(self, word: str) -> list[int]:
        """The best path through the lattice of one word: edges are read off the trie from every place on."""
        n, roots, unknown, longest, low = len(word), self.trie, self.unknown, self.longest, float("-inf")
        sums, starts, ids = [0.0] + [low] * n, [0] * (n + 1), [-1] * (n + 1)
        for start in range(n):
            so_far, end = sums[start], start + 1
            node = roots.get(word[start])
            single = node.get("") if node else None
            total = so_far + (single[1] if single else unknown)
            if total > sums[end]:
                sums[end], starts[end], ids[end] = total, start, single[0] if single else -1
            if node is None:
                continue
            for char in word[end : start + longest]:
                if (node := node.get(char)) is None:
                    break
                end += 1
                if edge := node.get(""):
                    total = so_far + edge[1]
                    if total > sums[end]:
                        sums[end], starts[end], ids[end] = total, start, edge[0]
        out, at = [], n
        while at:
            out.append(ids[at])
            at = starts[at]
        out.reverse()
        return self.spelled(word, out) if -1 in out else out

    def spell(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode("utf-8", "surrogatepass")]

    def spelled(self, word: str, ids: list[int]) -> list[int]:
        """ids of a word's best path with bytes in place of every -1 (a character without a piece)."""
        out, at = [], 0
        for i in ids:
            if i >= 0:
                out.append(i)
                at += len(self.by_id[i].decode())
                continue
            if word[at] == ESCAPE:
                out += self.spell(_STANDS[word[at : at + 2]])
            elif at == 0 or word[at - 1] != ESCAPE:
                out += self.spell(_STANDS.get(word[at], word[at]))
            at += 1
        return out

    def decode(self, ids) -> str:
        """Text of ids; the space that encoding put in front is taken off."""
        text = b"".join(map(self.by_id.__getitem__, ids)).decode("utf-8", "surrogatepass")
        return text[1:]


@cache
def load(model: str = MODEL) -> Pieces:
    """The pieces of a model file. Only the driver reads it; workers get the pieces (see ``shipped``)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    n = sp.get_piece_size()
    special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)}
    byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    if any(not sp.is_byte(i) for i in byte_ids):
        raise ValueError("the model has no byte pieces, so texts could not be given back")
    return Pieces({sp.id_to_piece(i): (i, float(sp.get_score(i))) for i in range(n) if i not in special}, byte_ids)


def shipped(table: Pieces) -> bytes:
    """The vocabulary (of a fixed size) as bytes for the workers, who need neither the file nor its library."""
    return pickle.dumps((table.pieces, table.bytes))


@lru_cache(maxsize=2)
def received(blob: bytes) -> Pieces:
    return Pieces(*pickle.loads(blob))


def words_of(text: str) -> list[str]:
    """The words whose joined encodings encode the text; a space is put in front. Empty text: none."""
    if not text:
        return []
    if SPACE in text or LITERAL in text or ESCAPE in text:
        text = re.sub(f"[{SPACE}{LITERAL}{ESCAPE}]", lambda m: _marks[m[0]], text)
    return _words.findall(SPACE + text.replace(" ", SPACE))


def _any_of(column: str, chars: str) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(column, F.lit(c)) for c in chars])


def count_words(documents: DataFrame) -> DataFrame:
    """(word, n) over whole texts: words between spaces, with the space mark in front, without a mark inside."""
    words = documents.where("text <> ''").select(F.explode(F.split("text", " ")).alias("w"))
    words = words.where((F.col("w") != "") & (F.length("w") < LONGEST_WORD) & ~_any_of("w", SPACE + LITERAL + ESCAPE))
    return words.groupBy("w").agg(F.count("*").alias("n")).select(F.concat(F.lit(SPACE), "w").alias("word"), "n")


def frequent_words(documents: DataFrame, size: int) -> DataFrame:
    """(word) of the most frequent words, at most ``size``: those above a count that a histogram gives.

    The histogram has a few hundred bins of counts, so neither a sort nor a single task sees all words. Of the bin
    that holds more words than there is room for, a hash picks a share whose number stays below the room but for
    chances of 1 in 30,000 (and then exceeds it by a few words).
    """
    counted = materialise(count_words(documents).withColumn("bin", F.floor(F.log("n") * 8).cast("int")), "word_counts")
    room, least, share = size, None, 0.0
    for r in sorted(counted.groupBy("bin").count().collect(), reverse=True):
        least = r["bin"]
        if r["count"] > room:
            share = max(0.0, room - 4 * room**0.5) / r["count"]  # four standard deviations below what fits
            break
        room, share = room - r["count"], 1.0
    if least is None:
        return counted.select("word")
    chosen = F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))
    return counted.where((F.col("bin") > least) | ((F.col("bin") == least) & chosen)).select("word")


def encode_words(words: DataFrame, model: str = MODEL) -> DataFrame:
    """(word, ids) for distinct words: lattice by equi-join with the piece table, Viterbi by aggregate.

    An id of -1 stands for a character without a piece.
    """
    spark, table = words.sparkSession, load(model)
    pieces = spark.createDataFrame([(p, i, s) for p, (i, s) in table.pieces.items()], "piece string, id int, score double")
    length = F.length("word")
    starts = words.select("word", F.explode(F.sequence(F.lit(1), length)).alias("start"))
    spans = starts.select("word", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(table.longest), length - F.col("start") + 1))).alias("len"))
    spans = spans.select("word", "start", "len", F.substring("word", F.col("start"), F.col("len")).alias("piece"))
    # The piece table has a fixed size (the vocabulary), so it may be broadcast.
    edges = spans.join(F.broadcast(pieces), "piece", "left").where("id IS NOT NULL OR len = 1")
    edge = F.struct("start", "len", F.coalesce("score", F.lit(table.unknown)).alias("score"), F.coalesce("id", F.lit(-1)).alias("id"))
    grouped = edges.groupBy("word").agg(F.array_sort(F.collect_list(edge)).alias("edges"))
    node = "array<struct<sum:double,start:int,id:int>>"
    blank = F.array_repeat(F.struct(F.lit(float("-inf")).alias("sum"), F.lit(0).alias("start"), F.lit(-1).alias("id")), F.length("word") + 1)
    first = F.transform(blank, lambda x, i: F.when(i == 0, F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("start"), F.lit(-1).alias("id"))).otherwise(x)).cast(node)

    def step(best, e):
        total = F.element_at(best, e["start"])["sum"] + e["score"]
        reached = F.struct(total.alias("sum"), e["start"].alias("start"), e["id"].alias("id"))
        return F.transform(best, lambda x, i: F.when((i == e["start"] - 1 + e["len"]) & (total > x["sum"]), reached).otherwise(x)).cast(node)

    folded = grouped.select("word", F.aggregate("edges", first, step).alias("best"))
    start = F.struct(F.array().cast("array<int>").alias("ids"), (F.length("word") + 1).alias("at"))

    def back(a, _):
        x = F.element_at(F.col("best"), a["at"])
        return F.when(a["at"] > 1, F.struct(F.concat(F.array(x["id"]), a["ids"]).alias("ids"), x["start"].alias("at"))).otherwise(a)

    return folded.select("word", F.aggregate("best", start, back)["ids"].alias("ids"))


def dictionary(documents: DataFrame, model: str = MODEL, size: int = DICTIONARY) -> pa.Table:
    """(word, ids) of the most frequent words of all documents, at most ``size`` of them; as encode_words gives them."""
    return encode_words(frequent_words(documents, size), model).toArrow()


def _packed(rows: pa.Table) -> bytes:
    """A table as bytes that travel and stay in the driver in a tenth of the memory of a dict."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(rows)
    return sink.getvalue().to_pybytes()


def unpacked(blob: bytes, table: Pieces) -> dict[str, bytes]:
    """Word without its mark -> its ids (int32 bytes), characters without a piece as bytes."""
    out: dict[str, bytes] = {}
    for batch in pa.ipc.open_stream(blob):
        values, offsets, words = batch["ids"].values.to_numpy(), batch["ids"].offsets.to_pylist(), batch["word"].to_pylist()
        raw, holes = values.tobytes(), np.cumsum(np.append(0, values < 0))
        for word, a, b in zip(words, offsets, offsets[1:]):
            out[word[1:]] = raw[4 * a : 4 * b] if holes[a] == holes[b] else array("i", table.spelled(word, values[a:b].tolist())).tobytes()
    return out


class _Words(dict):
    """Encodings of words behind one space: those of the dictionary, and up to CACHE others that were met.

    As ids decode one by one, a text is given back if each of its words is; so that is seen once for a word.
    """

    def __init__(self, known: dict[str, bytes], table: Pieces):
        super().__init__(known)
        self.table, self.room = table, len(known) + CACHE
        self.lost = {w for w, ids in known.items() if table.decode(np.frombuffer(ids, dtype=np.int32).tolist()) != w}

    def __missing__(self, word: str) -> bytes:
        found = self.table.encode_word(SPACE + word)
        ids = array("i", found).tobytes()
        if self.table.decode(found) != word:
            self.lost.add(word)
        if len(self) < self.room:
            self[word] = ids
        return ids

    def _marked(self, word: str) -> bytes:
        """A word as words_of cuts it: behind several spaces, or with marks inside, it isn't one of those kept here."""
        if word[1:2] in ("", SPACE) or LITERAL in word or ESCAPE in word:
            return array("i", self.table.encode_word(word)).tobytes()
        return self[word[1:]]

    def encode(self, text: str) -> tuple[bytes, bool]:
        """The ids of a text (int32 bytes), and whether they decode to it."""
        if not text:
            return b"", True
        if "  " in text or text[0] == " " or text[-1] == " " or SPACE in text or LITERAL in text or ESCAPE in text:
            blob = b"".join(map(self._marked, words_of(text)))
            return blob, self.table.decode(np.frombuffer(blob, dtype=np.int32).tolist()) == text
        words = text.split(" ")
        blob = b"".join(map(self.__getitem__, words))
        return blob, not self.lost or self.lost.isdisjoint(words)


_dictionaries: dict[bytes, _Words] = {}


def _known(blob: bytes, table: Pieces) -> _Words:
    """The words of a worker process, made once; only the last dictionary is kept."""
    key = hashlib.md5(blob).digest()
    if key not in _dictionaries:
        _dictionaries.clear()
        _dictionaries[key] = _Words(unpacked(blob, table), table)
    return _dictionaries[key]


def _encode(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, words = sent.value
        table = received(vocabulary)
        encode_text = _known(words, table).encode
        for batch in batches:
            blobs, same = zip(*map(encode_text, texts(batch["text"])), strict=True) if batch.num_rows else ((), ())
            offsets = np.concatenate([[0], np.cumsum([len(b) // 4 for b in blobs])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(blobs), dtype=np.int32)))
            kept = [batch[c] for c in batch.schema.names]
            yield pa.record_batch([*kept, ids, pa.array(same, pa.bool_())], names=[*batch.schema.names, "ids", "round_trip"])

    return run


def encode(documents: DataFrame, model: str = MODEL, size: int = DICTIONARY) -> DataFrame:
    """``documents`` with ids (array of piece ids) and round_trip (decoding them gave the text back).

    Null and empty texts have no ids. Whole texts are encoded, however long. Other columns stay; columns
    named ids or round_trip are replaced.
    """
    df = documents.drop("ids", "round_trip")
    sent = df.sparkSession.sparkContext.broadcast((shipped(load(model)), _packed(dictionary(df.select("text"), model, size))))
    schema = StructType(list(df.schema.fields)).add("ids", ArrayType(IntegerType())).add("round_trip", BooleanType())
    return df.mapInArrow(_encode(sent), schema)


def _decode(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = received(sent.value)
        for batch in batches:
            decoded = [table.decode(ids) if ids else "" for ids in batch["ids"].to_pylist()]
            kept = [batch[c] for c in batch.schema.names]
            yield pa.record_batch([*kept, pa.array(decoded, pa.string())], names=[*batch.schema.names, "decoded"])

    return run


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """``encoded`` with a column ``decoded``, the text of ids; null or no ids give an empty text."""
    from pyspark.sql.types import StringType

    df = encoded.drop("decoded")
    sent = df.sparkSession.sparkContext.broadcast(shipped(load(model)))
    return df.mapInArrow(_decode(sent), StructType(list(df.schema.fields)).add("decoded", StringType()))


def piece_table(spark: SparkSession, model: str = MODEL) -> DataFrame:
    """(id, piece, score) of the ordinary pieces."""
    return spark.createDataFrame([(i, p, s) for p, (i, s) in load(model).pieces.items()], "id int, piece string, score double")
