"""Quality classifier: supervised subword embeddings.

A document is the average of the learned vectors of its hashed words, their character n-grams and its
repeated word pairs; a softmax layer turns that average into a probability. Training is plain numpy
stochastic gradient descent on a bounded, documented sample of labelled rows. As the score is linear in
the average before the softmax, scoring needs one number per hash bucket: 256 KB travel to the workers.
"""

from __future__ import annotations

import math
import operator
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, texts

BUCKETS = 1 << 16
DIM, EPOCHS, RATE, GAIN, SEED = 8, 6, 0.5, 24.0, 17
#: Labelled rows that training takes at most, chosen by a hash of doc_id.
SAMPLE = 3000
NGRAMS = (3, 4)
#: Words whose features a worker keeps; others are computed each time.
CACHE = 200_000
#: Bucket of the word pair "the same word again".
REPEATED = 0


def word_buckets(word: str) -> list[int]:
    """Buckets of a word and of its character n-grams, with marks for its ends."""
    marked, crc = f"<{word}>", zlib.crc32
    out = [crc(b"w" + word.encode("utf-8", "replace")) % (BUCKETS - 1) + 1]
    if marked.isascii():  # then characters are bytes, and need encoding only once
        raw = marked.encode()
        for n in NGRAMS:
            out += [crc(raw[i : i + n]) % (BUCKETS - 1) + 1 for i in range(len(raw) - n + 1)]
    else:
        for n in NGRAMS:
            out += [crc(marked[i : i + n].encode("utf-8", "replace")) % (BUCKETS - 1) + 1 for i in range(len(marked) - n + 1)]
    return out


def repeats(words: list[str]) -> int:
    """Words that equal the word before them."""
    return sum(map(operator.eq, words, islice(words, 1, None)))


def features(text: str, cache: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a whole text and their shares of all its features."""
    words = text.split()
    if not words:
        return np.empty(0, dtype=np.int32), np.empty(0, dtype=np.float32)
    parts, times = [], []
    for word, n in Counter(words).items():
        if (own := cache.get(word)) is None:
            own = np.array(word_buckets(word), dtype=np.int32)
            if len(cache) < CACHE:
                cache[word] = own
        parts.append(own)
        times.append(n)
    counts = np.bincount(np.concatenate(parts), np.repeat(times, [len(p) for p in parts]), minlength=BUCKETS)
    counts[REPEATED] += repeats(words) * 8  # about as many as the n-grams of a word
    ids = np.flatnonzero(counts).astype(np.int32)
    return ids, (counts[ids] / counts.sum()).astype(np.float32)


def fit(samples: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """SGD over (buckets, shares, label); returns BUCKETS logit weights and the bias at the end."""
    weights = np.zeros(BUCKETS + 1, dtype=np.float32)
    good = sum(y for *_, y in samples)
    if good in (0, len(samples)):  # nothing to tell apart
        weights[-1] = 0.0 if not samples else (4.0 if good else -4.0)
        return weights
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = rng.uniform(-1, 1, (2, DIM)).astype(np.float32) / DIM, np.zeros(2, dtype=np.float32)
    steps, step = EPOCHS * len(samples), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(samples)):
            ids, share, label = samples[i]
            rate = np.float32(RATE * (1 - step / steps))
            step += 1
            mean = (share @ vectors[ids]) * GAIN
            logits = out @ mean + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[label] -= 1
            back = p @ out
            # A few buckets hold much of a repetitive text; steps are divided by the size of their input.
            out -= rate * np.outer(p, mean) / (1 + mean @ mean)
            bias -= rate * p * np.float32(0.1)
            power = GAIN * GAIN * (share @ share)
            vectors[ids] -= rate * GAIN / (1 + power) * share[:, None] * back[None, :]
    weights[:-1] = vectors @ (out[1] - out[0]) * GAIN
    weights[-1] = bias[1] - bias[0]
    return weights


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache: dict[str, np.ndarray] = {}
    samples = []
    for batch in batches:
        for text, label in zip(texts(batch["text"]), batch["label"].to_pylist()):
            samples.append((*features(text, cache), label))
    yield pa.record_batch({"model": pa.array([fit(samples).tobytes()], type=pa.binary())})


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, sample: int = SAMPLE) -> np.ndarray:
    """Learn from labelled rows outside fold 0; at most ``sample`` of them, the first by a hash of doc_id.

    Labels other than 0 and 1 and null ids are left out. Without labelled rows every score is 0.5.
    """
    key = F.xxhash64("doc_id")
    picked = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != 0))
        .select("doc_id", F.col(label).cast("int").alias("label"))
        .distinct()
        .orderBy(key, "doc_id", "label")
        .limit(sample)
    )
    # picked has at most ``sample`` rows, so it may be broadcast; a repeated doc_id can't enlarge the sample.
    rows = (
        documents.select("doc_id", "text")
        .join(F.broadcast(picked), "doc_id")
        .select("doc_id", "text", "label", F.xxhash64("text").alias("t"))
        .orderBy(key, "doc_id", "t", "label")
        .limit(sample)
    )
    blob = rows.select("text", "label").repartition(1).sortWithinPartitions(F.xxhash64("text"), "label").mapInArrow(_train, "model binary").collect()
    return np.frombuffer(blob[0]["model"], dtype=np.float32) if blob else fit([])


def _score(broadcast_weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = broadcast_weights.value.tolist()
        bias, again, weight = weights[-1], weights[REPEATED], weights.__getitem__
        cache: dict[str, tuple[float, int]] = {}
        for batch in batches:
            scores = []
            for text in texts(batch["text"]):
                words, total, n = text.split(), 0.0, 0
                for word, times in Counter(words).items():
                    if (own := cache.get(word)) is None:
                        ids = word_buckets(word)
                        own = sum(map(weight, ids)), len(ids)
                        if len(cache) < CACHE:
                            cache[word] = own
                    total += own[0] * times
                    n += own[1] * times
                if pairs := repeats(words):
                    total += again * pairs * 8
                    n += pairs * 8
                logit = bias + total / max(1, n)
                scores.append(1 / (1 + math.exp(-min(60.0, max(-60.0, logit)))))
            kept = [batch[c] for c in batch.schema.names]
            yield pa.record_batch([*kept, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])

    return run


def score(documents: DataFrame, weights: np.ndarray) -> DataFrame:
    """``documents`` with a column ``score`` (0 to 1; higher: label 1 likelier), from whole texts alone.

    Null and empty texts get the bias's score. All other columns stay; one named score is replaced.
    """
    from pyspark.sql.types import DoubleType, StructType

    df = documents.drop("score")
    model = df.sparkSession.sparkContext.broadcast(weights)
    return df.mapInArrow(_score(model), StructType(list(df.schema.fields)).add("score", DoubleType()))


def classify(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``documents`` with held_out (fold 0), score and predicted (1 if score >= threshold)."""
    scored = score(documents, train(documents, labels))
    return scored.withColumns(
        {"held_out": fold(F.col("doc_id"), 5) == 0, "predicted": (F.col("score") >= threshold).cast("int")}
    )
