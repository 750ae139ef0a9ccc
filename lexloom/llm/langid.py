"""Language identification by words first, then by shorter and shorter character n-grams.

A known word adds its log frequency in each language. An unseen word adds the mean log frequency of its
known 4-grams; if none is known its 3-grams are asked, then 2-grams and single letters.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from .common import fold, texts

#: Documents that training takes at most: of one language, and in all; chosen by a hash of doc_id.
SAMPLE_PER_LANG, SAMPLE = 1500, 12_000
LONGEST = 4
SMOOTHING = 0.5
CACHE = 100_000
LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters; numerals that Python counts as word characters (such as one half or Roman eight) are none."""
    found = LETTERS.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [w for run in found for w in "".join(c if c.isalpha() else " " for c in run).split()]


def grams(word: str, n: int) -> list[str]:
    marked = f" {word} " if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def _log_frequencies(counts: dict[str, Counter], langs: list[str], least: int) -> tuple[dict[str, int], np.ndarray]:
    total: Counter = Counter()
    for c in counts.values():
        total.update(c)
    index = {w: i for i, w in enumerate(sorted(w for w, n in total.items() if n >= least))}
    table = np.full((len(index), len(langs)), SMOOTHING)
    for j, lang in enumerate(langs):
        for w, n in counts[lang].items():
            if w in index:
                table[index[w], j] += n
    sums = np.array([sum(counts[lang].values()) for lang in langs]) + SMOOTHING * (len(total) + 1)
    return index, np.log(table / sums).astype(np.float32)


def learn(rows: Iterator[tuple[str, str]]) -> dict:
    """A model from (text, lang) rows: words seen twice or more, and n-grams of one to four letters."""
    words: dict[str, Counter] = defaultdict(Counter)
    for text, lang in rows:
        words[lang].update(words_of(text))
    langs = sorted(words)
    model = {"langs": langs, "words": _log_frequencies(words, langs, 2), "grams": []}
    for n in range(LONGEST, 0, -1):
        counts: dict[str, Counter] = {lang: Counter() for lang in langs}
        for lang in langs:
            for word, times in words[lang].items():
                for g in grams(word, n):
                    counts[lang][g] += times
        model["grams"].append((n, *_log_frequencies(counts, langs, 2)))
    return model


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for batch in batches:
            yield from zip(texts(batch["text"]), batch["lang"].to_pylist())

    yield pa.record_batch({"model": pa.array([pickle.dumps(learn(rows()))], type=pa.binary())})


def train(documents: DataFrame, folds: int = 4, held_out: int = 2) -> dict:
    """Learn from documents with a language outside the held-out fold, a bounded sample of them.

    Null languages and ids are left out, null texts count as empty. Repeated rows
    of a chosen id all count, while the sample has room. Ties of the ordering hash go to the smaller id.
    """
    key = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    rows = documents.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != held_out))
    ids = rows.select("doc_id", "lang")
    # So few of a language's rows have a hash below this share that one task can order them, yet more than the sample
    # takes (by ten standard deviations). At most SAMPLE languages are broadcast.
    room = SAMPLE_PER_LANG + 10 * SAMPLE_PER_LANG**0.5
    sizes = ids.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(SAMPLE)
    low = ids.join(F.broadcast(sizes), "lang").where(key * F.col("n") <= F.lit(float(room * (1 << 40)))).select("doc_id", "lang").distinct()
    first = Window.partitionBy("lang").orderBy(key, "doc_id")
    picked = low.withColumn("n", F.row_number().over(first)).where(F.col("n") <= SAMPLE_PER_LANG).orderBy("n", "lang").limit(SAMPLE).select("doc_id", "lang")
    # picked has at most SAMPLE rows, so it may be broadcast; a repeated doc_id can't enlarge the sample.
    sample = rows.select("doc_id", "lang", "text").join(F.broadcast(picked), ["doc_id", "lang"])
    sample = sample.withColumn("t", F.xxhash64("text")).orderBy(key, "doc_id", "lang", "t").limit(SAMPLE)
    blob = sample.select("text", "lang").repartition(1).mapInArrow(_learn, "model binary").collect()
    return pickle.loads(blob[0]["model"]) if blob else learn(iter(()))


class Scorer:
    """Sums of log frequencies; keeps the rows of words it has met, up to a bound."""

    def __init__(self, model: dict):
        self.langs, (self.words, self.table), self.grams = model["langs"], model["words"], model["grams"]
        self.cache: dict[str, np.ndarray] = {}

    def unseen(self, word: str) -> np.ndarray:
        if (own := self.cache.get(word)) is None:
            own = np.zeros(len(self.langs), dtype=np.float32)
            for n, index, table in self.grams:
                if known := [index[g] for g in grams(word, n) if g in index]:
                    own = table[known].mean(axis=0)
                    break
            if len(self.cache) < CACHE:
                self.cache[word] = own
        return own

    def predict(self, text: str) -> tuple[str, float]:
        counts = Counter(words_of(text))
        if not counts or not self.langs:
            return "und", 0.0
        total = np.zeros(len(self.langs))
        rows, times = [], []
        for word, n in counts.items():
            if (i := self.words.get(word)) is None:
                total += n * self.unseen(word)
            else:
                rows.append(i)
                times.append(n)
        if rows:
            total += np.array(times, dtype=np.float64) @ self.table[rows]
        best = int(total.argmax())
        return self.langs[best], float(1 / np.exp(total - total[best]).sum())


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        for batch in batches:
            found = [scorer.predict(t) for t in texts(batch["text"])]
            kept = [batch[c] for c in batch.schema.names]
            lang, score = pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())
            yield pa.record_batch([*kept, lang, score], names=[*batch.schema.names, "lang_pred", "score"])

    return run


def identify(documents: DataFrame, model: dict) -> DataFrame:
    """``documents`` with lang_pred and score (the share of the best language's likelihood).

    Null texts and texts without letters are ``und`` with score 0; so is every text if no language was
    learned. Of equal languages the first by name wins. Other columns stay, clashing ones are replaced.
    """
    df = documents.drop("lang_pred", "score")
    shipped = df.sparkSession.sparkContext.broadcast(model)
    schema = StructType(list(df.schema.fields)).add("lang_pred", StringType()).add("score", DoubleType())
    return df.mapInArrow(_predict(shipped), schema)
