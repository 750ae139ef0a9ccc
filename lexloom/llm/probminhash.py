"""Near-duplicate classes by ProbMinHash: weighted word shingles, banding, verification, components.

Every shingle of weight w emits arrivals of a Poisson process of rate w; each arrival goes to a random
slot of the signature, and the first arrival in a slot names it. Two documents agree in a slot with the
probability Jaccard similarity of their weighted shingles. Arrivals are drawn in rising order and stop
once they come later than the latest first arrival of all slots.

Documents with the same words in the same order are one text; only its least doc_id goes on. Texts that
share a band of slots are candidates. In every band bucket all members are first compared with the least
one, and verified links make classes. Only buckets that still hold several classes are looked at again,
all pairs of different classes in blocks, so a group of copies is never expanded into its pairs and
no link is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, texts
from .components import components

WORDS, SIMILARITY = 5, 0.8
#: Slots of a signature: BANDS bands of ROWS slots. At 0.8 a pair shares a band with probability 0.9996.
BANDS, ROWS = 20, 5
SLOTS = BANDS * ROWS
#: How far below the wanted similarity a signature's estimate may be (4 standard errors) in block search.
MARGIN = 0.16
#: Members that one task compares with a pivot, and members of a block of a bucket.
SPREAD, BLOCK = 256, 2048
CACHE = 100_000
_ONE = np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, cache: dict[str, int], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of a whole text, rising, and how often each occurs.

    A text of fewer words has one shingle, all its words; a text without words has none.
    """
    tokens = text.split()
    if not tokens:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    codes = []
    for t in tokens:
        if (c := cache.get(t)) is None:
            c = xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"))
            if len(cache) < CACHE:
                cache[t] = c
        codes.append(c)
    codes = np.array(codes, dtype=np.uint64)
    size = min(words, len(codes))
    n = len(codes) - size + 1
    out = np.full(n, size, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n])
    return np.unique(out, return_counts=True)


def signature(elements: np.ndarray, weights: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """The element that arrives first in each slot (uint64)."""
    first, winner = np.full(slots, np.inf), np.zeros(slots, dtype=np.uint64)
    active, w = elements.astype(np.uint64), weights.astype(np.float64)
    time, t = np.zeros(len(active)), 0
    with np.errstate(over="ignore"):
        while len(active):
            steps = max(1, 600 // len(active))
            at = (np.arange(t, t + steps, dtype=np.uint64) + _ONE) * np.uint64(0x9E3779B97F4A7C15)
            draws = _mix(active[:, None] + at[None, :])
            gaps = -np.log(((draws >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / w[:, None]
            arrivals = time[:, None] + np.cumsum(gaps, axis=1)
            slot = (_mix(draws ^ np.uint64(0xD1B54A32D192ED03)) % np.uint64(slots)).astype(np.int64)
            flat, where = arrivals.ravel(), slot.ravel()
            np.minimum.at(first, where, flat)
            won = flat == first[where]
            winner[where[won]] = np.repeat(active, steps)[won]
            time, t = arrivals[:, -1], t + steps
            going = time < first.max()
            active, w, time = active[going], w[going], time[going]
    return winner


def bands_of(winners: np.ndarray) -> np.ndarray:
    """One key per band (int64); different bands never share keys but by chance."""
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(ROWS):
            keys = _mix(keys * np.uint64(0x9E3779B97F4A7C15) + winners.reshape(BANDS, ROWS)[:, i])
    return keys.view(np.int64)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum over shared i of 1 / sum_j max(x_j / x_i, y_j / y_i), exactly; equals Jaccard for plain sets."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    shared, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(shared):
        return 0.0
    x, y = a[1][ia].astype(np.float64), b[1][ib].astype(np.float64)
    ratio = y / x
    if (ratio == ratio[0]).all():  # the usual case: copies that repeat nothing anew
        return float(len(shared) and sum_equal(x, y, a[1].sum(), b[1].sum()))
    order = np.argsort(ratio, kind="stable")
    low, high = np.cumsum(x[order]), np.cumsum(y[order])
    upto = np.searchsorted(ratio[order], ratio, side="right") - 1
    only_a, only_b = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    return float((1 / ((low[upto] + only_a) / x + (y.sum() - high[upto] + only_b) / y)).sum())


def sum_equal(x: np.ndarray, y: np.ndarray, all_a: float, all_b: float) -> float:
    """The similarity where every shared shingle has the same ratio of weights."""
    return (1 / (all_a / x + (all_b - y.sum()) / y)).sum()


_SIGNED = pa.schema([("doc_id", pa.int64()), ("text_key", pa.binary()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache: dict[str, int] = {}
    for batch in batches:
        keys, bands, sketches = [], [], []
        for text in texts(batch["text"]):
            keys.append(hashlib.md5(" ".join(text.split()).encode("utf-8", "surrogatepass")).digest())
            elements, weights = shingles(text, cache)
            won = signature(elements, weights) if len(elements) else None
            bands.append([] if won is None else bands_of(won))
            sketches.append(b"" if won is None else (won >> np.uint64(32)).astype(np.uint32).tobytes())
        yield pa.record_batch([batch["doc_id"], pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], schema=_SIGNED)


def _verify(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one (pivot, salt) stand together, the pivot's own first."""
        cache: dict[str, int] = {}
        at, own = None, None
        for batch in batches:
            left, right = [], []
            for pivot, salt, doc, text in zip(*(batch[c].to_pylist() for c in ("pivot", "salt", "doc", "text"))):
                mine = shingles(text or "", cache)
                if doc == pivot:
                    at, own = (pivot, salt), mine
                elif at == (pivot, salt) and probability_jaccard(own, mine) >= similarity:
                    left.append(pivot)
                    right.append(doc)
            yield pa.record_batch({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return run


def verified(pairs: DataFrame, reps: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b), a < b, whose texts in ``reps`` (rep, text) are similar enough.

    The text of the pivot a is read once for every SPREAD of its partners, not once for each.
    """
    salt = F.pmod(F.xxhash64("b"), F.greatest(F.lit(1), F.ceil(F.col("n") / SPREAD))).cast("int")
    count = pairs.groupBy("a").agg(F.count("*").alias("n"))
    members = pairs.join(count, "a").select(F.col("a").alias("pivot"), salt.alias("salt"), F.col("b").alias("doc"))
    pivots = count.select(F.col("a").alias("pivot"), F.explode(F.sequence(F.lit(0), (F.greatest(F.lit(1), F.ceil(F.col("n") / SPREAD)) - 1).cast("int"))).alias("salt"), F.col("a").alias("doc"))
    wanted = members.unionByName(pivots)
    rows = wanted.join(reps.select(F.col("rep").alias("doc"), "text"), "doc").withColumn("first", F.col("doc") == F.col("pivot"))
    rows = rows.repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", F.desc("first"), "doc")
    return rows.select("pivot", "salt", "doc", "text").mapInArrow(_verify(similarity), "a long, b long").distinct()


def _block_links(similarity: float):
    least = similarity - MARGIN

    def run(key, block):
        """Links that join classes between two blocks of a bucket; pairs that are joined already are skipped."""
        alone = key[1] == key[2]  # a block with itself
        ids, own = block["rep"].to_numpy(), block["first"].to_numpy(zero_copy_only=False)
        sketch = np.frombuffer(b"".join(block["sketch"].to_pylist()), dtype=np.uint32).reshape(-1, SLOTS)
        classes, text, cache, known = block["component"].to_numpy().copy(), block["text"], {}, {}

        def parts(r: int):
            if r not in known:
                known[r] = shingles(text[r].as_py() or "", cache)
            return known[r]

        rows, cols = np.flatnonzero(own), np.flatnonzero(own if alone else ~own)
        left, right = [], []
        for r in rows:
            other = cols[(classes[cols] != classes[r]) & ((ids[cols] > ids[r]) | (not alone))]
            if len(other):
                other = other[(sketch[other] == sketch[r]).mean(axis=1) >= least]
            for o in other:
                if classes[o] != classes[r] and probability_jaccard(parts(r), parts(o)) >= similarity:
                    classes[classes == classes[o]] = classes[r]
                    left.append(min(ids[r], ids[o]))
                    right.append(max(ids[r], ids[o]))
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return run


def _cells(members: DataFrame) -> DataFrame:
    """(bucket, i, j, block, rep, component): the pairs of blocks that members (bucket, rep, component) of a bucket meet in.

    A large class has blocks of its own, and such blocks don't meet those of the same class: a bucket whose members are
    one large class and a few others costs its members once for each block of the others, not their square.
    """
    sizes = members.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    small = sizes.where(F.col("n") < BLOCK // 2).groupBy("bucket").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("mixed"))
    placed = members.join(sizes, ["bucket", "component"]).join(small, "bucket", "left")
    own = F.col("n") >= BLOCK // 2
    block = F.struct(
        F.when(own, F.col("component")).alias("of"),
        F.when(own, F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / BLOCK))).otherwise(F.pmod(F.xxhash64("component"), F.col("mixed"))).cast("int").alias("part"),
    )
    placed = placed.select("bucket", "rep", "component", block.alias("block"))
    blocks = placed.groupBy("bucket", "block").agg(F.min("component").alias("least"), F.max("component").alias("most"))
    # Pairs of blocks, not of members; a pair whose members are all of one class has nothing to join.
    left, right = (blocks.select("bucket", F.col("block").alias(x), F.col("least").alias(f"{x}_least"), F.col("most").alias(f"{x}_most")) for x in "ij")
    pairs = left.join(right, "bucket").where("i <= j AND least(i_least, j_least) <> greatest(i_most, j_most)").select("bucket", "i", "j")
    sides = pairs.select("bucket", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    return placed.join(sides, ["bucket", "block"]).select("bucket", "i", "j", (F.col("block") == F.col("i")).alias("first"), "rep", "component")


def _links_between_classes(members: DataFrame, texts_of: DataFrame, similarity: float) -> DataFrame:
    """Verified links (a, b) that join classes of a bucket: members (bucket, rep, component), texts_of (rep, sketch, text).

    Every pair of members of different classes meets in a task of two blocks; only the links that join
    something leave it, so the rows made grow with the members, not with their pairs.
    """
    cells = _cells(members).join(texts_of, "rep")
    return cells.groupBy("bucket", "i", "j").applyInArrow(_block_links(similarity), "a long, b long").distinct()


def classes(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id) of ``documents`` (doc_id, text): one row for each row with an id.

    class_id is the least doc_id of the class. Null texts count as empty; texts without words are one
    class. Null ids give a row without a class. Repeated rows and copies join one class, ids with
    several texts join the classes of all of them. Extra columns are ignored.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = materialise(docs.mapInArrow(_sign, "doc_id long, text_key binary, bands array<long>, sketch binary"), "signed")
    known = signed.where("doc_id IS NOT NULL")
    reps = materialise(known.groupBy("text_key").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "reps")
    buckets = reps.select("rep", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("rep").alias("pivot"), F.count("*").alias("n")).where("n > 1").drop("n")
    crowded = materialise(buckets.join(shared, "bucket"), "buckets")
    stars = materialise(crowded.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct(), "stars")
    # A representative's text: the least id's; an id with several texts offers each of them.
    source = docs.join(reps.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), "text")
    links = materialise(verified(stars, source, similarity), "links")
    found = components(links)
    # Buckets that still hold several classes: all pairs of different classes.
    member = crowded.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", F.col("rep")))
    mixed = member.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("bucket")
    still_open = materialise(member.join(mixed, "bucket", "left_semi").select("bucket", "rep", "component").distinct(), "open")
    wanted = reps.select("rep", "sketch").join(source, "rep").join(still_open.select("rep").distinct(), "rep", "left_semi")
    more = materialise(_links_between_classes(still_open, wanted, similarity), "more_links")
    if not more.isEmpty():
        found = components(links.unionByName(more))
    # All texts of one id belong to one class.
    of_text = reps.select("text_key", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("text_key", F.coalesce("component", "rep").alias("class_id"))
    out = signed.select("doc_id", "text_key").join(of_text, "text_key", "left")
    return out.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.least("class_id", "doc_id")).alias("class_id"))


def keep_one(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class, that of the least doc_id; rows without an id all stay.

    Of several rows with that id one stays: the least by a hash of the text, then of the other columns. Null texts
    count as empty ones. An empty table stays empty.
    """
    dropped = classes(documents, similarity).where("class_id <> doc_id").select("doc_id").distinct()
    kept = documents.join(dropped, "doc_id", "left_anti")
    others = [c for c, kind in documents.dtypes if c != "text" and "map<" not in kind]
    order = F.struct(F.xxhash64("text"), F.xxhash64(*others))
    first = kept.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min_by(F.struct(*documents.columns), order).alias("row")).select("row.*")
    return first.unionByName(kept.where("doc_id IS NULL"))
