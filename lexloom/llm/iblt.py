"""Document fingerprints: invertible Bloom lookup tables of paragraph digests, in DataFrame operations alone.

A text is cut at line ends and after every few words into paragraphs; its set of paragraph digests is put
into a table of cells (count, xor of digests, xor of checks), each digest into one cell of three parts.
The tables of two versions subtract cell by cell, what they share cancels, and peeling recovers the
digests that differ: a cell that holds one digest gives it away, which is then taken out of its other
cells. Where peeling gets stuck, the pair is sketched again with a larger table.

All cells of a pair stay in the partition that the pair's digests were dealt to, so peeling needs no
shuffle however many rounds it takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Words of a paragraph at most, parts of a table, and cells of a part of the fingerprint.
WORDS, PARTS, BASE = 16, 3, 8
#: Rounds of peeling before a pair counts as stuck; each looks at one part of the tables.
ROUNDS = 12
_CUT = r"(?:\S+[^\S\n]*){1,%d}" % WORDS


def digests(text: Column) -> Column:
    """Distinct digests of the paragraphs of a text (null: none)."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_CUT), F.lit(0)), lambda p: F.xxhash64(F.rtrim(p))))


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(7))


def _cell(digest: Column, part: int | Column, size: Column) -> Column:
    """Index of a digest's cell in a part of ``size`` cells."""
    part = F.lit(part) if isinstance(part, int) else part
    return (F.pmod(F.xxhash64(digest, part, size), size) + part * size).cast("int")


def fingerprint(keys: Column, size: int = BASE) -> Column:
    """The table of an array of digests as text: count:digests:checks in hex for each cell, then their number."""

    def part(p: int) -> Column:
        entries = F.transform(keys, lambda d: F.struct(_cell(d, p, F.lit(size)).alias("cell"), d.alias("d"), _check(d).alias("c")))
        return F.transform(
            F.sequence(F.lit(p * size), F.lit((p + 1) * size - 1)),
            lambda i: F.aggregate(
                F.filter(entries, lambda e: e["cell"] == i),
                F.struct(*[F.lit(0).cast("long").alias(x) for x in "ndc"]),
                lambda a, e: F.struct((a["n"] + 1).alias("n"), a["d"].bitwiseXOR(e["d"]).alias("d"), a["c"].bitwiseXOR(e["c"]).alias("c")),
                lambda a: F.concat_ws(":", F.hex(a["n"]), F.hex(a["d"]), F.hex(a["c"])),
            ),
        )

    cells = F.concat(*[part(p) for p in range(PARTS)])
    return F.concat_ws("-", F.array_join(cells, "-"), F.size(keys).cast("string"))


def _corrections(count: bool) -> Column:
    """A pure cell's digest: reported (cell -1) or counted (cells -1 and -3, by side), taken out of its cell, and out of its two other cells."""
    struct = lambda cell, n, d, c, found: F.struct(
        cell.cast("int").alias("cell"), n.cast("int").alias("n"), d.cast("long").alias("d"), c.cast("long").alias("c"), found.cast("long").alias("found")
    )
    n, d, c = F.col("n"), F.col("d"), F.col("c")
    out = [struct(F.when(n > 0, -1).otherwise(-3), n, F.lit(0), F.lit(0), F.lit(0)) if count else struct(F.lit(-1), n, F.lit(0), F.lit(0), d)]
    for shift in (1, 2):
        other = F.pmod((F.col("cell") / F.col("size")).cast("int") + shift, F.lit(PARTS))
        out.append(struct(_cell(d, other, F.col("size")), -n, d, c, F.lit(0)))
    return F.array(*out)


def peel(cells: DataFrame, keys: list[str], rounds: int = ROUNDS, count: bool = False) -> DataFrame:
    """Peel difference tables; rows (keys, size, cell, n, d, c, found) are cells, or with cell -1 what was found.

    With ``count`` the digests that are found are only counted, those of the left side in cell -1, of the right
    (negative) in cell -3: two rows for each pair go through the rounds in place of one for each digest. Each round looks at one part of the tables, where a digest has but one cell, so none is taken out twice.
    """
    by = [*keys, "size", "cell", "found"]
    for r in range(rounds):
        pure = (F.col("cell") >= 0) & ((F.col("cell") / F.col("size")).cast("int") == r % PARTS) & (F.abs("n") == 1) & (F.col("c") == _check(F.col("d")))
        own = F.array(F.struct("cell", "n", "d", "c", "found"))
        cells = cells.select(*keys, "size", F.explode(F.when(pure, _corrections(count)).otherwise(own)).alias("x")).select(*keys, "size", "x.*")
        cells = cells.groupBy(*by).agg(F.sum("n").cast("int").alias("n"), F.bit_xor("d").alias("d"), F.bit_xor("c").alias("c"))
        cells = cells.where("cell < 0 OR n <> 0 OR d <> 0 OR c <> 0")
    return cells


def difference(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Subtract and peel: (keys, total, stuck, only_left, only_right) for every row (keys, size, left, right).

    left and right are arrays of distinct digests, total is how many both have together. It travels as a
    cell of its own (-2), so a pair whose tables cancel completely has a row, too.
    """
    struct = lambda d, sign: F.struct(d.alias("d"), F.lit(sign).alias("n"))
    total = F.struct(F.lit(0).cast("long").alias("d"), (F.size("left") + F.size("right")).alias("n"))
    both = F.concat(F.transform("left", lambda d: struct(d, 1)), F.transform("right", lambda d: struct(d, -1)), F.array(total))
    rows = pairs.select(*keys, "size", F.posexplode(both).alias("at", "x"), (F.size("left") + F.size("right")).alias("last"))
    cells = F.when(F.col("at") == F.col("last"), F.array(F.lit(-2))).otherwise(F.array(*[_cell(F.col("x.d"), p, F.col("size")) for p in range(PARTS)]))
    rows = rows.select(*keys, "size", "x.d", "x.n", F.explode(cells).alias("cell"))
    cells = rows.groupBy(*keys, "size", "cell").agg(F.sum("n").cast("int").alias("n"), F.bit_xor("d").alias("d"), F.bit_xor(_check(F.col("d"))).alias("c"))
    cells = cells.where("cell < 0 OR n <> 0 OR d <> 0 OR c <> 0").withColumn("found", F.lit(0).cast("long"))
    only = lambda cell: F.sum(F.when(F.col("cell") == cell, F.abs("n")).otherwise(0))
    return peel(cells, keys, count=True).groupBy(*keys).agg(
        F.sum(F.when(F.col("cell") == -2, F.col("n")).otherwise(0)).alias("total"),
        F.max(F.col("cell") >= 0).alias("stuck"),
        only(-1).alias("only_left"),
        only(-3).alias("only_right"),
    )


def likeness(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, near) for rows (keys, left, right): shared digests twice over all, from peeled differences.

    The first table has the fingerprint's size; pairs that get stuck are sketched again for as many
    digests as both sides have, then with twice as many cells each time until all are recovered. Two
    empty sides are alike (1.0), an empty and another one not (0.0). Only counts are written between the
    attempts, the digests are read again from ``pairs``.
    """
    todo, done, attempt = pairs.withColumn("size", F.lit(BASE)), None, 0
    while True:
        # The one shuffle of an attempt: all cells of a pair stay in its partition.
        found = materialise(difference(todo.repartition(*keys), keys), f"iblt_{attempt}")
        differ = F.col("only_left") + F.col("only_right")
        near = F.when(F.col("total") == 0, F.lit(1.0)).otherwise((F.col("total") - differ) / F.col("total"))
        part = found.where("NOT stuck").select(*keys, near.cast("double").alias("near"))
        done = part if done is None else done.unionByName(part)
        stuck = found.where("stuck")
        if stuck.isEmpty():
            return done
        larger = F.greatest(F.lit(2 * BASE), F.ceil(F.col("total") * F.lit(0.6 * 2**attempt)))
        sizes = stuck.select(*keys, larger.cast("int").alias("size"))
        todo, attempt = pairs.join(sizes, keys), attempt + 1


#: Rows of a range of neighbours, about, and ranges at most. Bounds are 16 bytes a range, 2 MB in all; beyond their product ranges grow, and their sort spills.
RANGE, RANGES = 20_000, 1 << 17


def bounds(rows: DataFrame, size: int = RANGE) -> tuple[DataFrame, int]:
    """One row with the sorted first keys (doc_id, tie) of ranges of about ``size`` rows, written once, and the ranges asked for.

    There are at least as many as shuffle partitions. Spark's range partitioning finds them from a sample of the keys; each bound is a key of ``rows``.
    """
    spark = rows.sparkSession
    parts = min(RANGES, max(-(-rows.count() // size), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    keys = rows.select("key").repartitionByRange(parts, "key").select(F.spark_partition_id().alias("range"), "key")
    firsts = keys.groupBy("range").agg(F.min("key").alias("key"))
    return materialise(firsts.agg(F.sort_array(F.collect_list("key")).alias("bounds")), "iblt_bounds"), parts


def neighbours(documents: DataFrame, size: int = RANGE) -> DataFrame:
    """(range, place, doc_id, text, next_text): each document with the next one's text by ascending doc_id.

    The last document's next is the first. Keys (doc_id, hash of the text) are cut into ranges; the first document of a range is also
    dealt to the range before it, so that no range has to look into another. Null ids come first; rows of
    one id are ordered by the hash, then by text, and may lie in several ranges; only equal rows share one. Place numbers the rows of a range.
    """
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tie")).alias("key"), text.alias("text"))
    table, parts = bounds(rows, size)
    rows = rows.withColumn("bounds", table.scalar())
    # The last bound that isn't above the key, by halving steps.
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(parts.bit_length()))])
    own = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get("bounds", at + step) <= F.col("key"), at + step).otherwise(at))
    rows = rows.withColumn("own", own)
    copies = F.filter(
        F.array(
            F.struct(F.col("own").alias("range"), F.lit(False).alias("halo")),
            F.when((F.col("own") > 0) & (F.get("bounds", "own") == F.col("key")), F.struct((F.col("own") - 1).alias("range"), F.lit(True).alias("halo"))),
            F.when(F.get("bounds", F.lit(0)) == F.col("key"), F.struct((F.size("bounds") - 1).alias("range"), F.lit(True).alias("halo"))),
        ),
        lambda c: c.isNotNull(),
    )
    dealt = rows.select("key", "text", F.explode(copies).alias("c")).select("c.range", "c.halo", "key", "text")
    order = Window.partitionBy("range").orderBy("halo", "key", "text")
    placed = dealt.withColumns({"next_text": F.lead("text").over(order), "place": F.row_number().over(order)})
    return placed.where("NOT halo").select("range", "place", "key.doc_id", "text", "next_text")


def compare(documents: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how near the edited and the next text are.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many (or all) of
    the next document. Null texts count as empty; extra columns are ignored; repeated rows each get a row.
    Returns (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).
    """
    length = F.length("text")
    cut = F.floor(length / F.lit(4)).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), length - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    rows = neighbours(documents).withColumns({"n_chars": length.cast("long"), "edited": edited})
    rows = rows.withColumns({"own": digests(F.col("text")), "changed": digests(F.col("edited")), "next": digests(F.col("next_text"))})
    rows = materialise(
        rows.select(
            "range", "place", "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "own", "changed", "next",
        ),
        "iblt_rows",
    )
    pairs = rows.select("range", "place", F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("own").alias("left"), F.col("changed").alias("right")), F.struct(F.lit(1).alias("which"), F.col("own").alias("left"), F.col("next").alias("right")))).alias("p"))
    pairs = pairs.select("range", "place", "p.which", "p.left", "p.right")
    near = likeness(pairs, ["range", "place", "which"])
    near = near.groupBy("range", "place").agg(F.max(F.when(F.col("which") == 0, F.col("near"))).alias("near_edited"), F.max(F.when(F.col("which") == 1, F.col("near"))).alias("near_next"))
    return rows.drop("next").join(near, ["range", "place"]).select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("changed")).alias("edited_fingerprint"), "near_edited", "near_next"
    )
