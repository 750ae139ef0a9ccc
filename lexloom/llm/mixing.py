"""Mixing sources to target weights by temperature.

A source's weight is its token share to the power a, normalised: a = 1 keeps the shares, a = 0 is uniform.
The exponent is bisected until the mixture's entropy, or the most often repeated source, meets the target.
The weights are then realised against a token budget: every source gives whole passes and, for the rest, the
first blocks of a hash permutation of its documents, the last block cut within. Blocks are small and fixed
by a hash, so no task orders a whole source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Documents of a block, about.
BLOCK = 4096
#: Exponents tried by one job (5 bits of the bisection), and jobs.
SECTIONS, STEPS = 32, 5


def token_count(text: Column) -> Column:
    """Words of a text, split at white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def _measures(sources: DataFrame, exponents: list[float], ratio: float) -> list[tuple[float, float]]:
    """(entropy in nats, highest number of repetitions) of the mixture at each exponent, in one job of three aggregates."""
    power = F.pow("share", F.col("a"))
    tried = sources.select("share", F.explode(F.array(*[F.lit(float(a)) for a in exponents])).alias("a"))
    found = tried.groupBy("a").agg(F.sum(power).alias("z"), F.sum(power * F.log("share")).alias("weighted"), F.min("share").alias("least"))
    by = {r["a"]: r for r in found.collect()}  # one row for each exponent
    rows = [by[float(a)] for a in exponents]
    return [(math.log(r["z"]) - a * r["weighted"] / r["z"], ratio * r["least"] ** (a - 1) / r["z"]) for a, r in zip(exponents, rows)]


def exponent_for(sources: DataFrame, ratio: float, entropy: float | None, repeats: float | None) -> float:
    """The smallest exponent in 0..1 whose mixture has at most this entropy and these repetitions.

    Both fall as the exponent grows, so each is bisected; where not even the shares themselves (1) meet a
    target, the exponent is 1. ``ratio`` is budget / available tokens.
    """
    low, high = 0.0, 1.0
    for _ in range(STEPS):
        tried = [low + (high - low) * i / SECTIONS for i in range(SECTIONS + 1)]
        meets = [(entropy is None or h <= entropy + 1e-12) and (repeats is None or r <= repeats + 1e-12) for h, r in _measures(sources, tried, ratio)]
        first = next((i for i, ok in enumerate(meets) if ok), None)
        if first is None:
            return 1.0
        if first == 0:
            return tried[0]
        low, high = tried[first - 1], tried[first]
    return high


def mix(
    documents: DataFrame,
    budget_ratio: float = 1.0,
    entropy: float | None = None,
    repeats: float | None = 1.25,
    seed: int = 42,
    block: int = BLOCK,
) -> DataFrame:
    """Rows (doc key columns, source, tokens, epoch) to draw: one row for each copy of a document.

    ``documents`` holds doc_id, source and text. The budget is budget_ratio times all tokens. A null source
    is a source of its own; documents without tokens come with every whole pass. Each source's tokens stay
    within its weight times the budget. Rows of one id are told apart by a hash of the text; exact copies
    of a row are drawn together. An empty table, or one without tokens, gives its rows once.
    """
    spark = documents.sparkSession
    rows = documents.select("doc_id", "source", F.xxhash64("text").alias("key"), token_count(F.col("text")).alias("tokens"))
    rows = materialise(rows.withColumn("src", F.concat(F.when(F.col("source").isNull(), "-").otherwise("+"), F.coalesce("source", F.lit("")))), "mix_rows")
    sources = rows.groupBy("src").agg(F.sum("tokens").alias("total"), F.count("*").alias("n"))
    sources = materialise(sources, "mix_sources")
    available = sources.agg(F.sum("total")).first()[0] or 0
    if not available:
        return rows.select("doc_id", "key", "source", "tokens", F.lit(0).alias("epoch"))
    live = sources.where("total > 0").withColumn("share", F.col("total") / F.lit(float(available)))
    a = exponent_for(live, budget_ratio, entropy, repeats)
    z = live.agg(F.sum(F.pow("share", F.lit(a)))).first()[0]
    budget = F.floor(F.pow("share", F.lit(a)) / F.lit(z) * F.lit(budget_ratio * available) + F.lit(1e-6))
    plan = live.withColumn("budget", budget).select(
        "src",
        (F.col("budget") / F.col("total")).cast("int").alias("passes"),
        F.pmod(F.col("budget"), F.col("total")).alias("rest"),
        F.ceil(F.col("n") / F.lit(block)).cast("int").alias("blocks"),
    )
    plan = materialise(plan, "mix_plan")
    order = F.xxhash64(F.lit(seed), "doc_id", "key")
    placed = rows.join(plan, "src").withColumn("order", order).withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "key"), F.col("blocks")))
    sums = placed.groupBy("src", "block", "rest").agg(F.sum("tokens").alias("sum"))
    permuted = Window.partitionBy("src").orderBy(F.xxhash64(F.lit(seed + 2), "src", "block"), "block").rowsBetween(Window.unboundedPreceding, -1)
    cut = sums.withColumn("before", F.coalesce(F.sum("sum").over(permuted), F.lit(0))).where("before < rest")
    cut = cut.select("src", "block", F.col("before").alias("before"), (F.col("before") + F.col("sum") <= F.col("rest")).alias("whole"))
    chosen = placed.join(cut, ["src", "block"])
    whole = chosen.where("whole")
    inside = Window.partitionBy("src", "block").orderBy("order", "doc_id", "key").rowsBetween(Window.unboundedPreceding, 0)
    partial = chosen.where("NOT whole").withColumn("upto", F.col("before") + F.sum("tokens").over(inside)).where("upto <= rest")
    columns = ["doc_id", "key", "source", "tokens"]
    full = placed.where("passes > 0").select(*columns, F.explode(F.sequence(F.lit(0), F.col("passes") - 1)).alias("epoch"))
    return full.unionByName(whole.select(*columns, F.col("passes").alias("epoch"))).unionByName(
        partial.select(*columns, F.col("passes").alias("epoch"))
    )
