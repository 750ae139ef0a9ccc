"""URL filters by association rules, in DataFrame operations alone.

Given rules (host suffix plus path prefix, longest wins) decide the urls that they fit, and label them.
FP-growth mines frequent token combinations of the labelled urls; the rules "tokens -> verdict" that pass
the support and confidence limits judge all other urls. They match through an inverted index: a url's
tokens are joined to the index (token -> rule), and a rule fires when all its tokens were met. Urls are
matched once per distinct token set, so a host with a third of all rows costs one match.

Tokens that always occur together in the labelled urls (folders of one template, suffixes of one host) would yield a
number of combinations that doubles with each of them, all of one support. One of them stands for all while mining; a
url has it if it has any of them, which is when the shortest of those combinations would fire.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
MIN_SUPPORT, MIN_CONFIDENCE, DEFAULT = 0.01, 0.6, "allow"
#: Labels that a host name can have (253 characters, RFC 1035), and the length from which a token is its digest.
LABELS, LONG = 127, 64
#: Copies of each verdict row that the urls of one token set are dealt over.
SALTS = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_rest(url), r"\A[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"\A[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest fitting rule (of equals, the last by text), or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _token(kind: Column, value: Column) -> Column:
    return F.concat(kind, F.when(F.length(value) > LONG, F.sha2(value.cast("binary"), 256)).otherwise(value))


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a url: all host suffixes, whole folders and how they start, query keys, fragment."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(LABELS))), lambda n: _token(F.lit("h:"), F.array_join(F.slice(labels, -n, n), ".")))
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    place = lambda i: F.concat(F.lit("p"), F.least(i, F.lit(3)).cast("string"))
    folders = F.transform(segments, lambda s, i: _token(F.concat(place(i), F.lit("=")), s))
    starts = F.transform(segments, lambda s, i: F.concat(place(i), F.lit("^"), F.substring(s, 1, 1)))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda s: s != ""), lambda s: _token(F.lit("q="), F.substring_index(s, "=", 1)))
    extra = F.array_compact(
        F.array(
            F.when(F.size(labels) > 3, F.concat(F.lit("s="), F.element_at(labels, 1))),
            F.when(F.contains(url, F.lit("#")), F.lit("fragment")),
        )
    )
    return F.array_sort(F.array_distinct(F.concat(suffixes, folders, starts, keys, extra)))


def together(labelled: DataFrame, min_support: float) -> DataFrame:
    """(token, stands) of frequent tokens of ``labelled`` (tokens, verdict): the least token that occurs in the same rows stands for all.

    Rows are told apart by two 64-bit hashes of their tokens, so different sets of rows have different sums of these.
    """
    least = math.ceil(min_support * labelled.count())
    sets = labelled.groupBy("tokens").agg(F.count("*").alias("n"))
    seen = sets.select("n", F.xxhash64("tokens").alias("a"), F.xxhash64(F.lit(1), "tokens").alias("b"), F.explode("tokens").alias("token"))
    big = lambda c: F.sum(F.col(c).cast("decimal(28,0)")).alias(c)
    frequent = seen.groupBy("token").agg(F.sum("n").alias("n"), big("a"), big("b")).where(F.col("n") >= least)
    return frequent.select("token", F.min("token").over(Window.partitionBy("n", "a", "b")).alias("stands"))


def mine(labelled: DataFrame, min_support: float, min_confidence: float, classes: DataFrame | None = None) -> DataFrame:
    """Rules (rule_id, tokens, verdict, confidence, support) from rows (tokens, verdict), over the tokens that stand for ``classes``."""
    if classes is not None:
        # A row holds all tokens of a class or none; there are at most (tokens of a url) / min_support frequent ones.
        standing = sorted(r[0] for r in classes.select("stands").distinct().collect())
        labelled = labelled.withColumn("tokens", F.array_intersect("tokens", F.array(*map(F.lit, standing)).cast("array<string>")))
    baskets = labelled.select(F.array_append("tokens", F.concat(F.lit("verdict:"), F.col("verdict"))).alias("items"))
    found = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets).associationRules
    verdict = F.col("consequent")[0]
    return found.where(verdict.startswith("verdict:")).select(
        F.xxhash64(F.array_sort("antecedent"), verdict).alias("rule_id"),
        F.array_sort("antecedent").alias("tokens"),
        F.substring_index(verdict, ":", -1).alias("verdict"),
        "confidence",
        "support",
    )


def undominated(rules: DataFrame) -> DataFrame:
    """Rules without those that one of their own parts, a token shorter, replaces: same verdict, no less confidence.

    Where such a rule fires its part fires too, with no less support, and ranks before it; so no verdict changes.
    """
    shorter = rules.where(F.size("tokens") > 1).select(
        "rule_id", "verdict", "confidence", F.explode(F.transform("tokens", lambda t: F.array_remove("tokens", t))).alias("tokens")
    )
    parts = rules.select("tokens", "verdict", F.col("confidence").alias("own"))
    replaced = shorter.join(parts, ["tokens", "verdict"]).where("own >= confidence").select("rule_id").distinct()
    return rules.join(replaced, "rule_id", "left_anti")


def match(token_sets: DataFrame, rules: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """The best fired rule's verdict for each distinct ``tokens`` array, by inverted index.

    A rule's token is met by any token of its class. The best rule has the highest confidence, then support, then the
    fewest tokens; block goes before allow.
    """
    index = rules.select("rule_id", "verdict", "confidence", "support", F.size("tokens").alias("needed"), F.explode("tokens").alias("token"))
    held = token_sets.select("tokens", F.explode("tokens").alias("token"))
    if classes is not None:
        held = held.join(classes, "token").select("tokens", F.col("stands").alias("token")).distinct()
    hits = held.join(index, "token")
    fired = hits.groupBy("tokens", "rule_id", "verdict", "confidence", "support", "needed").agg(F.count("*").alias("met")).where("met = needed")
    best = F.max(F.struct("confidence", "support", -F.col("needed"), "verdict"))
    return fired.groupBy("tokens").agg(best.alias("best")).select("tokens", F.col("best.verdict").alias("mined"), F.col("best.confidence").alias("confidence"))


def judge(
    pages: DataFrame,
    rules: list[tuple[str, str]] = RULES,
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
    default: str = DEFAULT,
) -> DataFrame:
    """One row per row of ``pages`` (page_id, url): host, path, rule, verdict, confidence.

    Null urls and urls without ``://`` have empty host and path and get the verdict of the mined rules
    for such tokens, else the default. Of a host with more than LABELS labels, which no real one has, the last ones count. Repeated rows and null ids stay as they are; other columns of
    ``pages`` are ignored. Without labelled urls, or with an empty table, nothing is mined.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    parsed = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url")).select(
        "page_id", "url", host.alias("host"), path.alias("path")
    )
    parsed = parsed.withColumn("given", longest_rule(F.col("host"), F.col("path"), rules)).withColumn(
        "tokens", url_tokens(F.col("url"), F.col("host"), F.col("path"))
    )
    given = parsed.where(F.col("given").isNotNull())
    other = parsed.where(F.col("given").isNull())
    labelled = given.select("tokens", F.col("given.verdict").alias("verdict"))
    columns = ["page_id", "host", "path", "rule", "verdict", "confidence"]
    decided = given.select("page_id", "host", "path", "given.rule", "given.verdict", F.lit(None).cast("double").alias("confidence"))
    if labelled.isEmpty():
        rest = other.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"), F.lit(None).cast("double").alias("confidence"))
        return decided.unionByName(rest).select(columns)
    classes = materialise(together(labelled, min_support), "url_classes")
    mined = materialise(undominated(materialise(mine(labelled, min_support, min_confidence, classes), "mined")), "url_rules")
    # Only tokens of rules can fire one: what is left of a url is matched once however many urls share it. A token of
    # a rule is in min_support of the labelled urls, so there are at most (tokens of a url) / min_support of them.
    standing = mined.select(F.explode("tokens").alias("stands")).distinct()
    used = sorted(r["token"] for r in classes.join(standing, "stands").select("token").collect())
    other = other.withColumn("tokens", F.array_intersect("tokens", F.array(*map(F.lit, used)).cast("array<string>")))
    verdicts = match(other.select("tokens").distinct(), mined, classes).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = other.withColumn("salt", F.pmod(F.xxhash64("url", "page_id"), F.lit(SALTS)).cast("int"))
    rest = salted.join(verdicts, ["tokens", "salt"], "left").select(
        "page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.coalesce("mined", F.lit(default)).alias("verdict"), "confidence"
    )
    return decided.unionByName(rest).select(columns)
