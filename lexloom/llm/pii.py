"""Personal data: checked patterns, and contextual extraction bootstrapped from what they find.

Checked patterns find the seed entities: four kinds of personal data, and secrets of published key formats or
digests in quotes. Every seed, and every other identifier-like token or run of digit groups (an ``@``, or four
digits and more), is an instance. It stands in up to five lexical patterns: the word before it, the two words before
it, the words on both sides, its shape (runs of letters and digits generalised), and its shape behind ``=`` or ``:``.

Instances and patterns form a bipartite graph that Spark scores in rounds until the scores settle: a pattern is
as sure of a kind as the share of its distinct instances, each by its score; an instance as sure as its
patterns together (noisy-or). Candidates that a check refused (a card number of a wrong sum, an address part
over 255) never become known, so they speak against the patterns they stand in. Instances that end up sure
enough are marked wherever they stand.
"""

from __future__ import annotations

import hashlib
import re
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, texts

#: Kinds with a base pattern; the kind that seeds and contexts add.
KINDS, SECRET = ["email", "ip", "card", "phone"], "secret"
ALL_KINDS = [*KINDS, SECRET]
#: Distinct known instances that a pattern needs, the score from which an instance is marked, the least
#: confidence of a pattern that counts, what is added to a pattern's instances, and the rounds after which scores that
#: still move are reported.
MIN_SUPPORT, MIN_CONFIDENCE, WEAK, SMOOTHING, ROUNDS = 5, 0.85, 0.3, 0.1, 50
#: Words before an identifier that name its context.
CONTEXT = 2
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match never starts inside a run of digits: the lookbehind only spares the retries there.
_ip = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Seeds of secrets: published formats of access keys, and digests of usual lengths that are a quoted or assigned value.
_key = re.compile(r"(?<![0-9A-Za-z_])(?:AKIA[0-9A-Z]{16}|gh[opsu]_[0-9A-Za-z]{36}|(?<=[\"'=])(?=[0-9]*[a-f])(?=[a-f]*[0-9])(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32}))(?![0-9A-Za-z_])")
_token = re.compile(r"(?<!\S)\S*(?:@|[0-9])\S*")
# Digit groups of whole words, joined by space, dash, dot or parentheses; else one token.
_join = r"(?:[.-]?\(|\x20(?:-\x20)?\(?|\)(?:\x20?-\x20?|[\x20.])?|[.-])"
_candidate = re.compile(r"(?<!\S)[\"'\[{<#*]*+(?P<run>\+?\(?[0-9]++(?:%s[0-9]++)+)(?=[.,;:!?\"')\]}>*]*+(?:\s|$))|%s" % (_join, _token.pattern))
_digits, _letters = re.compile(r"[0-9]+"), re.compile(r"[^\W\d_]+")
_opaque = re.compile(r"(?=[A-Za-z]*[0-9])(?=[0-9]*[A-Za-z])[0-9A-Za-z]{12,}")
_next = re.compile(r"[^\s\w]{0,8}[^\S\n]+(\S+)")
#: What stands for the missing words of a context at a line's start; no word holds it.
LINE_START = "\n"
_TRIM = ".,;:!?\"'()[]{}<>#$%&*"


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each ``@`` outwards: linear in the text."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and at >= end and (m := _domain.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start; positions are code points, the end exclusive."""
    out = [("email", s, e) for s, e in emails(text)]
    for m in _ip.finditer(text):
        if all(int(p) <= 255 for p in (q.lstrip("0")[:4] or "0" for q in m[0].split("."))):
            out.append(("ip", m.start(), m.end()))
    for m in _card.finditer(text):
        if 16 <= m.end() - m.start() <= 40 and 16 <= len(d := re.sub(r"[\x20-]", "", m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _phone.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def secrets(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Seeds of secrets outside the base spans, in order; one sweep over both."""
    out, places, i, reach = [], sorted((s, e) for _, s, e in spans), 0, 0
    for m in _key.finditer(text):
        while i < len(places) and places[i][0] < m.end():
            reach, i = max(reach, places[i][1]), i + 1
        if reach <= m.start():
            out.append((SECRET, *m.span()))
    return out


def refused(token: str) -> bool:
    """Whether a token looks like one of the base kinds but failed its check."""
    if _ip.fullmatch(token) or "@" in token:
        return True
    digits = sum("0" <= c <= "9" for c in token)
    if token.startswith("+"):
        return bool(_phone.fullmatch(token))
    return 13 <= digits <= 19 and bool(_card.fullmatch(token)) and not luhn(re.sub(r"[\x20-]", "", token))


def shape(token: str) -> str:
    """A token with its letters and digits generalised; opaque mixtures of both by their alphabet alone."""
    if _opaque.fullmatch(token):
        return "hex" if re.fullmatch(r"[0-9a-f]+", token) else "upper" if token.upper() == token else "lower" if token.lower() == token else "mixed"
    out = _letters.sub("a", _digits.sub(lambda m: f"9{{{len(m[0])}}}", token))
    return out if len(out) <= 64 else hashlib.blake2b(out.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


class _Contexts:
    """The last words before places of a text on their line, lower-cased; LINE_START where the line has fewer.

    Places come in ascending order. What was scanned is remembered and words of more than LONG characters are
    named by a running digest, so one very long word with many places stays linear.
    """

    LONG = 64

    def __init__(self, text: str):
        self.text, self.words, self.gaps, self.sums = text, {}, {}, {}

    def _back(self, end: int, gap: bool) -> int:
        known, at = self.gaps if gap else self.words, end
        while at > 0 and at not in known and (c := self.text[at - 1]).isspace() == gap and c != "\n":
            at -= 1
        known[end] = at = known.get(at, at)
        return at

    def _name(self, start: int, end: int) -> str:
        if end - start <= self.LONG:
            return self.text[start:end].lower()
        done, running = self.sums.get(start, (start, hashlib.blake2b(digest_size=16)))
        if end > done:
            running.update(self.text[done:end].lower().encode("utf-8", "surrogatepass"))
            self.sums[start] = end, running
        return running.hexdigest()

    def before(self, start: int) -> tuple[str, str]:
        """The last word before a place with the marks behind it, and the last two words."""
        words, at, named, near = [], start, 0, ""
        while named < CONTEXT and len(words) < 3 * CONTEXT:
            end = self._back(at, True)
            at = self._back(end, False)
            if at == end:
                words.append(LINE_START)
                named = CONTEXT
            else:
                words.append(self._name(at, end))
                named += any(map(str.isalnum, words[-1]))
            near = near or (" ".join(reversed(words)) if named else "")
        far = " ".join(reversed(words))
        return near or far, far


def _patterns(contexts: _Contexts, start: int, end: int) -> list[str]:
    text = contexts.text
    near, far = contexts.before(start)
    form = shape(text[start:end])
    out = [f"word {near}", f"words {far}", f"shape {form}"]
    if follows := _next.match(text, end):
        word = follows[1].lower()
        out.append(f"between {near} | {word if len(word) <= contexts.LONG else _number(word)}")
    at = start
    while at and start - at < 4 and text[at - 1] in "\"' ":
        at -= 1
    if at and text[at - 1] in "=:":
        out.append(f"value {text[at - 1]} {form}")
    return list(dict.fromkeys(out))


def _number(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def mentions(text: str, seeds: list[tuple[str, int, int]]) -> list[tuple[int, int, str | None, bool, int, list[str]]]:
    """(start, end, kind or None, refused, instance, patterns) of seeds, and of identifier-like tokens outside them.

    The instance is a hash of the lower-cased token.
    """
    out = [(s, e, kind, False) for kind, s, e in seeds]
    taken = sorted((s, e) for _, s, e in seeds)
    i = 0

    def add(s: int, e: int) -> bool:
        nonlocal i
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        if i < len(taken) and taken[i][0] < e:
            return False
        if "@" in (token := text[s:e]) or sum("0" <= c <= "9" for c in token) >= 4 or _opaque.fullmatch(token):
            out.append((s, e, None, refused(token)))
        return True

    for m in _candidate.finditer(text):
        if m["run"]:
            s, e = m.span("run")
            if text[s] == "(" and text.find(")", s, e) < 0:
                s += 1
            if add(s, e):
                continue
        for t in _token.finditer(text, m.start(), m.end()):
            s, e = t.span()
            while e > s and text[e - 1] in _TRIM:
                e -= 1
            s = max(s, text.rfind("=", s, e) + 1, text.rfind(":", s, e) + 1)  # the value behind a label
            while s < e and text[s] in _TRIM:
                s += 1
            add(s, e)
    contexts = _Contexts(text)
    return [(s, e, kind, no, _number(text[s:e].lower()), _patterns(contexts, s, e)) for s, e, kind, no in sorted(out, key=lambda m: m[0])]


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
_MENTION = pa.struct(
    [("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("refused", pa.bool_()), ("instance", pa.int64()), ("patterns", pa.list_(pa.string()))]
)
_SPANS = "array<struct<kind:string,start:int,end:int>>"
SCANNED = (
    f"doc_id long, key long, base {_SPANS}, keys {_SPANS}, "
    "mentions array<struct<start:int,end:int,kind:string,refused:boolean,instance:long,patterns:array<string>>>"
)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spans = lambda rows: pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in r] for r in rows], pa.list_(_SPAN))
    names = [f.name for f in _MENTION]
    for batch in batches:
        base, keys, found = [], [], []
        for text in texts(batch["text"]):
            base.append(base_spans(text))
            keys.append(secrets(text, base[-1]))
            found.append([dict(zip(names, m)) for m in mentions(text, base[-1] + keys[-1])])
        yield pa.record_batch([batch["doc_id"], batch["key"], spans(base), spans(keys), pa.array(found, pa.list_(_MENTION))], names=["doc_id", "key", "base", "keys", "mentions"])


def score_graph(
    edges: DataFrame, nodes: DataFrame, min_support: int = MIN_SUPPORT, weak: float = WEAK, rounds: int = ROUNDS
) -> tuple[DataFrame, DataFrame]:
    """Scores of the graph of distinct ``edges`` (pattern, instance) and ``nodes`` (instance, kind, refused).

    Returns (pattern, kind, confidence) and (instance, kind, score) of instances that are neither seeds nor refused.
    Counts are over distinct instances, so copies of one document don't make a pattern surer. Rounds end when
    the sum of the scores moves by less than a thousandth; if it still does after ``rounds``, a warning says so. Patterns of fewer
    than min_support instances can never count and are left out before the first round.
    """
    size = edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= min_support)
    edges = materialise(edges.join(size, "pattern").join(nodes, "instance"), "edges")
    seeds = F.struct(F.col("kind"), F.lit(1.0).alias("score"))
    scored, before, patterns, found = edges.where("kind IS NOT NULL").select("pattern", "n", seeds.alias("s")), -1.0, None, None
    for step in range(rounds):
        sums = scored.groupBy("pattern", "n", "s.kind").agg(F.sum("s.score").alias("sum"), F.count_if(F.col("s.score") >= 0.5).alias("support"))
        sums = sums.withColumn("confidence", F.col("sum") / (F.col("n") + F.lit(SMOOTHING)))
        patterns = materialise(sums.where((F.col("support") >= min_support) & (F.col("confidence") >= weak)).select("pattern", "kind", "confidence"), f"patterns_{step}")
        open_edges = edges.where("kind IS NULL AND NOT refused").select("pattern", "instance", "n")
        votes = open_edges.join(patterns, "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score"))
        best = votes.groupBy("instance").agg(F.max(F.struct("score", "kind")).alias("b")).select("instance", "b.kind", "b.score")
        last, found = found, materialise(best, f"instances_{step}")
        if last is not None:
            discard(last)  # both tables of this round are written; nothing reads that of the round before
        now = found.agg(F.sum("score")).first()[0] or 0.0
        if abs(now - before) <= 1e-3 * max(1.0, now):
            break
        before = now
        again = open_edges.join(found.select("instance", F.struct("kind", "score").alias("s")), "instance").select("pattern", "n", "s")
        scored = edges.where("kind IS NOT NULL").select("pattern", "n", seeds.alias("s")).unionByName(again)
    else:
        warnings.warn(f"scores of the graph still moved after {rounds} rounds", stacklevel=2)
    return patterns, found


def find(documents: DataFrame, min_confidence: float = MIN_CONFIDENCE, **limits) -> DataFrame:
    """(doc_id, key, base, keys, found) for every row of ``documents`` (doc_id, text); key is a hash of the text.

    base, keys (seeds of secrets) and found (what the graph marks besides) are arrays of (kind, start, end), sorted by
    kind as listed, then start. Null and empty texts have none. Repeated rows each get their row; documents with one
    id and other texts are told apart by key. Other columns are ignored. Very long texts are scanned whole; all
    patterns are linear in the text. Of equal scores the kind later in the alphabet wins. An empty table gives no rows.
    """
    keyed = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"))
    scanned = materialise(keyed.mapInArrow(_scan, SCANNED), "pii")
    all_mentions = scanned.where(F.size("mentions") > 0).select("doc_id", "key", F.explode("mentions").alias("m")).select("doc_id", "key", "m.*")
    edges = all_mentions.select(F.explode("patterns").alias("pattern"), "instance").distinct()
    nodes = all_mentions.groupBy("instance").agg(F.min("kind").alias("kind"), F.max("refused").alias("refused"))
    _, scores = score_graph(edges, nodes, **limits)
    sure = scores.where(F.col("score") >= min_confidence).select("instance", F.col("kind").alias("found"))
    new = (
        all_mentions.where("kind IS NULL")
        .select("doc_id", "key", "start", "end", "instance")
        .join(sure, "instance")
        .groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key"))
        .agg(_ordered(F.collect_set(F.struct(F.col("found").alias("kind"), "start", "end"))).alias("found"))
    )
    at = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))
    return scanned.join(new, at, "left").select("doc_id", "key", "base", "keys", F.coalesce("found", F.array().cast(_SPANS)).alias("found"))


def _ordered(spans: Column) -> Column:
    place = F.create_map(*[F.lit(x) for i, k in enumerate(ALL_KINDS) for x in (k, i)])
    tagged = F.transform(spans, lambda s: F.struct(place[s["kind"]].alias("o"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(tagged), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def all_spans() -> Column:
    """Every span of a row of ``find``."""
    return _ordered(F.array_union(F.array_union("base", "keys"), "found"))


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with spans (start, end, kind) replaced by ``[KIND]``; one that starts within an earlier one joins it."""
    pieces, at = [], 0
    for start, end, kind in sorted(spans):
        if start >= at:
            pieces += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*pieces, text[at:]])


def _redact(column: pa.Array, spans: pa.Array) -> pa.Array:
    """The texts that have spans; null for others, which Spark doesn't send."""
    done = []
    for text, own in zip(column, spans, strict=True):
        done.append(redacted(text.as_py() or "", [(s["start"], s["end"], s["kind"]) for s in own.as_py()]) if own.is_valid else None)
    return pa.array(done, pa.string())


def redact(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """``documents`` with every span of ``find`` replaced by ``[KIND]``; overlapping spans become one.

    Only documents with spans are joined and rewritten; all others pass unchanged. Null ids match too.
    """
    wanted = spans.where(F.size("base") + F.size("keys") + F.size("found") > 0).select(
        F.col("doc_id").alias("_id"), F.col("key").alias("_key"), all_spans().alias("_spans")
    ).dropDuplicates(["_id", "_key"])
    df = documents.withColumn("_text_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    hit = df.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_key")), "left")
    has = F.col("_spans").isNotNull()
    rewrite = F.arrow_udf(_redact, "string")
    done = F.when(has, rewrite(F.when(has, F.col("text")), F.col("_spans"))).otherwise(F.col("text"))
    out = hit.withColumn("text", done)
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.when(F.col("_spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(documents.columns)
