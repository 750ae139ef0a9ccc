"""The pipeline's stages, one by one, against plain restatements on a small corpus."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from lexloom.llm import lattice, pii, quality


def _shingles(text: str) -> set:
    w = text.split()
    n = min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def _corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    docs, labels = [], []
    for i in range(150):
        if i % 5 == 0:
            text, good = " ".join(word() + "###" for _ in range(40)), 0
        elif i % 5 == 1 and i > 5:
            text, good = docs[2][1] + (" tail" if i % 2 else ""), 1
        else:
            text, good = " ".join(word() for _ in range(40)), 1
        if i % 7 == 2:
            text += f" mail me{i}@site.example.com now"
        docs.append((i, text, "en", "big" if i % 3 else f"s{i % 2}", len(text)))
        labels.append((i, good, 0))
    docs += [(900, None, None, None, None), (901, "", "en", "big", 0), docs[3]]
    return docs, labels


def test_every_stage(spark, tmp_path):
    docs, labels = _corpus()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    sf, frame, seen = str(tmp_path), None, []
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frame, sf)
        out.write.parquet(f"{tmp_path}/{i}")
        before, frame = frame, spark.read.parquet(f"{tmp_path}/{i}")
        seen.append((name, before.collect(), frame.collect()))
        if i < 4:
            assert frame.columns == corpus_pipeline.COLUMNS
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and names[1] == "near-duplicate removal"

    # quality: junk goes, clean documents stay
    _, given, kept = seen[0]
    junk = {r.doc_id for r in given if r.text and "###" in r.text}
    assert not junk & {r.doc_id for r in kept} and {r.doc_id for r in given if r.text} - junk <= {r.doc_id for r in kept}

    # near-duplicates: one of each class of five-word shingles at 0.8
    _, given, kept = seen[1]
    rows = sorted({(r.doc_id, r.text or "") for r in given})
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, (i, a) in enumerate(rows):
        for j, b in rows[:n]:
            x, y = _shingles(a), _shingles(b)
            if (len(x & y) / len(x | y) if x | y else 1.0) >= 0.8:
                p, q = sorted((root(i), root(j)))
                parent[q] = p
    assert sorted(r.doc_id for r in kept) == sorted({root(i) for i in parent})
    assert len(kept) < len(rows)

    # personal data: addresses are gone, other documents unchanged
    _, given, kept = seen[2]
    text = {r.doc_id: r.text for r in given}
    for r in kept:
        spans = pii.base_spans(text[r.doc_id] or "")
        if spans:
            (_, s, e), *_ = spans
            assert r.text == text[r.doc_id][:s] + "[EMAIL]" + text[r.doc_id][e:] and r.n_chars == len(r.text)
        else:
            assert r.text == text[r.doc_id]
    assert any("[EMAIL]" in (r.text or "") for r in kept) and len(kept) == len(given)

    # mixing: every source within its budget, at most two copies of a document
    _, given, kept = seen[3]
    tokens = lambda rs: sum((Counter({r.source: len((r.text or "").split())}) for r in rs), Counter())
    have, drawn = tokens(given), tokens(kept)
    assert all(drawn[s] <= corpus_pipeline.REPEATS * have[s] + 1 for s in have)
    assert sum(drawn.values()) <= sum(have.values()) + 1 and sum(drawn.values()) > 0.8 * sum(have.values())
    assert max(Counter(r.doc_id for r in kept).values()) <= 2

    # encoding: every row's ids decode to its text
    _, given, kept = seen[4]
    table = lattice.load()
    expect = Counter((r.doc_id, r.text or "") for r in given)
    assert Counter((r.doc_id, table.decode(r.ids) if r.ids else "") for r in kept) == expect


def test_the_whole_run(spark, tmp_path):
    docs, labels = _corpus()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert rows and all(r.round_trip for r in rows)


def test_stages_take_empty_tables_odd_rows_and_clashing_columns(spark, tmp_path):
    docs, labels = _corpus()
    long = "river bank " * 30_000
    docs += [(950, long, "en", "big", len(long)), (None, "no id here", None, None, None), (None, "no id here", None, None, None), (951, "\n \t", "en", "s9", 3), docs[5], docs[5]]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    frame = spark.createDataFrame(docs, schema)
    for name in ("score", "predicted", "held_out", "class_id", "key", "tokens", "epoch", "copy", "times", "ids", "round_trip", "label", "rep", "base", "found"):
        frame = frame.withColumn(name, F.lit("clash"))
    frame.write.parquet(f"{tmp_path}/odd")
    spark.createDataFrame(docs[:0], schema).write.parquet(f"{tmp_path}/none")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        empty = stage(spark, spark.read.parquet(f"{tmp_path}/none"), str(tmp_path))
        assert empty.collect() == []
        out = stage(spark, spark.read.parquet(f"{tmp_path}/odd"), str(tmp_path))
        rows = out.collect()
        assert rows
        if i < 4:
            assert out.columns == corpus_pipeline.COLUMNS == empty.columns
        given = Counter(d[0] for d in docs)
        seen = Counter(r.doc_id for r in rows)
        if i in (2, 4):
            assert seen == given
        elif i == 1:
            assert seen[None] == 2 and all(n == 1 for d, n in seen.items() if d is not None)
        elif i == 0:
            assert seen[950] == 1 and seen[None] == 2
        elif i == 3:  # every row of the sources that are drawn whole, null ids too
            key = lambda r: (r[0], r[1], r[3])
            drawn, have = Counter(map(key, rows)), Counter(map(key, docs))
            assert not set(drawn) - set(have) and drawn[None, "no id here", None] >= 2


def test_mixing_draws_every_row_of_one_source(spark):
    """One source gets one whole pass: exactly the rows given, with null ids, null texts and repeated rows."""
    docs = [(i if i > 2 else None, f"words of {i % 4 if i < 8 else i}", "en", "one", 1) for i in range(10)]
    docs += [docs[5], (20, None, None, "one", None), (None, None, None, "one", None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    rows = corpus_pipeline.mixing_stage(spark, frame, "").collect()
    assert Counter(map(tuple, rows)) == Counter(docs)


def test_accuracy_is_high_on_held_out_documents():
    """The classifier on features alone, as the stage uses it."""
    docs, labels = _corpus()
    cache = {}
    marked = [(*quality.features(t, cache), y) for (_, t, *_), (_, y, _) in zip(docs, labels)]
    weights = quality.fit(marked[:110])
    right = [((share @ weights[ids] + weights[-1]) > 0) == bool(y) for ids, share, y in marked[110:]]
    assert sum(right) >= 0.95 * len(right)
