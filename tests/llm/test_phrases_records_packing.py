"""Phrase mining, golden records and packing against plain restatements, and on odd rows."""

from __future__ import annotations

import datetime as dt
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import collocations, golden, packing

DOCS = "doc_id long, text string, lang string, score long, rank int, id long, key long, lane int"


def _phrases(rows, least, top=2000):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for k in range(1, 5):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        frequent = {p: a for p, a in f.items() if a >= least}
        covered = {p[i : i + k] for p, a in frequent.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= 80 * frequent[p[i : i + k]]}
        found = []
        for p, a in frequent.items():
            if len(p) > 1 and p not in covered:
                score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


def _texts(seed=3):
    rng = random.Random(seed)
    pool = ["the", "The", "sea", "of", "état", "x y", "a-b", "\U0001f600", "zz"]
    rows = [(" ".join(rng.choice(pool) + rng.choice(["", "", "", ".", "\n", "\t"]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "fr", None, "und"])) for _ in range(60)]
    rows += [(None, "en"), ("", None), (" \n\t.", "en"), ("The sea of zz " * 4000, "en"), rows[0], rows[0]]
    return rows


def _frame(spark, rows):
    return spark.createDataFrame([(i if i % 7 else None, t, l, 1, 2, 3, 4, 5) for i, (t, l) in enumerate(rows)], DOCS).repartition(3)


@pytest.mark.parametrize("part", [1_000_000, 3])
def test_phrases_equal_a_plain_count(spark, monkeypatch, part):
    """Also where a level's table travels in many parts."""
    monkeypatch.setattr(collocations, "PART_ROWS", part)
    rows = _texts()
    got = collocations.mine(_frame(spark, rows), least=5)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == _phrases(rows, 5)


def test_numbers_beyond_31_bits_keep_pairs_apart():
    rng = np.random.default_rng(5)
    ids = rng.integers(0, 4, 500) * (1 << 33) + rng.integers(0, 3, 500)
    ids[rng.random(500) < 0.1] = -1
    import pyarrow as pa

    batch = pa.record_batch([collocations._blobs(ids, np.array([200, 500]))], names=["ids"])
    got = Counter()
    for b in collocations._count_pairs(iter([batch])):
        for x, y, n in zip(*(b[c].to_pylist() for c in ("x", "y", "n"))):
            got[x, y] += n
    want = Counter((int(ids[i]), int(ids[i + 1])) for i in range(499) if i != 199 and ids[i] >= 0 and ids[i + 1] >= 0)
    assert got == want
    table = pa.table({"x": [p[0] for p in want], "y": [p[1] for p in want], "id": list(range(len(want)))})
    numbers = {p: i for i, p in enumerate(want)}
    out, _ = collocations._of_pairs(batch, collocations.packed(table))
    assert out.tolist() == [numbers.get((int(ids[i]), int(ids[i + 1])), -1) if i not in (199, 499) else -1 for i in range(500) if True][:499] + [-1]


def test_phrases_of_nothing(spark):
    for rows in ([], [(None, None)], [("one two", "en")]):
        assert collocations.mine(_frame(spark, rows)).collect() == []


CLIENTS = "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double, field string, best int, lane int, stale string"


def _plain(records):
    by = defaultdict(list)
    for r in records:
        r = {k: None if isinstance(v, str) and not v.strip(" \t\n\x0b\x0c\r") else v for k, v in r.items()}
        by[r["client_id"] if r["master_id"] is None else r["master_id"]].append(r)
    none_last = lambda v: (v is None, v or 0)
    out = {}
    for cluster, rows in by.items():
        latest = max((r["updated_at"] for r in rows if r["updated_at"]), default=None)
        for r in rows:
            r["stale"] = r["updated_at"] is None or r["updated_at"] < latest - dt.timedelta(hours=1440)
            trust = golden.TRUST.index(r["source"]) if r["source"] in golden.TRUST else 4
            r["recent"] = (r["updated_at"] is None, latest - r["updated_at"] if r["updated_at"] else dt.timedelta(0), trust, none_last(r["client_id"]))
            r["trusted"] = (r["stale"], trust, r["recent"])

        def first(field, key):
            return min((r for r in rows if r[field] is not None), key=key, default={})

        segment, email = first("segment", lambda r: r["recent"]), first("email", lambda r: r["trusted"])
        name = first("name", lambda r: (-len(r["name"]), r["trusted"]))
        balance = first("balance", lambda r: (r["segment"] != segment.get("segment"), r["recent"]))
        place = min(rows, key=lambda r: (-(r["city"] is not None) - (r["nation_id"] is not None), r["trusted"]))
        given = place["city"] is not None or place["nation_id"] is not None
        out[cluster] = (
            len(rows), sum(r["stale"] for r in rows), name.get("name"), email.get("email"), segment.get("segment"), place["city"], place["nation_id"], balance.get("balance"),
            name.get("client_id"), email.get("client_id"), segment.get("client_id"), balance.get("client_id"), place["client_id"] if given else None,
        )
    return out


def test_golden_records_equal_a_plain_choice(spark):
    rng = random.Random(9)
    start = dt.datetime(2024, 1, 1)
    records = []
    for i in range(400):
        pick = lambda *v: rng.choice(v)
        master = 7 if i % 3 == 0 else rng.randint(0, 60) if rng.random() < 0.7 else None
        time = start + dt.timedelta(days=rng.randint(0, 120), microseconds=rng.choice([0, 1])) if rng.random() < 0.85 else None
        records.append(dict(
            client_id=i, master_id=master, source=pick("crm", "web", "store", "partner", "other", None, " "), updated_at=time, name=pick(None, "", " \t", "Ann", "Annè ", "\U0001f600\U0001f600", "Bo" * rng.randint(1, 4)),
            email=pick(None, "", f"{i}@a"), city=pick(None, "\n", "Ulm", " Rom"), nation_id=pick(None, 1, 2), segment=pick(None, "x", "y", "\x0b"), balance=pick(None, 0.0, -1.5, float(i)),
        ))
    # exactly 60 days is not stale, a microsecond more is; rows without ids are one cluster
    for i, gone in enumerate([dt.timedelta(0), dt.timedelta(days=60), dt.timedelta(days=60, microseconds=1)]):
        records.append(dict(records[0], client_id=1000 + i, master_id=1000, updated_at=start + dt.timedelta(days=100) - gone))
    records.append(dict(records[1], client_id=None, master_id=None, name="n" * 100_000))
    rows = [tuple(r.values()) + ("f", 1, 2, "s") for r in records]
    got = golden.survivors(spark.createDataFrame(rows, CLIENTS).repartition(5))
    names = ["n_records", "n_stale", "name", "email", "segment", "city", "nation_id", "balance", "name_from", "email_from", "segment_from", "balance_from", "address_from"]
    assert {r["cluster_id"]: tuple(r[n] for n in names) for r in got.collect()} == _plain(records)
    assert dict(got.dtypes)["nation_id"] == "int"


def test_golden_records_of_repeated_rows_and_nothing(spark):
    empty = spark.createDataFrame([], CLIENTS)
    assert golden.survivors(empty).collect() == []
    row = (1, None, "crm", dt.datetime(2024, 1, 1), "A", None, None, None, None, None, "f", 1, 2, "s")
    (got,) = golden.survivors(spark.createDataFrame([row, row], CLIENTS)).collect()
    assert (got.n_records, got.n_stale, got.name, got.name_from, got.email, got.email_from, got.address_from) == (2, 0, "A", 1, None, None, None)


def test_ids_equal_the_tokenizers_own():
    from tokenizers import Tokenizer

    file = open(packing.TOKENIZER).read()
    whole, encoder, rng = Tokenizer.from_str(file), packing.Encoder(file), random.Random(1)
    assert encoder.merges is not None
    pool = ["a", "Über", "Σ", "́", "é", "'s", "'RE", "'", " ", "\n", "\t", " ", "1", "½", "<|endoftext|>", "<|", "İ", "ß", "x²", "\x00", "\x1c", "\r", "日本", "_", "\U0001f642", "Hello", "...", "?!", "　"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 14))) for _ in range(3000)] + ["", " ", "x" * 5000]
    for at in range(0, len(texts), 250):
        part = texts[at : at + 250]
        assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(part)] == [e.ids for e in whole.encode_batch(part, add_special_tokens=False)]


def _best_fit_decreasing(lengths, capacity):
    import bisect

    gaps, opened = [], 0
    for s in sorted(lengths, reverse=True):
        i = bisect.bisect_left(gaps, s)
        if i == len(gaps):
            opened += 1
            bisect.insort(gaps, capacity - s)
        else:
            bisect.insort(gaps, gaps.pop(i) - s)
    return opened


@pytest.mark.parametrize(("capacity", "shape"), [(64, "mixed"), (64, "hot"), (50, "small"), (64, "full"), (7, "mixed")])
def test_places_have_no_holes_and_few_sequences(spark, capacity, shape):
    rng = random.Random(capacity)
    draw = {"mixed": lambda i: rng.randint(1, capacity), "hot": lambda i: 21 if i % 3 else rng.randint(1, 40), "small": lambda i: rng.randint(1, 5), "full": lambda i: capacity}[shape]
    lengths = {i * 3: draw(i) for i in range(1500)}
    placed = packing.place(spark.createDataFrame(list(lengths.items()), "key long, length long").repartition(6), capacity).collect()
    assert sorted(r.key for r in placed) == sorted(lengths)
    inside = defaultdict(list)
    for r in placed:
        inside[r.sequence_id].append((r.offset, lengths[r.key]))
    for rows in inside.values():
        end = 0
        for offset, length in sorted(rows):
            assert offset == end
            end += length
        assert end <= capacity
    assert len(inside) <= 1.02 * _best_fit_decreasing(lengths.values(), capacity) + 2


def test_packing_whole_documents(spark):
    from tokenizers import Tokenizer

    whole, rng = Tokenizer.from_file(packing.TOKENIZER), random.Random(4)
    texts = [" ".join(rng.choice(["sea", "Harbour", "x1", "don't"]) for _ in range(rng.choice([0, 1, 5, 40, 300]))) for _ in range(80)] + [None, "", "same", "same", "ab " * 900]
    rows = [(i if i != 3 else None, t, "en", 1, 2, 3, 4, 5) for i, t in enumerate(texts)] + [(82, "same", "en", 1, 2, 3, 4, 5)]
    packed = packing.pack(spark.createDataFrame(rows, DOCS).repartition(4), capacity=128)
    got = defaultdict(list)
    for r in packed.select("doc_id", "piece", "start", "length", "ids", F.crc32("ids").alias("crc")).collect():
        assert r.crc == zlib.crc32(r.ids) and r.length == len(r.ids) // 4
        got[r.doc_id].append((r.piece, r.start, np.frombuffer(r.ids, "<u4").tolist()))
    want = defaultdict(list)
    for i, text, *_ in rows:
        ids = whole.encode(text or "", add_special_tokens=False).ids + [1]
        want[i] += [(n, s, ids[s : s + 128]) for n, s in enumerate(range(0, len(ids), 128))]
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    whole_ids = Counter(i for r in packing.sequences(packed).collect() for i in np.frombuffer(r.ids, "<u4").tolist())
    assert whole_ids == Counter(i for v in want.values() for _, _, ids in v for i in ids)
    assert packing.pack(spark.createDataFrame([], DOCS)).collect() == []
