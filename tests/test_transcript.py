"""Segments folded over blocks equal the plain fold, however the blocks lie."""

from __future__ import annotations

import random

import pytest

from lexloom.operators import media, transcript


def _plain(rows, limit):
    out, videos = [], {}
    for video, start, seconds, text in rows:
        videos.setdefault(video, []).append((start, seconds, text))
    for video, entries in videos.items():
        segment, n = media.OpenSegment(), 0
        found = [segment.add(s, d, t, limit) for s, d, t in sorted(entries, key=lambda e: (e[0], e[2] is not None, e[2] or ""))] + [segment.close()]
        for start, text, entries_of in filter(None, found):
            n += 1
            out.append((video, n, start, text, entries_of))
    return sorted(out, key=repr)


def _rows(seed, videos, n):
    rng = random.Random(seed)
    texts = ["word", "two words", " ", "", None, " pad "] if seed % 2 else ["a", "b "]
    return [(rng.choice(videos), float(i), rng.choice([0.0, None, 0.1, 3.3, 20.0, 95.0]), rng.choice(texts)) for i in range(n)]


@pytest.mark.parametrize("seed", range(6))
def test_chained_summaries_equal_the_plain_fold(seed):
    """Without Spark: every cut of one video into blocks leads to the states of the plain fold."""
    rng = random.Random(seed)
    entries = [(d or 0.0, t or "") for _, _, d, t in _rows(seed, [1], 120)]
    for _ in range(60):
        cuts = sorted(rng.sample(range(1, 120), rng.randint(0, 30)))
        number, clock, seen, state, count = 0, None, False, None, 0
        for a, b in zip([0, *cuts], [*cuts, 120]):
            (number, clock, seen), _ = transcript.summary(entries[a:b], 90.0).after(number, clock, seen, 90.0)
            for e in entries[a:b]:
                state, closed = transcript.step(state, *e, 90.0)
                count += bool(closed and closed.seen)
            assert (number, clock) == (count, state and state.clock) and (state is None or seen == state.seen)


@pytest.mark.parametrize(("block", "videos"), [(10**6, [1, 2, None]), (7, [1, 1, 1, 2, 3, None]), (1, [5])])
def test_blocks_of_any_size(spark, block, videos):
    rows = _rows(block, videos, 150) + [(9, 0.0, 5.0, "alone"), (9, 0.0, 5.0, "alone"), (10, 1.0, 1.0, " "), (10, 2.0, 1.0, "")]
    frame = spark.createDataFrame(rows, "video_id int, start double, duration double, text string").repartition(3)
    got = transcript.fold(frame, 90.0, block)
    assert sorted((tuple(r) for r in got.select("video_id", "segment", "start", "text", "n_entries").collect()), key=repr) == _plain(rows, 90.0)
    assert transcript.fold(frame.limit(0), 90.0).collect() == []
