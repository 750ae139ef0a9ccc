"""A fold that starts anew at each segment, over blocks of a long transcript.

Entries are sorted by video and time and cut into blocks. What a block does to the one video that may reach into it depends
only on the entry state: no open segment, or one whose clock has run for some seconds. An open segment closes at one of the
block's first few entries, and from there on nothing of the state is left; so a block is summed up by those entries and,
for each place where the segment may close, by what the rest of the block leaves behind. The summaries are chained on the
driver, a row a block; then all blocks are folded at once from their true states, and the pieces of segments that cross
blocks are joined.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import materialise, ship_package

#: Entries of a block, about.
BLOCK = 100_000
Entry = tuple[float, str]


class Open(NamedTuple):
    """A segment that is still growing: its clock, and whether it has any text but blanks."""

    clock: float
    seen: bool


def step(state: Open | None, seconds: float, text: str, limit: float) -> tuple[Open | None, Open | None]:
    """(state after an entry, segment that it closed). The entry that opens a segment never closes it; an empty text opens none."""
    if state is None:
        return (Open(seconds, bool(text.strip())) if text else None), None
    grown = Open(state.clock + seconds, state.seen or bool(text.strip()))
    return (None, grown) if grown.clock >= limit else (grown, None)


class Summary(NamedTuple):
    """What a video's entries in one block do to an entry state."""

    head: list[tuple[float, bool]]  # seconds and text-or-blank of the entries at one of which an open segment closes
    exits: list[tuple[int, float | None, bool]]  # after closing there: segments counted, clock of the open one (None: none), its seen
    fresh: tuple[int, float | None, bool]  # the same from no open segment

    def after(self, number: int, clock: float | None, seen: bool, limit: float) -> tuple[tuple[int, float | None, bool], bool]:
        """The exit state (segments so far, clock, seen) of an entry state, and whether the same segment is still open."""
        if clock is None:
            n, out, flag = self.fresh
            return (number + n, out, flag), False
        for (seconds, some), (n, out, flag) in zip(self.head, self.exits, strict=True):
            clock, seen = clock + seconds, seen or some
            if clock >= limit:
                return (number + seen + n, out, flag), False
        return (number, clock, seen), True


def summary(entries: list[Entry], limit: float) -> Summary:
    n, known = len(entries), {len(entries): (0, None, False)}

    def leaves(p: int) -> tuple[int, float | None, bool]:
        """From no open segment in front of entry p. Walks from different places soon meet, so each is walked once."""
        path = []
        while p not in known:
            state, i, closed = None, p, None
            while i < n and closed is None:
                state, closed = step(state, *entries[i], limit)
                i += 1
            if closed is None:
                known[p] = (0, None, False) if state is None else (0, state.clock, state.seen)
                break
            path.append((p, closed.seen))
            p = i
        for at, seen in reversed(path):
            count, clock, flag = known[p]
            known[at] = (count + seen, clock, flag)
            p = at
        return known[p]

    head, places, total, some = [], [], 0.0, False
    for i, (seconds, text) in enumerate(entries):
        total, some = total + seconds, some or bool(text.strip())
        if seconds or i in (0, n - 1):  # others without duration close nothing; their texts count with the next
            head.append((seconds, some))
            places.append(i + 1)
            some = False
        if total >= limit:
            break
    return Summary(head, [leaves(p) for p in places], leaves(0))


def _videos(table: pa.Table) -> Iterator[tuple[object, list[Entry], list[float]]]:
    """(video, entries, starts) of a block, in order."""
    rows = table.sort_by("_at")
    ids, starts = rows["video_id"].to_pylist(), rows["start"].to_pylist()
    entries = [(d or 0.0, t or "") for d, t in zip(rows["duration"].to_pylist(), rows["text"].to_pylist(), strict=True)]
    at = 0
    for i in range(1, len(ids) + 1):
        if i == len(ids) or ids[i] != ids[at]:
            yield ids[at], entries[at:i], starts[at:i]
            at = i


def _summed(limit: float, id_type: pa.DataType):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        parts = list(_videos(table))
        chosen = [parts[0]] if len(parts) == 1 else [parts[0], parts[-1]]
        found = [summary(e, limit) for _, e, _ in chosen]
        exits = pa.list_(pa.struct({"n": pa.int64(), "clock": pa.float64(), "seen": pa.bool_()}))
        as_rows = lambda xs: [{"n": a, "clock": b, "seen": c} for a, b, c in xs]
        return pa.table(
            {
                "_block": pa.array([key[0].as_py()] * len(found), pa.int32()),
                "video_id": pa.array([v for v, _, _ in chosen], id_type),
                "head": pa.array([[{"d": a, "some": b} for a, b in s.head] for s in found], pa.list_(pa.struct({"d": pa.float64(), "some": pa.bool_()}))),
                "exits": pa.array([as_rows(s.exits) for s in found], exits),
                "fresh": pa.array([as_rows([s.fresh]) for s in found], exits),
                "nth": pa.array(list(range(len(found))), pa.int32()),
            }
        )

    return run


def _folded(states: dict[int, tuple[int, float | None, bool, int]], limit: float, id_type: pa.DataType):
    """Pieces of segments: (video_id, opened, segment, start, text, n_entries, whole, _block); ``opened`` is the block of their first entry."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        block, rows = key[0].as_py(), []
        number, clock, seen, opened = states[block]
        for nth, (video, entries, starts) in enumerate(_videos(table)):
            if nth:
                number, clock = 0, None
            state = None if clock is None else Open(clock, seen)
            came_in, parts, first = state is not None, [], None
            for (seconds, text), start in zip(entries, starts, strict=True):
                opens = state is None
                state, closed = step(state, seconds, text, limit)
                if opens and state is not None:
                    parts, first, came_in = [], start, False
                if state is None and closed is None:
                    continue
                parts.append(text)
                if closed is not None:
                    if closed.seen or came_in:
                        rows.append((video, opened if came_in else block, number + 1, first, " ".join(parts), len(parts), not came_in))
                    number += closed.seen
                    parts, came_in = [], False
            if parts:
                rows.append((video, opened if came_in else block, number + 1, first, " ".join(parts), len(parts), False))
        kinds = [id_type, pa.int32(), pa.int64(), pa.float64(), pa.string(), pa.int32(), pa.bool_()]
        columns = zip(*rows, strict=True) if rows else [[]] * 7
        names = ["video_id", "opened", "segment", "start", "text", "n_entries", "whole"]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names).append_column("_block", pa.array([block] * len(rows), pa.int32()))

    return run


def chain(rows: list, limit: float) -> dict[int, tuple[int, float | None, bool, int]]:
    """Entry state of each block (segments so far, clock, seen, block where the open segment began) from summaries."""
    states, carry, by = {}, None, {}
    for r in rows:
        by.setdefault(r["_block"], []).append(r)
    for block in sorted(by):
        own = sorted(by[block], key=lambda r: r["nth"])
        fresh = (0, None, False, block)
        states[block] = carry[1] if carry is not None and carry[0] == own[0]["video_id"] else fresh
        *entry, opened = states[block] if len(own) == 1 else fresh
        last = own[-1]
        summed = Summary([(x["d"], x["some"]) for x in last["head"]], [tuple(x) for x in last["exits"]], tuple(last["fresh"][0]))
        out, same = summed.after(*entry, limit)
        carry = last["video_id"], (*out, opened if same else block)
    return states


def fold(entries: DataFrame, limit: float, block: int | None = None) -> DataFrame:
    """(video_id, segment, start, text, n_entries) from (video_id, start, duration, text); see media.transcript_segments.

    Repeated entries count one by one. Durations aren't negative; a null one counts as 0, a null text as empty.
    """
    spark = entries.sparkSession
    ship_package(spark)
    size = block or BLOCK
    rows = entries.select("video_id", F.col("start").cast("double").alias("start"), F.col("duration").cast("double").alias("duration"), "text")
    parts = max(1, math.ceil(rows.count() / size))
    order = ["video_id", "start", "text"]
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ordered = materialise(ordered.withColumns({"_block": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "transcript")
    kind = dict(rows.dtypes)["video_id"]
    id_type = rows.select("video_id").limit(0).toArrow().schema.field(0).type
    exits = "array<struct<n:bigint,clock:double,seen:boolean>>"
    found = ordered.groupBy("_block").applyInArrow(_summed(limit, id_type), f"_block int, video_id {kind}, head array<struct<d:double,some:boolean>>, exits {exits}, fresh {exits}, nth int").collect()  # two rows a block
    pieces = ordered.groupBy("_block").applyInArrow(_folded(chain(found, limit), limit, id_type), f"video_id {kind}, opened int, segment long, start double, text string, n_entries int, whole boolean, _block int")
    pieces = materialise(pieces, "pieces")
    columns = ["video_id", "segment", "start", "text", "n_entries"]
    # At the end of a block one segment of a video is open at most, so the block where it began names it.
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_block", "text"))), lambda x: x["text"]), " ")
    cut = pieces.where("NOT whole").groupBy("video_id", "opened").agg(F.max("segment").alias("segment"), F.max("start").alias("start"), text.alias("text"), F.sum("n_entries").cast("int").alias("n_entries"))
    whole, joined = pieces.where("whole").select(columns), cut.select(columns)
    out = whole.unionByName(joined).withColumn("text", tx.strip(F.col("text"))).where("text <> ''")
    return out.withColumn("segment", F.col("segment").cast("int"))
