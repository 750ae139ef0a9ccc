"""Structured Streaming on top of the batch operators: incremental ingest and live transcript segments."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ingest import ingest
from ..operators.media import SEGMENT_SECONDS, OpenSegment
from ..operators.store import CollectionStore


def ingest_stream(documents: DataFrame, store: CollectionStore, name: str, checkpoint: str, once: bool = True, prepare: Callable[[DataFrame], DataFrame] = ingest) -> StreamingQuery:
    """Chunk, embed and upsert each micro-batch; unchanged chunks write nothing, so replays are harmless."""

    def batch(rows: DataFrame, _: int) -> None:
        store.upsert(name, prepare(rows))

    writer = documents.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()


def feedback_rates(log: DataFrame, delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Positive feedback by collection and window, late rows dropped behind the watermark."""
    rows = log.withColumn("ts", F.to_timestamp("timestamp")).withWatermark("ts", delay)
    return rows.groupBy(F.window("ts", width), "collection").agg(F.count("*").alias("n"), F.avg((F.col("label") == 1).cast("double")).alias("positive_ratio"))


def segment_stream(entries: DataFrame, limit: float = SEGMENT_SECONDS, idle_ms: int = 600_000) -> DataFrame:
    """N10 on a stream of (video_id, start, duration, text): a segment leaves once it is full, the rest when idle.

    The state of a video is its open segment alone. Entries of one video are expected in order across
    micro-batches and are sorted within one.
    """

    def step(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        begin, clock, words = state.get if state.exists else (0.0, 0.0, "")
        segment, closed = OpenSegment(begin, clock, [words] if words else []), []
        if state.hasTimedOut:
            state.remove()
            closed.append(segment.close())
        else:
            rows = pd.concat(list(parts)).sort_values(["start", "text"], kind="stable")
            closed += [segment.add(float(s), None if pd.isna(d) else float(d), t, limit) for s, d, t in zip(rows["start"], rows["duration"], rows["text"])]
            state.update((float(segment.start), segment.clock, " ".join(segment.parts)))
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame([(key[0], start, text) for start, text, _ in filter(None, closed)], columns=["video_id", "start", "text"])

    return entries.groupBy("video_id").applyInPandasWithState(step, "video_id long, start double, text string", "begin double, seconds double, words string", "append", GroupStateTimeout.ProcessingTimeTimeout)
