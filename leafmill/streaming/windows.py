"""Keyed windows: idle sessions and first-event-anchored rate windows, for batches and streams.

The batch forms work on a table (user_id, ts, event_id, value); the streaming forms keep
the same state per key with Structured Streaming and give the same windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE_SCHEMA = "user_id long, anchor timestamp, requests long, refused long"


def idle_sessions(events: DataFrame, timeout: str) -> DataFrame:
    """Sessions that end after `timeout` without an event. Works on a stream with a watermark too."""
    # session_window closes at ts + gap, exclusive; an event at exactly the gap goes on
    g = events.groupBy("user_id", F.session_window("ts", f"{timeout} 1 microsecond").alias("w")).agg(F.min("ts").alias("started"), F.max("ts").alias("last_seen"), F.count("*").alias("events"), F.sum("value").alias("value"))
    return g.drop("w")


def _windows(times: Iterator[pd.Timestamp], span: pd.Timedelta, limit: int, anchor=None, used: int = 0) -> tuple[list[list], tuple]:
    """Windows [anchor, requests, refused] of rising times, and the state after them."""
    out: list[list] = []
    for t in times:
        if anchor is None or t >= anchor + span:
            anchor, used = t, 0
            out.append([anchor, 0, 0])
        elif not out:
            out.append([anchor, 0, 0])
        used += 1
        out[-1][1] += 1
        out[-1][2] += bool(limit and used > limit)
    return out, (anchor, used)


def rate_windows(events: DataFrame, seconds: int, limit: int) -> DataFrame:
    """Windows of fixed length that open at a key's first request and again at the first one
    after their end: requests and those beyond the limit (0: no limit). A window's anchor
    depends on the one before, so a key's times are streamed in order; one window is held."""
    span = seconds * 1_000_000
    ordered = events.select("user_id", "ts").filter("ts IS NOT NULL").repartition("user_id").sortWithinPartitions("user_id", "ts")
    kinds = [ordered.schema[c].dataType.simpleString() for c in ("user_id", "ts")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, anchor, used, done, types = None, None, 0, [], None

        def told() -> pa.RecordBatch:
            users, anchors, requests = list(zip(*done, strict=True)) or ([], [], [])
            refused = [max(0, n - limit) if limit else 0 for n in requests]
            return pa.record_batch([pa.array(users, types[0]), pa.array(anchors, pa.int64()).cast(types[1]), pa.array(requests, pa.int64()), pa.array(refused, pa.int64())], ["user_id", "anchor", "requests", "refused"])

        for batch in batches:
            types = [c.type for c in batch.columns]
            for u, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.int64()).to_pylist(), strict=True):
                if u != user or anchor is None or t >= anchor + span:
                    if anchor is not None:
                        done.append((user, anchor, used))
                    user, anchor, used = u, t, 0
                used += 1
            yield told()
            done = []
        if anchor is not None:
            done.append((user, anchor, used))
            yield told()

    return ordered.mapInArrow(run, f"user_id {kinds[0]}, anchor {kinds[1]}, requests long, refused long")


def rate_limit_stream(events: DataFrame, seconds: int, limit: int) -> DataFrame:
    """The same on a stream: each micro-batch gives the requests and refusals that it adds to a
    window. State per key: the window's anchor and its requests; it is dropped once the
    window has been over for its own length by the watermark."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    span = pd.Timedelta(seconds=seconds)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        anchor, used = (pd.Timestamp(state.get[0], unit="us"), state.get[1]) if state.exists else (None, 0)
        times = pd.concat([b.ts for b in batches]).sort_values()
        found, (anchor, used) = _windows(iter(times), span, limit, anchor, used)
        state.update((int(anchor.value // 1000), int(used)))
        state.setTimeoutTimestamp(int((anchor + 2 * span).value // 1_000_000))
        yield pd.DataFrame([(key[0], *f) for f in found], columns=["user_id", "anchor", "requests", "refused"])

    return events.groupBy("user_id").applyInPandasWithState(run, RATE_SCHEMA, "anchor long, used long", "append", GroupStateTimeout.EventTimeTimeout)


def event_counts(events: DataFrame, window: str, watermark: str) -> DataFrame:
    """Counts by type in event-time windows; late events up to the watermark count."""
    return events.withWatermark("ts", watermark).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")
