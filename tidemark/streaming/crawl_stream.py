"""Streaming counterparts of the daily batch: new or changed pages, windows of events, failure streaks with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, ts: str = "ts", by: str = "event_type", size: str = "1 day", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Events of each window and kind; events later than `late` are dropped in streams. Works on batches, too."""
    timed = events.withWatermark(ts, late) if events.isStreaming else events
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    out = timed.groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return out.select(F.col("w.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, user: str = "user_id", ts: str = "ts", gap: str = "2 hours", late: str = "1 day") -> DataFrame:
    """Each user's sessions: events less than `gap` apart."""
    timed = events.withWatermark(ts, late) if events.isStreaming else events
    out = timed.groupBy(F.session_window(ts, gap).alias("w"), user).agg(F.count(F.lit(1)).alias("n"))
    return out.select(user, F.col("w.start").alias("start"), "n")


_STREAK = "source_id long, ts timestamp, event_id long, streak long, alert boolean"


def streaming_streaks(attempts: DataFrame, alert_at: int = 5) -> DataFrame:
    """attempts (source_id, ts, event_id, failed) with the failures in a row so far; state is one number a source."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        out = []
        for failed in rows["failed"]:
            streak = streak + 1 if failed else 0
            out.append(streak)
        state.update((streak,))
        yield rows.assign(streak=out, alert=[s >= alert_at for s in out])[["source_id", "ts", "event_id", "streak", "alert"]]

    return attempts.groupBy("source_id").applyInPandasWithState(run, _STREAK, "streak long", "append", GroupStateTimeout.NoTimeout)


def changed_pages(pages: DataFrame) -> DataFrame:
    """pages (source_id, ts, text) whose content differs from the source's last: state is one hash a source."""
    schema = "source_id long, ts timestamp, digest string"

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values("ts")
        keep = []
        for digest in rows["digest"]:
            keep.append(digest != last)
            last = digest
        state.update((last,))
        yield rows[keep][["source_id", "ts", "digest"]]

    hashed = pages.select("source_id", "ts", F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 32).alias("digest"))
    return hashed.groupBy("source_id").applyInPandasWithState(run, schema, "digest string", "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """The daily batch as a stream: everything that has come since the last run, then stop."""
    return stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
