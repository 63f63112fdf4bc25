"""Structured Streaming: snapshots of runs on change, windows of visits, and deltas of streamed replies."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TERMINAL = ("COMPLETED", "FAILED", "FAILED_QUALITY")
SNAPSHOT = "run_id long, stage string, events long"


def window_counts(events: DataFrame, ts: str, key: str, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events by window and key; with a watermark, so that state is dropped once a window is too old."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def trace_snapshots(events: DataFrame, timeout_s: int = 3600) -> DataFrame:
    """A snapshot of a run (run_id, stage, events so far) whenever its stage or number of events has changed. State goes with a
    terminal stage, or after the timeout. events: run_id long, seq long, stage string."""

    def on_change(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        stage, count, last = state.get if state.exists else (None, 0, -1)
        before = stage, count
        for rows in batches:
            count += len(rows)
            top = rows.loc[rows["seq"].idxmax()]
            if top["seq"] > last:
                last, stage = int(top["seq"]), top["stage"]
        if stage in TERMINAL:
            if state.exists:
                state.remove()
        else:
            state.update((stage, count, last))
            state.setTimeoutDuration(timeout_s * 1000)
        if (stage, count) != before:
            yield pd.DataFrame({"run_id": [key[0]], "stage": [stage], "events": [count]})

    return events.groupBy("run_id").applyInPandasWithState(on_change, SNAPSHOT, "stage string, events long, last long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def delta(chunk: str, text: str) -> str:
    """What a streamed chunk adds to the text so far: a cumulative chunk adds its rest, one that the text ends with nothing,
    any other what is left after its longest overlap with the text's end."""
    if chunk.startswith(text):
        return chunk[len(text) :]
    if text.endswith(chunk):
        return ""
    k = next((k for k in range(min(len(chunk), len(text)), 0, -1) if text.endswith(chunk[:k])), 0)
    return chunk[k:]


def joined_deltas(chunks: DataFrame) -> DataFrame:
    """stream_id and text of ordered chunks (stream_id, seq, chunk), for a batch; one stream's chunks are a group."""

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        text = ""
        for c in rows.sort_values("seq")["chunk"]:
            text += delta(c or "", text)
        return pd.DataFrame({"stream_id": [rows["stream_id"].iloc[0]], "text": [text]})

    return chunks.groupBy("stream_id").applyInPandas(join, "stream_id long, text string")
