"""Streaming forms of the session operators, for event streams (ts, user_id, event_type, value) and streams of blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Events and value per user and session; a session ends after a gap, late events count within the watermark."""
    ts = F.col("ts").cast("timestamp")
    return (
        events.withColumn("ts", ts).withWatermark("ts", late)
        .groupBy("user_id", F.session_window("ts", gap).alias("s"))
        .agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value"))
        .select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "events", "value")
    )


MARKED = "entry long, pos long, start_ms long, end_ms long, is_full boolean, inside boolean, is_end boolean"
#: The open sentence's end, whether the last block is inside it, the last place, and that block while it waits for the next one.
STATE = "sentence_end long, open boolean, last_pos long, start_ms long, end_ms long, is_full boolean"


def _marker(idle_ms: int | None):
    def mark(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        end, is_open, last, *held = state.get if state.exists else (-1, False, -(1 << 62), 0, 0, False)
        waiting = pd.DataFrame([(key[0], last, *held)] if is_open else [], columns=["entry", "pos", "start_ms", "end_ms", "is_full"])
        if state.hasTimedOut:  # nothing followed: the block that waits was its sentence's last
            state.remove()
            yield waiting.assign(inside=True, is_end=True)
            return
        rows = pd.concat(list(parts))[list(waiting.columns)].sort_values("pos")
        if len(rows) and rows["pos"].iloc[0] <= last:
            raise ValueError(f"block {rows['pos'].iloc[0]} of entry {key[0]} came after block {last}")
        full, start = rows["is_full"].to_numpy(bool), rows["start_ms"].to_numpy()
        number = np.cumsum(full)  # 0: still in the sentence of the batch before
        ends = np.concatenate([[end], rows["end_ms"].to_numpy()[full]])[number]
        late = pd.Series(~full & (start > ends)).groupby(number).cummax().to_numpy(bool)
        inside = ~late & ((number > 0) | is_open)
        out = pd.concat([waiting, rows], ignore_index=True) if len(waiting) else rows
        own = np.concatenate([np.ones(len(waiting), bool), inside])
        # A block is the last of its sentence if the next one is outside, or opens another.
        follows = np.concatenate([own[1:] & ~out["is_full"].to_numpy(bool)[1:], [True]])
        out = out.assign(inside=own, is_end=own & ~follows)
        ready = len(out) - (1 if len(out) and own[-1] else 0)  # the last one waits, if it is inside
        if len(rows):
            tail = rows.iloc[-1]
            state.update((int(ends[-1]), bool(inside[-1]), int(tail["pos"]), int(tail["start_ms"]), int(tail["end_ms"]), bool(tail["is_full"])))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield out.iloc[:ready]

    return mark


def mark_sentences(blocks: DataFrame, idle_ms: int | None = 3_600_000) -> DataFrame:
    """``inside``: whether a block belongs to an open sentence; ``is_end``: whether it is its last.

    Kept per entry across micro-batches. Blocks of an entry must arrive in
    order of pos; one that comes too late is an error. A block inside a
    sentence is emitted once the next one is there. An entry that has been
    idle for ``idle_ms`` is closed and its state freed (None: never).
    """
    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return blocks.groupBy("entry").applyInPandasWithState(_marker(idle_ms), MARKED, STATE, "append", timeout)
