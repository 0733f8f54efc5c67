"""Segments from a stream of turns: the batch fold, with its state kept by session.

Only closed segments come out, so a segment is never given twice. A session that stays idle for longer than the largest
gap is closed by a timer on the watermark; one that is overdue already when its turns come is closed at once. At the end of a
run `flush_idle` gives what is still open.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from worklore.config import Segmentation
from worklore.operators.segments import Fold, Step, segments

CLOSED_DDL = "session_id string, start_turn int, end_turn int, turn_count int, files array<string>, started_at timestamp, ended_at timestamp, tool_errors int"
STATE_DDL = "fold string, last_idx int"


def dump(fold: Fold) -> str:
    return json.dumps([fold.current, fold.waiting, [sorted(r) for r in fold.recent], fold.unresolved])


def load(text: str, cfg: Segmentation) -> Fold:
    current, waiting, recent, unresolved = json.loads(text)
    step = lambda s: Step(s[0], s[1], tuple(s[2]), s[3], s[4])
    return Fold(cfg, [step(s) for s in current], [step(s) for s in waiting], deque(frozenset(r) for r in recent), unresolved)


def rows_of(session: str, closed: list[list[Step]]) -> pd.DataFrame:
    out = []
    for steps in closed:
        times = [s.at for s in steps if s.at is not None]
        at = lambda x: pd.Timestamp(round(x * 1e6), unit="us", tz="UTC") if times else None
        out.append((session, steps[0].idx, steps[-1].idx, len(steps), list(dict.fromkeys(f for s in steps for f in s.files)), at(min(times, default=0)), at(max(times, default=0)), sum(s.failed for s in steps)))
    return pd.DataFrame(out, columns=["session_id", "start_turn", "end_turn", "turn_count", "files", "started_at", "ended_at", "tool_errors"])


def stream_segments(turns: DataFrame, cfg: Segmentation | None = None, watermark: str = "1 day") -> DataFrame:
    """turns: a stream of (session_id, idx, ts, files, failed, passed). Turns at or before the last index seen of their
    session are late and left out."""
    cfg = cfg or Segmentation()

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fold, last = (load(state.get[0], cfg), state.get[1]) if state.exists else (Fold(cfg), -1)
        if state.hasTimedOut:
            state.remove()
            yield rows_of(key[0], fold.end())
            return
        frames = list(batches)  # one session's rows of one micro-batch
        rows = pd.concat(frames).sort_values("idx") if frames else pd.DataFrame()
        closed = []
        for r in rows.itertuples():
            if r.idx <= last:
                continue
            at = None if pd.isna(r.at) else float(r.at)
            closed += fold.add(Step(int(r.idx), at, tuple(r.files if r.files is not None else ()), bool(r.failed), bool(r.passed)))
            last = int(r.idx)
        times = [s.at for s in (fold.current + fold.waiting) if s.at is not None]
        due = int((max(times) + 60 * cfg.max_gap_minutes) * 1000) + 1 if times else None
        if due is not None and due <= state.getCurrentWatermarkMs():
            closed += fold.end()
            due = None
        state.update((dump(fold), last))
        if due is not None:
            state.setTimeoutTimestamp(due)
        yield rows_of(key[0], closed)

    steps = turns.withWatermark("ts", watermark).select(F.col("session_id").cast("string"), F.col("idx").cast("int"), "ts", (F.unix_micros("ts") / 1e6).alias("at"), "files", "failed", "passed")
    return steps.groupBy("session_id").applyInPandasWithState(step, CLOSED_DDL, STATE_DDL, "append", GroupStateTimeout.EventTimeTimeout)


def flush_idle(turns: DataFrame, given: DataFrame, cfg: Segmentation | None = None) -> DataFrame:
    """What a stream has not closed by the end of a run: the segments of all its turns, read as a batch, that aren't in
    given(session_id, start_turn, end_turn). Both ways fold alike, so these are the ones still open."""
    keys = ["session_id", "start_turn", "end_turn"]
    return segments(turns, cfg).join(given.select(*keys).distinct(), keys, "left_anti")
