"""Work units: turns of a session folded into segments, the same way in batch and in streams.

The fold depends on order and keeps state that windows can't express (a failure holds a segment open; turns of another
topic wait until enough of them confirm the shift), so it is plain Python over one pass of ordered rows. Its state is
bounded by max_turns. In batch, sessions are hash-partitioned, sorted within partitions and streamed through the fold, so
no session is ever gathered.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worklore.config import SEGMENT_CHARS, Segmentation
from worklore.functions.expressions import elide_middle


class Step(NamedTuple):
    """What the fold sees of a turn; at is seconds or None."""

    idx: int
    at: float | None
    files: tuple[str, ...]
    failed: bool
    passed: bool


@dataclass
class Fold:
    """State of one session. `add` and `end` return the segments that close, as lists of steps."""

    cfg: Segmentation
    current: list[Step] = field(default_factory=list)
    waiting: list[Step] = field(default_factory=list)  # a possible shift, not yet confirmed
    recent: deque = field(default_factory=deque)
    unresolved: bool = False

    def _closed(self, steps: list[Step]) -> list[list[Step]]:
        if len(steps) < max(1, self.cfg.min_turns) or self.cfg.require_files and not any(s.files for s in steps):
            return []
        return [steps]

    def _remember(self, files: tuple[str, ...]) -> None:
        self.recent.append(frozenset(files))
        while len(self.recent) > self.cfg.window:
            self.recent.popleft()

    def _accept(self, step: Step) -> None:
        for s in self.waiting:
            if s.files:
                self._remember(s.files)
        self.current += [*self.waiting, step]
        self.waiting = []
        self._remember(step.files)

    def _must_break(self, step: Step) -> bool:
        n = len(self.current) + len(self.waiting)
        if not n:
            return False
        if n >= self.cfg.max_turns:
            return True
        last = (self.waiting or self.current)[-1].at
        return last is not None and step.at is not None and step.at - last > 60 * self.cfg.max_gap_minutes

    def add(self, step: Step) -> list[list[Step]]:
        out = self.end() if self._must_break(step) else []
        if step.failed:
            self.unresolved = True
        elif step.passed:
            self.unresolved = False
        if not step.files:
            (self.waiting or self.current).append(step)
            return out
        near = frozenset().union(*self.recent)
        if not near or near & set(step.files) or self.cfg.hold_open_on_failure and self.unresolved:
            self._accept(step)
            return out
        self.waiting.append(step)
        strangers = [s.files for s in self.waiting if s.files]
        if len(strangers) >= self.cfg.boundary_misses:
            out += self._closed(self.current)
            self.current, self.waiting = self.waiting, []
            self.recent.clear()
            for files in strangers:
                self._remember(files)
        return out

    def end(self) -> list[list[Step]]:
        """Close what is open; the fold starts anew."""
        out = self._closed(self.current + self.waiting)
        self.current, self.waiting, self.unresolved = [], [], False
        self.recent.clear()
        return out


MEMBER_DDL = "session_id string, idx int, start_turn int, end_turn int"
MEMBER = pa.schema([("session_id", pa.string()), ("idx", pa.int32()), ("start_turn", pa.int32()), ("end_turn", pa.int32())])


def _members(batches: Iterator[pa.RecordBatch], cfg: Segmentation) -> Iterator[pa.RecordBatch]:
    """Rows sorted by session and idx -> (session_id, idx, start_turn, end_turn) of each turn that is in a segment."""
    rows: list[tuple] = []
    session, fold, started = None, Fold(cfg), False

    def keep(closed: list[list[Step]]) -> None:
        for steps in closed:
            rows.extend((session, s.idx, steps[0].idx, steps[-1].idx) for s in steps)

    for batch in batches:
        for sid, *step in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if not started or sid != session:
                keep(fold.end())
                session, started = sid, True
            idx, at, files, failed, passed = step
            keep(fold.add(Step(idx, at, tuple(files or ()), bool(failed), bool(passed))))
        if len(rows) >= 8192:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), MEMBER, strict=True)], schema=MEMBER)
            rows.clear()
    keep(fold.end())
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), MEMBER, strict=True)], schema=MEMBER)


def steps_of(turns: DataFrame) -> DataFrame:
    """What the fold needs of turns(session_id, idx, ts, files, failed, passed)."""
    at = F.unix_micros("ts") / 1e6
    return turns.select(F.col("session_id").cast("string"), F.col("idx").cast("int"), at.alias("at"), "files", "failed", "passed")


def segment_members(turns: DataFrame, cfg: Segmentation | None = None) -> DataFrame:
    """(session_id, idx, start_turn, end_turn): each turn that a segment keeps, with its segment."""
    cfg = cfg or Segmentation()
    ordered = steps_of(turns).repartition("session_id").sortWithinPartitions("session_id", "idx")
    return ordered.mapInArrow(lambda b: _members(b, cfg), MEMBER_DDL)


def ordered_distinct(lists: Column) -> Column:
    return F.array_distinct(F.flatten(lists))


def segments(turns: DataFrame, cfg: Segmentation | None = None) -> DataFrame:
    """(session_id, start_turn, end_turn, turn_count, files, started_at, ended_at, tool_errors, hash); a group holds no
    more than max_turns turns."""
    m = segment_members(turns, cfg)
    t = turns.withColumn("session_id", F.col("session_id").cast("string")).withColumn("idx", F.col("idx").cast("int"))
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("idx", "files"))), lambda x: F.coalesce(x["files"], F.array().cast("array<string>")))
    s = t.join(m, ["session_id", "idx"]).groupBy("session_id", "start_turn", "end_turn").agg(
        F.count("*").cast("int").alias("turn_count"), ordered_distinct(in_order).alias("files"), F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.count_if("failed").cast("int").alias("tool_errors")
    )
    return s.withColumn("hash", segment_hash())


def segment_hash() -> Column:
    return F.substring(F.sha2(F.concat_ws(":", "session_id", F.col("start_turn").cast("string"), F.col("end_turn").cast("string")), 256), 1, 16)


def by_turn(*partition: str) -> Window:
    return Window.partitionBy(*(partition or ("session_id",))).orderBy("idx")


def gap_sessions(turns: DataFrame, max_gap_minutes: float) -> DataFrame:
    """Add gap_no: how many gaps longer than the limit come before a turn in its session. Null times make no gap."""
    gap = (F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(by_turn())) > int(max_gap_minutes * 60_000_000)
    flagged = turns.withColumn("_gap", F.coalesce(gap, F.lit(False)).cast("int"))
    return flagged.withColumn("gap_no", F.sum("_gap").over(by_turn().rowsBetween(Window.unboundedPreceding, 0))).drop("_gap")


def failure_latch(turns: DataFrame, *partition: str) -> DataFrame:
    """Add unresolved: a failure sets it, a pass without failure clears it."""
    state = F.when(F.col("failed"), True).when(F.col("passed"), False)
    w = by_turn(*partition).rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn("unresolved", F.coalesce(F.last(state, ignorenulls=True).over(w), F.lit(False)))


def file_window_overlap(turns: DataFrame, window: int = 6) -> DataFrame:
    """Turns with files, and whether one of them was in the last `window` such turns of the session (null for the first)."""
    w = by_turn().rowsBetween(-window, -1)
    seen = ordered_distinct(F.collect_list("files").over(w))
    t = turns.where(F.size("files") > 0).withColumn("recent", seen)
    return t.withColumn("overlaps", F.when(F.size("recent") > 0, F.arrays_overlap("files", "recent")))


def unprocessed(segs: DataFrame, cursors: DataFrame, seen: DataFrame) -> DataFrame:
    """Segments neither seen(hash) nor ending at or before their session's cursor(session_id, last_turn)."""
    fresh = segs.join(seen.select("hash").distinct(), "hash", "left_anti")
    last = cursors.groupBy("session_id").agg(F.max("last_turn").alias("last_turn"))
    return fresh.join(last, "session_id", "left").where(F.col("end_turn") > F.coalesce("last_turn", F.lit(-1))).drop("last_turn")


def mark(cursors: DataFrame, seen: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cursors and seen hashes after the segments in done(session_id, end_turn, hash)."""
    ends = cursors.select("session_id", "last_turn").unionByName(done.select("session_id", F.col("end_turn").alias("last_turn")))
    return ends.groupBy("session_id").agg(F.max("last_turn").alias("last_turn")), seen.select("hash").unionByName(done.select("hash")).distinct()


def first_per_session(segs: DataFrame, n: int) -> DataFrame:
    return segs.withColumn("_n", F.row_number().over(Window.partitionBy("session_id").orderBy("start_turn"))).where(F.col("_n") <= n).drop("_n")


def render_turn(t: Column) -> Column:
    """A turn struct (idx, role, is_human, text, tool_calls, tool_results) as text."""
    head = F.concat(F.lit("["), t["idx"].cast("string"), F.lit("] "), F.when(t["is_human"], "human").otherwise(t["role"]), F.lit(":"))
    said = F.when(F.length(t["text"]) > 0, F.array(F.concat(F.lit("  "), t["text"]))).otherwise(F.array().cast("array<string>"))
    calls = F.transform(t["tool_calls"], lambda c: F.concat(F.lit("  -> "), c["text"]))
    mark_ = lambda r: F.concat(F.lit("  <- ["), F.when(r["is_error"], "ERROR").otherwise("ok"), F.lit("]"))
    results = F.transform(t["tool_results"], lambda r: F.when(F.length(r["text"]) > 0, F.concat(mark_(r), F.lit(" "), r["text"])).otherwise(mark_(r)))
    return F.array_join(F.concat(F.array(head), said, calls, results), "\n")


def render(turns: Column) -> Column:
    """A segment's turns, in order, as the text that classifiers read; long texts keep both ends."""
    return elide_middle(F.array_join(F.transform(turns, render_turn), "\n"), SEGMENT_CHARS)
