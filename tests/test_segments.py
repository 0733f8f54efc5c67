"""The fold by cases and properties; batch and stream alike."""

import datetime as dt
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from worklore.config import Segmentation
from worklore.operators import segments as sg
from worklore.operators.segments import Fold, Step

T0 = 1_700_000_000.0


def fold(steps, **cfg):
    f = Fold(Segmentation(**cfg))
    out = []
    for s in steps:
        out += f.add(s)
    return [[s.idx for s in x] for x in out + f.end()]


def step(i, files="", minutes=None, failed=False, passed=False):
    return Step(i, T0 + 60 * (i if minutes is None else minutes), tuple(files.split()), failed, passed)


def test_shift_needs_two_turns_on_other_files():
    assert fold([step(0, "a"), step(1, "a"), step(2, "b"), step(3, "b"), step(4, "b")]) == [[0, 1], [2, 3, 4]]


def test_a_single_stranger_is_absorbed():
    assert fold([step(0, "a"), step(1, "b"), step(2, "a"), step(3)]) == [[0, 1, 2, 3]]


def test_gap_and_cap():
    assert fold([step(0, "a"), step(1, "a"), step(2, "a", 500), step(3, "a", 501)]) == [[0, 1], [2, 3]]
    assert [len(x) for x in fold([step(i, "a") for i in range(130)])] == [60, 60, 10]
    assert fold([step(0, "a", 0), step(1, "a", 120)]) == [[0, 1]]


def test_no_files_and_too_short():
    assert fold([step(0), step(1)]) == []
    assert fold([step(0), step(1)], require_files=False) == [[0, 1]]
    assert fold([step(0, "a")]) == []


def test_failure_holds_open_until_success():
    held = [step(0, "a"), step(1, "a", failed=True), step(2, "b"), step(3, "b"), step(4, "b", passed=True)]
    assert fold(held) == [[0, 1, 2, 3, 4]]
    assert fold(held, hold_open_on_failure=False) == [[0, 1], [2, 3, 4]]


STEP = st.tuples(st.sampled_from(["", "a", "b", "c", "a b"]), st.integers(0, 200), st.booleans(), st.booleans())


@settings(max_examples=150, deadline=None)
@given(st.lists(STEP, max_size=120))
def test_segments_are_runs_of_turns(raw):
    at, steps = 0, []
    for i, (files, gap, failed, passed) in enumerate(raw):
        at += gap
        steps.append(step(i, files, at, failed, passed))
    out = fold(steps)
    assert out == fold(steps)
    flat = [i for x in out for i in x]
    assert flat == sorted(set(flat))
    for x in out:
        assert x == list(range(x[0], x[-1] + 1)) and 2 <= len(x) <= 60


def _turns(n_sessions=6, n=80, seed=3):
    rng, rows = random.Random(seed), []
    for s in range(n_sessions):
        at = dt.datetime(2024, 1, 1)
        for i in range(n):
            at += dt.timedelta(minutes=rng.choice([1, 5, 30, 200]))
            rows.append((f"s{s}", i, at, rng.choice([[], ["a"], ["a"], ["b"], ["c", "a"]]), rng.random() < 0.1, rng.random() < 0.1))
    return rows


DDL = "session_id string, idx int, ts timestamp, files array<string>, failed boolean, passed boolean"


def test_batch_equals_plain_fold_and_stream(spark, tmp_path):
    from worklore.streaming.segments import flush_idle, stream_segments

    rows = _turns()
    df = spark.createDataFrame(rows, DDL)
    batch = {(r["session_id"], r["start_turn"], r["end_turn"]) for r in sg.segments(df).collect()}
    want = set()
    for s in sorted({r[0] for r in rows}):
        mine = [Step(r[1], r[2].replace(tzinfo=dt.UTC).timestamp(), tuple(r[3]), r[4], r[5]) for r in rows if r[0] == s]
        want |= {(s, x[0], x[-1]) for x in fold(mine)}
    assert batch == want
    # in the stream only closed segments come out: all but what is open at the end
    src = str(tmp_path / "in")
    for part in range(4):
        spark.createDataFrame([r for r in rows if r[1] // 20 == part], DDL).coalesce(1).write.mode("append").json(src)
    stream = stream_segments(spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).json(src), watermark="100 days")
    q = stream.writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["session_id"], r["start_turn"], r["end_turn"]) for r in spark.table("closed").collect()}
    assert got <= batch and len(batch - got) <= 2 * 6
    rest = {(r["session_id"], r["start_turn"], r["end_turn"]) for r in flush_idle(df, spark.table("closed")).collect()}
    assert rest == batch - got


def test_cursors_or_rule(spark):
    segs = spark.createDataFrame([("s", 0, 4), ("s", 5, 9), ("t", 0, 3)], "session_id string, start_turn int, end_turn int").withColumn("hash", sg.segment_hash())
    empty = spark.createDataFrame([], "hash string")
    cursors = spark.createDataFrame([("s", 4)], "session_id string, last_turn int")
    assert {(r[0], r[1]) for r in sg.unprocessed(segs, cursors, empty).select("session_id", "start_turn").collect()} == {("s", 5), ("t", 0)}
    cur, seen = sg.mark(cursors, empty, segs)
    assert sg.unprocessed(segs, cur, seen).count() == 0
