"""Parsing session files, and their way to records."""

import json

from pyspark.sql import functions as F

from worklore.config import Config
from worklore.operators import store
from worklore.operators.classify import classify, extractor_id, rule_classifier
from worklore.plans import pipeline
from worklore.sources import transcripts as tr

ROOT = "/w/proj"


def lines(n=6, session="s1"):
    out = ["not json", json.dumps({"type": "summary", "x": 1}), json.dumps([1]), json.dumps({"type": 3}), ""]
    at = 0
    for i in range(n):
        stamp = f"2026-06-01T10:{i:02d}:00Z"
        out.append(json.dumps({"type": "user", "sessionId": session, "cwd": ROOT, "timestamp": stamp, "origin": {"kind": "human"}, "message": {"content": f"please fix the loader {i}"}}))
        use = {"type": "tool_use", "id": f"t{i}", "name": "Edit", "input": {"file_path": f"{ROOT}/src/a.py", "note": {"see": "src/b.py and ../out.py"}}}
        out.append(json.dumps({"type": "assistant", "sessionId": session, "gitBranch": "feat/AB-12-x", "timestamp": stamp, "message": {"content": [{"type": "text", "text": "editing"}, {"type": "thinking", "thinking": ""}, use]}}))
        result = {"type": "tool_result", "tool_use_id": f"t{i}", "content": [{"type": "text", "text": "3 failed" if i < n - 1 else "9 passed"}], "is_error": False}
        out.append(json.dumps({"type": "user", "sessionId": session, "timestamp": stamp, "message": {"content": [result]}}))
        at += 1
    out.append(json.dumps({"type": "user", "isMeta": True, "message": {"content": "meta"}}))
    return out


def write(tmp_path, name="one.jsonl", **kw):
    p = tmp_path / name
    p.write_text("\n".join(lines(**kw)), encoding="utf-8")
    return str(p)


def test_parse(spark, tmp_path):
    turns, sessions = tr.parse(tr.read_lines(spark, write(tmp_path)))
    s = sessions.collect()[0]
    assert (s["session_id"], s["cwd"], s["n_turns"], s["skipped_lines"], s["unknown_types"]) == ("s1", ROOT, 18, 4, ["summary"])
    t = turns.orderBy("idx").collect()
    assert [r["idx"] for r in t] == list(range(18))
    assert t[0]["is_human"] and t[0]["role"] == "user" and not t[2]["is_human"]
    assert t[1]["tool_calls"][0]["text"] == f"Edit({ROOT}/src/a.py)"
    assert t[1]["tool_calls"][0]["paths"][0] == f"{ROOT}/src/a.py" and "src/b.py" in t[1]["tool_calls"][0]["paths"]
    assert t[2]["tool_results"][0]["text"] == "3 failed" and t[2]["tool_results"][0]["is_error"] is False


def test_paths(spark, tmp_path):
    turns, _ = tr.parse(tr.read_lines(spark, write(tmp_path)))
    named = {r["path"] for r in tr.candidate_paths(turns, ROOT).collect()}
    assert named == {"src/a.py", "src/b.py"}
    known = spark.createDataFrame([("src/a.py",)], "path string")
    t = tr.with_steps(tr.normalize_paths(turns, ROOT, known)).orderBy("idx").collect()
    assert t[1]["files"] == ["src/a.py"] and t[1]["tool_calls"][0]["text"] == "Edit(src/a.py)"
    assert t[2]["failed"] and t[-1]["passed"] and not t[-1]["failed"]


def test_tool_paths_walk():
    assert tr.tool_paths('{"path": "src", "file_path": "a/b.py", "x": ["see c.md", {"y": "d.txt"}]}') == ["a/b.py", "c.md", "d.txt"]
    assert tr.tool_paths("nope") == [] and tr.tool_paths("[1]") == []


def repo(spark):
    return pipeline.Repo(
        spark.createDataFrame([("r", ROOT, None, "abc1234")], "repo string, root string, branch string, head_sha string"),
        spark.createDataFrame([("r", "src/a.py")], "repo string, path string"),
        spark.createDataFrame([], "repo string, sha string, committed_at timestamp, ord int"),
        spark.createDataFrame([], "repo string, sha string, ord int, path string"),
        spark.createDataFrame([("r", None, 0, "+++ b/src/a.py"), ("r", None, 1, "@@ -1 +2,2 @@"), ("r", None, 2, "+max_workers = 4")], "repo string, sha string, line_no int, line string"),
        spark.createDataFrame([("r", "src/a.py", "class A:\n    def run(self):\n        max_workers = 4\n")], "repo string, path string, text string"),
    )


def test_process_twice_and_queue(spark, tmp_path):
    ignored = spark.createDataFrame([("src/b.py",)], "path string")
    turns, sessions = pipeline.load(spark, write(tmp_path), ROOT, repo(spark).files.select("path"), ignored)
    turns = turns.cache()
    home, cfg, at = str(tmp_path / "home"), Config(), "2026-07-01 00:00:00"
    dry = pipeline.process(turns, sessions, repo(spark), home, cfg, at).collect()[0]
    assert dry["segments_new"] == 1 and dry["input_chars"] > 0 and store.read_log(spark, f"{home}/records").count() == 0
    done = pipeline.process(turns, sessions, repo(spark), home, cfg, at, rule_classifier).collect()[0]
    assert done["segments_new"] == 1 and done["dropped"] == 0
    r = store.read_log(spark, f"{home}/records").collect()
    assert len(r) == 1 and r[0]["outcome"] == "worked"
    a = r[0]["anchors"]
    assert a["files"] == ["src/a.py"] and a["settings"] == ["max_workers"] and a["symbols"] == ["A.run"] and a["issue"] == "AB-12" and a["branch"] == "feat/AB-12-x"
    again = pipeline.process(turns, sessions, repo(spark), home, cfg, at, rule_classifier).collect()[0]
    assert again["segments_new"] == 0 and store.read_log(spark, f"{home}/records").count() == 1
    home = str(tmp_path / "queue")
    assert pipeline.stage(turns, repo(spark), home, cfg) == 1 and pipeline.stage(turns, repo(spark), home, cfg) == 0
    out = pipeline.drain(spark, home, cfg, at, rule_classifier).collect()[0]
    assert (out["drained"], out["dropped"], out["records"]) == (1, 0, 1)
    assert pipeline.pending(spark, home).count() == 0 and pipeline.stage(turns, repo(spark), home, cfg) == 0


def test_classifier_retries_and_drops(spark):
    from worklore.functions.redact import redact_column

    def flaky(prompts):
        if len(prompts) > 1:
            raise RuntimeError("batch too large")
        return [None if "bad" in prompts[0] else "{}" if "odd" in prompts[0] else json.dumps({"records": [{"kind": "note", "summary": "mail a@b.co"}]})]

    units = redact_column(spark.createDataFrame([("1", "good"), ("2", "bad"), ("3", None), ("4", "odd")], "hash string, p string").coalesce(1), "p")
    got = {r["hash"]: r for r in classify(units, flaky).collect()}
    assert got["1"]["candidates"][0]["summary"] == "mail [REDACTED:email]" and not got["1"]["dropped"]
    assert got["2"]["dropped"] and got["3"]["drop_reason"] == "redaction failed" and got["4"]["candidates"] == []
    assert extractor_id("claude-haiku-4-5-20251001") == "haiku-4.5/v1"


def test_invalid_replies(spark):
    bad = ['{"records":[{"kind":"attempt","summary":"x"}]}', '{"records":[{"kind":"note","outcome":"failed","summary":"x"}]}', '{"records":[{"kind":"note","summary":" "}]}', "[]", "x", '{"records":[],"more":1}']
    rows = spark.createDataFrame([(b,) for b in bad], "r string").select(store.candidates_of(F.col("r")).alias("c")).collect()
    assert [r["c"] for r in rows] == [None] * len(bad)
