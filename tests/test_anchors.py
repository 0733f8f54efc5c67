"""Extractors of settings, routes and symbols, diffs and joins."""

from pyspark.sql import functions as F

from worklore.operators import anchors as an
from worklore.sources import repos


def test_settings(spark):
    lines = ['fill_holes = True', '"batchSize": 3', "# MAX_WORKERS = 2", "run --dry-run --max-depth 3", "x: int = 3", "self.value = 1", "if a_b == 2:", "MODE = 1"]
    rows = spark.createDataFrame(list(enumerate(lines)), "i int, t string").select("i", an.settings_in_line(F.col("t")).alias("k")).orderBy("i").collect()
    assert [r["k"] for r in rows] == [["fill_holes"], ["batchSize"], [], ["dry_run", "max_depth"], [], [], [], ["MODE"]]


def test_python_routes():
    src = 'r = APIRouter(prefix="api/")\n@r.get("/x/")\nasync def a(): ...\n@r.post("y")\ndef b(): ...\n# @r.get("/no")\n'
    assert an.python_routes(src) == ["GET /api/x", "POST /api/y"]
    assert an.python_routes("def (") == []


def test_file_routes(spark):
    cases = [("app/(m)/api/[id]/_p/route.ts", "export async function GET() {}\nexport const POST = 1"), ("app/page.tsx", ""), ("lib/route.ts", "export function GET(){}"), ("src/app/x/[...all]/route.ts", "nothing")]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, p string, s string").select("i", an.file_routes(F.col("p"), F.col("s")).alias("r")).orderBy("i").collect()
    assert [r["r"] for r in rows] == [["GET /api/{id}", "POST /api/{id}"], ["PAGE /"], [], []]


def test_symbols(spark):
    py = "class A:\n    def f(self):\n        return 1\n\ndef g():\n    pass\n"
    ts = "export class B {\n  run(x) {\n    return x;\n  }\n}\nconst h = (a) => a;\n"
    src = spark.createDataFrame([("r", "a.py", py), ("r", "b.ts", ts)], "repo string, path string, text string")
    ranges = spark.createDataFrame([("r", "a.py", 0, 3, 3), ("r", "a.py", 1, 6, 6), ("r", "b.ts", 2, 3, 3), ("r", "b.ts", 3, 6, 6)], "repo string, path string, ord int, start int, stop int")
    got = {(r["path"], r["ord"], r["name"]) for r in an.symbols(src, ranges).collect()}
    assert got == {("a.py", 0, "A.f"), ("a.py", 1, "g"), ("b.ts", 2, "B.run"), ("b.ts", 3, "h")}


def test_diffs(spark):
    text = ["diff --git a/x b/x", "--- a/x", "+++ b/x", "@@ -1,2 +3,4 @@", "-old", "+new", "@@ -9 +0,0 @@", "-gone", "--- a/y", "+++ /dev/null", "@@ -1 +0,0 @@", "-all"]
    raw = spark.createDataFrame([("r", "s", i, t) for i, t in enumerate(text)], "repo string, sha string, line_no int, line string")
    assert [(r["path"], r["start"], r["stop"]) for r in repos.hunks(raw).collect()] == [("x", 3, 6)]
    assert [(r["sign"], r["text"]) for r in repos.diff_lines(raw).orderBy("ord").collect()] == [("-", "old"), ("+", "new"), ("-", "gone")]


def test_issue(spark):
    rows = spark.createDataFrame([("feat/AB-12-x",), ("main",)], "b string").select(repos.issue_of(F.col("b"), r"\b([A-Z][A-Z0-9]{1,9}-\d+)\b").alias("i"), repos.issue_of(F.col("b"), "(").alias("bad")).collect()
    assert [(r["i"], r["bad"]) for r in rows] == [("AB-12", None), (None, None)]


def test_git_scan(spark, tmp_path):
    import subprocess

    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b.c", *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    (tmp_path / ".gitignore").write_text("out/\n")
    (tmp_path / "a.py").write_text("x = 1\n")
    run("add", "-A")
    run("commit", "-qm", "one")
    (tmp_path / "a.py").write_text("max_size = 2\n")
    root = str(tmp_path)
    assert repos.repo_state(spark, "r", root).collect()[0]["branch"] == "main"
    assert {r["path"] for r in repos.repo_files(spark, "r", root).collect()} == {".gitignore", "a.py"}
    assert repos.commits(spark, "r", root).count() == 1 and repos.commit_files(spark, "r", root).count() == 2
    work = repos.diff_lines(repos.diffs(spark, "r", root)).where("sha is null")
    assert {(r["sign"], r["text"]) for r in work.collect()} == {("-", "x = 1"), ("+", "max_size = 2")}
    assert [r["path"] for r in repos.ignored_files(spark, root, spark.createDataFrame([("out/b",), ("a.py",)], "path string")).collect()] == ["out/b"]
    assert repos.sources(spark, "r", root, ["a.py", "none"]).count() == 1
    assert repos.commits(spark, "r", "/nowhere").count() == 0
