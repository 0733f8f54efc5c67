"""Repositories as tables: one pass of git calls on the driver, bounded by a repository's own size, gives DataFrames.

Git is external, versioned state; nothing about it can be computed in parallel from files, so it is read once and joined
afterwards. Every call degrades to "nothing" on failure or after TIMEOUT_S.
"""

from __future__ import annotations

import subprocess
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TIMEOUT_S = 20


def git(root: str, *args: str, stdin: str | None = None, ok: tuple[int, ...] = (0,)) -> str | None:
    try:
        done = subprocess.run(["git", "-C", root, *args], input=stdin, capture_output=True, text=True, errors="replace", timeout=TIMEOUT_S)
    except (OSError, subprocess.SubprocessError):
        return None
    return done.stdout if done.returncode in ok else None


def _names(out: str | None) -> list[str]:
    return [x for x in (out or "").splitlines() if x.strip()]


def repo_state(spark: SparkSession, repo: str, root: str) -> DataFrame:
    """(repo, root, branch, head_sha); branch is null when HEAD is detached."""
    top = (git(root, "rev-parse", "--show-toplevel") or "").strip() or None
    branch = (git(root, "symbolic-ref", "--short", "-q", "HEAD") or "").strip() or None
    head = (git(root, "rev-parse", "--short", "HEAD") or "").strip() or None
    return spark.createDataFrame([(repo, top, branch, head)], "repo string, root string, branch string, head_sha string")


def repo_files(spark: SparkSession, repo: str, root: str) -> DataFrame:
    return spark.createDataFrame([(repo, p) for p in _names(git(root, "-c", "core.quotePath=false", "ls-files"))], "repo string, path string")


def ignored_files(spark: SparkSession, root: str, candidates: DataFrame) -> DataFrame:
    """Of candidates(path), those that git ignores. Paths come to the driver, as many as one repository's sessions name."""
    paths = [r["path"] for r in candidates.select("path").distinct().toLocalIterator()]
    out = git(root, "check-ignore", "--stdin", stdin="\n".join(paths), ok=(0, 1)) if paths else ""
    return spark.createDataFrame([(p,) for p in _names(out)], "path string")


def existing_files(spark: SparkSession, root: str, candidates: DataFrame) -> DataFrame:
    """Of candidates(path), those that are files below the root on the driver's disk."""
    import os

    paths = [r["path"] for r in candidates.select("path").distinct().toLocalIterator()]
    return spark.createDataFrame([(p,) for p in paths if os.path.isfile(f"{root}/{p}")], "path string")


def commits(spark: SparkSession, repo: str, root: str) -> DataFrame:
    """(repo, sha, committed_at, ord) of all branches, newest first."""
    rows = []
    for i, line in enumerate(_names(git(root, "log", "--all", "--format=%h %ct"))):
        sha, at = line.split()
        rows.append((repo, sha, datetime.fromtimestamp(int(at), UTC), i))
    return spark.createDataFrame(rows, "repo string, sha string, committed_at timestamp, ord int")


def commit_files(spark: SparkSession, repo: str, root: str) -> DataFrame:
    """(repo, sha, ord, path)."""
    rows, sha = [], None
    for line in (git(root, "-c", "core.quotePath=false", "log", "--all", "--format=%x01%h", "--name-only") or "").splitlines():
        if line.startswith("\x01"):
            sha, n = line[1:], 0
        elif line.strip():
            rows.append((repo, sha, n, line))
            n += 1
    return spark.createDataFrame(rows, "repo string, sha string, ord int, path string")


def diffs(spark: SparkSession, repo: str, root: str) -> DataFrame:
    """(repo, sha, line_no, line): unified diffs without context of every commit, and of the working tree (null sha)."""
    rows, sha, n = [], None, 0
    for line in (git(root, "-c", "core.quotePath=false", "log", "--all", "--format=%x01%h", "--unified=0", "-p") or "").splitlines():
        if line.startswith("\x01"):
            sha, n = line[1:], 0
        else:
            rows.append((repo, sha, n, line))
            n += 1
    rows += [(repo, None, i, line) for i, line in enumerate((git(root, "-c", "core.quotePath=false", "diff", "HEAD", "--unified=0") or "").splitlines())]
    return spark.createDataFrame(rows, "repo string, sha string, line_no int, line string")


def sources(spark: SparkSession, repo: str, root: str, paths: list[str]) -> DataFrame:
    """(repo, path, text): the working tree's file, or else HEAD's."""
    rows = []
    for p in paths:
        try:
            with open(f"{root}/{p}", encoding="utf-8", errors="replace") as f:
                text = f.read()
        except OSError:
            text = git(root, "show", f"HEAD:{p}")
        if text is not None:
            rows.append((repo, p, text))
    return spark.createDataFrame(rows, "repo string, path string, text string")


def _with_path(raw: DataFrame) -> DataFrame:
    """Each diff line with the file whose header came last; deleted files have none."""
    header = F.startswith("line", F.lit("+++ "))
    named = F.trim(F.substr("line", F.lit(5)))
    path = F.when(named == "/dev/null", F.lit("")).when(F.startswith(named, F.lit("b/")), F.substr(named, F.lit(3))).otherwise(named)
    w = Window.partitionBy("repo", "sha").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return raw.withColumn("header", header).withColumn("path", F.last(F.when(header, path), ignorenulls=True).over(w)).where("path <> '' and not header")


def hunks(raw: DataFrame) -> DataFrame:
    """(repo, sha, path, ord, start, stop): changed lines after the change; hunks that only remove lines have none."""
    h = _with_path(raw).where(F.startswith("line", F.lit("@@")))
    start = F.nullif(F.regexp_extract("line", r"\+(\d+)(?:,(\d+))?", 1), F.lit("")).cast("int")
    count = F.coalesce(F.nullif(F.regexp_extract("line", r"\+(\d+)(?:,(\d+))?", 2), F.lit("")).cast("int"), F.lit(1))
    return h.select("repo", "sha", "path", F.col("line_no").alias("ord"), start.alias("start"), (start + count - 1).alias("stop")).where("stop >= start")


def diff_lines(raw: DataFrame) -> DataFrame:
    """(repo, sha, path, ord, sign, text). Content that begins like a file header is not told from one, and is left out."""
    d = _with_path(raw).where(F.substring("line", 1, 1).isin("+", "-") & ~F.substring("line", 1, 3).isin("+++", "---"))
    return d.select("repo", "sha", "path", F.col("line_no").alias("ord"), F.substring("line", 1, 1).alias("sign"), F.substr("line", F.lit(2)).alias("text"))


def issue_of(branch: Column, pattern: str) -> Column:
    """The pattern's first group, or all of its match, in a branch name; null without one, or if the pattern is bad."""
    import re

    try:
        groups = re.compile(pattern).groups
    except re.error:
        return F.lit(None).cast("string")
    return F.nullif(F.regexp_extract(branch, pattern, 1 if groups else 0), F.lit(""))
