"""Anchors: the deterministic keys of a work unit, from files, diffs and sources."""

from __future__ import annotations

import ast
import keyword
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from worklore.functions.expressions import let
from worklore.sources.repos import issue_of

SCRIPT_SUFFIXES = (".ts", ".tsx", ".js", ".jsx", ".mjs")
SOURCE_SUFFIXES = (".py", *SCRIPT_SUFFIXES)
# Files that hold settings, patterns of their keys, and words that are never keys.
CONFIG_SUFFIXES = (".py", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".json", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".env", ".sh")
QUOTED_KEY = r"""(?U)["']([A-Za-z_][A-Za-z0-9_]{2,63})["']\s*:"""
ASSIGNED_KEY = r"(?U)(?<![\w.\-])([A-Za-z_][A-Za-z0-9_]{2,63})\s*(?:=|:)(?!=)"
FLAG_KEY = r"(?U)(?<![\w-])--([A-Za-z][A-Za-z0-9_-]{2,63})"
STOPWORDS = (
    "self cls args kwargs type def let var const int str bool float dict list tuple set none true false null case default "
    "http https note warning error todo returns raises param params result value data item items line text name path file "
    "url out res req obj key val"
).split()
METHODS = ("get", "post", "put", "patch", "delete", "head", "options")
NOT_DECLARED = ("if", "for", "while", "switch", "catch", "return")


def has_suffix(path: Column, suffixes: tuple[str, ...]) -> Column:
    return path.rlike("(" + "|".join(re.escape(s) for s in suffixes) + r")\z")


def plausible_setting(key: Column) -> Column:
    low = F.lower(key)
    bare = low.isin(*STOPWORDS, *(k for k in keyword.kwlist if k == k.lower()))
    upper = (key == F.upper(key)) & key.rlike("[A-Z]")
    return ~bare & (F.contains(key, F.lit("_")) | upper | key.rlike("[a-z][A-Z]"))


def settings_in_line(text: Column) -> Column:
    """Keys that one changed line sets, in order of the three patterns; comments set nothing."""
    stripped = F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+", "")
    of = lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(1))
    keys = F.concat(of(QUOTED_KEY), of(ASSIGNED_KEY), F.transform(of(FLAG_KEY), lambda k: F.translate(k, "-", "_")))
    return F.when(stripped.rlike(r"^(#|//|\*|/\*)") | (stripped == ""), F.array().cast("array<string>")).otherwise(F.filter(keys, plausible_setting))


def settings(lines: DataFrame) -> DataFrame:
    """diff_lines(…, path, ord, text) -> (repo, sha, path, ord, key): keys touched by changed lines of config files."""
    found = lines.where(has_suffix(F.col("path"), CONFIG_SUFFIXES)).withColumn("keys", settings_in_line(F.col("text")))
    return found.select("repo", "sha", "path", "ord", F.posexplode("keys").alias("at", "key"))


def _slashed(path: str) -> str:
    path = path.strip()
    return ("/" + path.strip("/") if not path.startswith("/") else path.rstrip("/")) or "/"


def python_routes(source: str) -> list[str]:
    """METHOD /path of each function with a routing decorator, under the first APIRouter's prefix."""
    try:
        nodes = list(ast.walk(ast.parse(source)))
    except (SyntaxError, ValueError):
        return []

    def called(node: ast.expr) -> str | None:
        return node.attr if isinstance(node, ast.Attribute) else getattr(node, "id", None)

    text = lambda node: node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None
    prefixes = (text(k.value) for n in nodes if isinstance(n, ast.Call) and called(n.func) == "APIRouter" for k in n.keywords if k.arg == "prefix")
    prefix = next((p for p in prefixes if p is not None), "").strip()
    prefix = ("/" + prefix if prefix and not prefix.startswith("/") else prefix).rstrip("/")
    found: dict[str, None] = {}
    for n in nodes:
        for d in n.decorator_list if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) else ():
            if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.func.attr in METHODS and d.args and (path := text(d.args[0])) is not None:
                found[f"{d.func.attr.upper()} {_slashed(prefix + _slashed(path))}"] = None
    return list(found)


@F.pandas_udf(T.ArrayType(T.StringType()))
def python_routes_of(source: pd.Series) -> pd.Series:
    return source.map(lambda s: python_routes(s) if s is not None else [])


def file_routes(path: Column, source: Column) -> Column:
    """Routes of an app-router file: its place below the last `app` folder is the URL; `page` files are pages, `route`
    files export methods."""
    parts = F.split(path, "/")
    stem = F.regexp_replace(F.get(parts, F.size(parts) - 1), r"\.[^.]*\z", "")
    at = F.array_max(F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p, i: F.when(p == "app", i).otherwise(-1)))
    inner = F.slice(parts, at + 2, F.size(parts) - at - 2)
    shown = F.filter(inner, lambda p: ~p.rlike(r"^\(.*\)$") & ~F.startswith(p, F.lit("_")))
    named = F.transform(shown, lambda p: F.when(p.rlike(r"^\[.*\]$"), F.concat(F.lit("{"), F.regexp_replace(F.regexp_replace(p, r"^\[(\.\.\.)?\[?", ""), r"\]?\]$", ""), F.lit("}"))).otherwise(p))
    url = F.concat(F.lit("/"), F.array_join(named, "/"))
    verbs = "(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)"
    of = lambda p: F.regexp_extract_all(source, F.lit(p), F.lit(1))
    methods = F.array_distinct(F.concat(of(rf"(?U)export\s+(?:async\s+)?function\s+{verbs}\b"), of(rf"(?U)export\s+const\s+{verbs}\b")))
    none = F.array().cast("array<string>")
    routed = let(url, lambda u: F.when(stem == "page", F.array(F.concat(F.lit("PAGE "), u))).when(stem == "route", F.transform(methods, lambda m: F.concat(m, F.lit(" "), u))).otherwise(none))
    return F.when(at >= 0, routed).otherwise(none)


def routes(sources: DataFrame) -> DataFrame:
    """sources(repo, path, text) -> (repo, path, at, route)."""
    py = sources.where(F.endswith("path", F.lit(".py"))).withColumn("found", python_routes_of("text"))
    js = sources.where(has_suffix(F.col("path"), SCRIPT_SUFFIXES)).withColumn("found", file_routes(F.col("path"), F.col("text")))
    return py.unionByName(js).select("repo", "path", F.posexplode("found").alias("at", "route"))


def python_spans(source: str) -> list[tuple[int, int, str]]:
    """(first line, last line, dotted name) of each definition."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    out: list[tuple[int, int, str]] = []
    todo = [(tree, "")]
    while todo:
        node, prefix = todo.pop()
        inner = []
        for child in ast.iter_child_nodes(node):
            name = prefix
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                name = f"{prefix}.{child.name}" if prefix else child.name
                out.append((child.lineno, child.end_lineno or child.lineno, name))
            inner.append((child, name))
        todo += reversed(inner)
    return out


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("name", T.StringType())]))


@F.pandas_udf(SPANS)
def python_spans_of(source: pd.Series) -> pd.Series:
    return source.map(lambda s: [{"start": a, "stop": b, "name": n} for a, b, n in python_spans(s or "")])


# Fixed value: what a declaration line of a script looks like.
DECLARATION = (
    r"^(?P<indent>[ \t]*)(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:class\s+(?P<a>[A-Za-z_$][\w$]*)|(?:async\s+)?function\s*\*?\s*(?P<b>[A-Za-z_$][\w$]*)"
    r"|(?:const|let|var)\s+(?P<c>[A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*(?::[^=]+)?=>|[A-Za-z_$][\w$]*\s*=>)"
    r"|(?P<d>[A-Za-z_$][\w$]*)\s*\([^)]*\)\s*(?::[^{]+)?\{)"
)


def script_declarations(source: str) -> list[tuple[int, str]]:
    """(line, dotted name by indentation) of each declaration: a name is preceded by those of the nearest earlier
    declarations with ever less indentation."""
    pattern, out, open_ = re.compile(DECLARATION), [], []
    for number, line in enumerate(source.splitlines(), 1):
        m = pattern.match(line)
        name = m and next((m[g] for g in "abcd" if m[g]), None)
        if not name or name in NOT_DECLARED:
            continue
        indent = len(m["indent"].expandtabs(4))
        open_ = [o for o in open_ if o[0] < indent] + [(indent, name)]
        out.append((number, ".".join(n for _, n in open_)))
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("line", T.IntegerType()), T.StructField("name", T.StringType())])))
def script_declarations_of(source: pd.Series) -> pd.Series:
    return source.map(lambda s: [{"line": a, "name": n} for a, n in script_declarations(s or "")])


LINES_EACH = 64


def innermost(ranges: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """ranges(keys…, ord, start, stop) with the name of the shortest of spans(keys…, s_start, s_stop, name, at) that each
    overlaps; the first of equals. Ranges that overlap none are left out. Both enter buckets of LINES_EACH lines, so that a
    range is joined with the spans of its buckets, not with all of its file."""
    blocks = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / LINES_EACH), F.floor(F.greatest(a, b) / LINES_EACH))).alias("_block")
    met = ranges.select("*", blocks("start", "stop")).join(spans.select("*", blocks("s_start", "s_stop")), [*keys, "_block"]).where("s_start <= stop and s_stop >= start")
    best = F.min_by("name", F.struct(F.col("s_stop") - F.col("s_start"), F.col("at")))
    return met.groupBy(*keys, "ord", "start", "stop").agg(best.alias("name"))


def as_of(points: DataFrame, marks: DataFrame, keys: list[str]) -> DataFrame:
    """points(keys…, line) with the name of the last of marks(keys…, mark_line, name) at or before the line: a union and
    a running last value, so no pair of rows is ever joined."""
    both = points.select(*keys, "line", F.lit(None).cast("string").alias("name"), F.lit(1).alias("_side")).unionByName(marks.select(*keys, F.col("mark_line").alias("line"), "name", F.lit(0).alias("_side")))
    w = Window.partitionBy(*keys).orderBy("line", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("name", F.last("name", ignorenulls=True).over(w)).where("_side = 1 and name is not null").select(*keys, "line", "name").distinct()


def symbols(sources: DataFrame, ranges: DataFrame) -> DataFrame:
    """(repo, path, ord, name): the definitions that changed ranges(repo, path, ord, start, stop) touch."""
    py = sources.where(F.endswith("path", F.lit(".py"))).withColumn("found", python_spans_of("text"))
    spans = py.select("repo", "path", F.posexplode("found").alias("at", "s")).select("repo", "path", "at", F.col("s.start").alias("s_start"), F.col("s.stop").alias("s_stop"), "s.name")
    inner = innermost(ranges.where(F.endswith("path", F.lit(".py"))), spans, ["repo", "path"]).select("repo", "path", "ord", "name")
    js = sources.where(has_suffix(F.col("path"), SCRIPT_SUFFIXES)).withColumn("found", script_declarations_of("text"))
    marks = js.select("repo", "path", F.explode("found").alias("d")).select("repo", "path", F.col("d.line").alias("mark_line"), "d.name")
    ends = ranges.select("repo", "path", "ord", F.explode(F.array("start", "stop")).alias("line"))
    near = as_of(ends.select("repo", "path", "line").distinct(), marks, ["repo", "path"])
    return inner.unionByName(ends.join(near, ["repo", "path", "line"]).select("repo", "path", "ord", "name")).distinct()


def commits_in_windows(segs: DataFrame, commits: DataFrame, keys: list[str] | None = None, bucket_s: int = 86400) -> DataFrame:
    """Segments ⋈ commits with started_at <= committed_at <= ended_at (and equal keys), an interval join over time buckets: a segment is
    copied to each bucket that it touches, a commit is in one, so the join is an equi-join and nothing is broadcast."""
    day = lambda c: F.floor(F.unix_micros(c) / (bucket_s * 1_000_000))
    s = segs.where("started_at is not null and ended_at is not null").withColumn("_bucket", F.explode(F.sequence(day("started_at"), day("ended_at"))))
    return s.join(commits.withColumn("_bucket", day("committed_at")), ["_bucket", *(keys or [])]).where("committed_at between started_at and ended_at").drop("_bucket")


ANCHORS_DDL = "struct<files:array<string>,routes:array<string>,symbols:array<string>,settings:array<string>,branch:string,issue:string,commits:array<string>,head_sha:string>"


def resolve(segs: DataFrame, state: DataFrame, commits: DataFrame, commit_files: DataFrame, lines: DataFrame, hunks: DataFrame, sources: DataFrame, issue_pattern: str) -> DataFrame:
    """Add `anchors` to segs(hash, files, started_at, ended_at, git_branch) of one repository. Diffs of commits in the
    segment's time and of the working tree give settings and symbols; sources give routes."""
    key = segs.select("hash")
    inside = commits_in_windows(segs.select("hash", "started_at", "ended_at"), commits).select("hash", "sha", "ord")
    own = segs.select("hash", F.posexplode("files").alias("at", "path")).select("hash", F.struct(F.lit(-1).alias("a"), F.lit(-1).alias("b"), F.col("at").alias("c")).alias("pos"), "path")
    added = inside.join(commit_files.withColumnRenamed("ord", "at"), "sha").select("hash", F.struct(F.col("ord").alias("a"), F.lit(0).alias("b"), F.col("at").alias("c")).alias("pos"), "path")
    files = own.unionByName(added).groupBy("hash", "path").agg(F.min("pos").alias("pos"))
    shas = inside.select("hash", "sha", "ord").unionByName(key.select("hash", F.lit(None).cast("string").alias("sha"), F.lit(1 << 30).alias("ord")))
    shas = shas.withColumn("sha", F.coalesce("sha", F.lit("")))
    by_sha = lambda df: df.withColumn("sha", F.coalesce("sha", F.lit("")))
    set_ = by_sha(settings(lines)).withColumnRenamed("ord", "line_no").join(shas, "sha").join(files, ["hash", "path"]).select("hash", F.struct("pos", "ord", "line_no", "at").alias("o"), F.col("key").alias("v"))
    rts = routes(sources).join(files, "path").select("hash", F.struct("pos", F.lit(0).alias("ord"), F.lit(0).alias("line_no"), "at").alias("o"), F.col("route").alias("v"))
    touched = by_sha(hunks).withColumnRenamed("ord", "line_no")
    sym = symbols(sources, touched.select("repo", "path", F.struct("sha", "line_no").alias("ord"), "start", "stop"))
    sym = sym.select("path", F.col("ord.sha").alias("sha"), F.col("ord.line_no").alias("line_no"), "name").join(shas, "sha").join(files.select("hash", "path", "pos"), ["hash", "path"]).select("hash", F.struct("pos", "ord", "line_no", F.lit(0).alias("at")).alias("o"), F.col("name").alias("v"))
    first = lambda df, name: df.groupBy("hash", "v").agg(F.min("o").alias("o")).groupBy("hash").agg(F.transform(F.sort_array(F.collect_list(F.struct("o", "v"))), lambda x: x["v"]).alias(name))
    out = segs
    for df, name in (
        (files.select("hash", F.struct("pos").alias("o"), F.col("path").alias("v")), "_files"),
        (rts, "_routes"),
        (sym, "_symbols"),
        (set_, "_settings"),
        (inside.select("hash", F.struct("ord").alias("o"), F.col("sha").alias("v")), "_commits"),
    ):
        out = out.join(first(df, name), "hash", "left")
    one = state.select(F.col("branch").alias("_branch"), F.col("head_sha").alias("_head")).limit(1).first()
    head = (one["_branch"], one["_head"]) if one else (None, None)
    branch = F.coalesce(F.lit(head[0]).cast("string"), F.col("git_branch"))
    none = F.array().cast("array<string>")
    a = F.struct(*(F.coalesce(f"_{x}", none).alias(x) for x in ("files", "routes", "symbols", "settings")), branch.alias("branch"), issue_of(branch, issue_pattern).alias("issue"), F.coalesce("_commits", none).alias("commits"), F.lit(head[1]).cast("string").alias("head_sha"))
    return out.withColumn("anchors", a.cast(ANCHORS_DDL)).drop("_files", "_routes", "_symbols", "_settings", "_commits")
