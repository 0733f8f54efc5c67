"""Session transcripts: finding files, reading lines in order, parsing them into turns.

A session file holds one JSON object a line. Lines are read as text, numbered by their place in the file, and parsed by
built-in JSON expressions; only the walk for path-shaped strings in tool inputs, which needs values apart from keys and
in document order, is an Arrow UDF.
"""

from __future__ import annotations

import json
import re
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from worklore.config import RESULT_HEAD, RESULT_TAIL, THINKING_CHARS, TOOL_CHARS, TURN_CHARS
from worklore.functions.expressions import strip, truncate, truncate_ends
from worklore.functions.predicates import shows_failure, shows_success

# Tool input keys that name a file, that may, and that summarise a call.
FILE_KEYS = ("file_path", "notebook_path", "filePath")
MAYBE_FILE_KEYS = ("path",)
SUMMARY_KEYS = ("command", "pattern", "query", "prompt", "description")
PATH_SHAPE = r"[A-Za-z0-9_./\-]*[A-Za-z0-9_\-]\.[A-Za-z0-9]{1,10}"
MAX_DEPTH = 4


def project_dir_name(cwd: str) -> str:
    return cwd.replace("/", "-")


def project_dir(cwd: str, root: str) -> str:
    return f"{root}/{project_dir_name(cwd)}"


def list_sessions(spark: SparkSession, pattern: str, days: float | None = None, now: float | None = None) -> DataFrame:
    """(file, modified, length) of the session files that a glob names, newest first; `days` keeps those modified within
    that many days of `now` (seconds; the current time by default). No match gives no rows."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    schema = "file string, modified timestamp, length long"
    if not found:
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").load(pattern).select(F.col("path").alias("file"), F.col("modificationTime").alias("modified"), "length")
    if days is not None:
        at = F.lit(now) if now is not None else F.unix_micros(F.current_timestamp()) / 1e6
        files = files.where(F.unix_micros("modified") / 1e6 >= at - days * 86400)
    return files.orderBy(F.col("modified").desc(), "file")


def find_session(spark: SparkSession, session_id: str, cwd: str, root: str) -> str | None:
    """The file of a session of a working directory, or None if there is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{project_dir(cwd, root)}/{session_id}.jsonl")
    return where.toString() if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where) else None


def sessions_of(spark: SparkSession, cwd: str, root: str, days: float | None = None) -> DataFrame:
    return list_sessions(spark, f"{project_dir(cwd, root)}/*.jsonl", days)


def all_sessions(spark: SparkSession, root: str, days: float | None = None) -> DataFrame:
    return list_sessions(spark, f"{root}/*/*.jsonl", days)


def prune(spark: SparkSession, root: str, days: float, now: float) -> int:
    """Delete session files older than `days`; files that can't be deleted are left. Returns how many went."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/*/*.jsonl")
    fs = path.getFileSystem(conf)
    return sum(1 for f in fs.globStatus(path) or [] if f.getModificationTime() / 1000 < now - days * 86400 and fs.delete(f.getPath(), False))


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, line_no, value): the lines that aren't blank, stripped and numbered in file order."""
    raw = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"), strip(F.col("value")).alias("value"))
    order = Window.partitionBy("file").orderBy("_block", "_row")
    return raw.where(F.length("value") > 0).withColumn("line_no", F.row_number().over(order)).select("file", "line_no", "value")


def files_touching(lines: DataFrame, root: str) -> DataFrame:
    """Files of which some line names the root; a longer path with the same beginning counts too."""
    return lines.where(F.contains("value", F.lit(root))).select("file").distinct()


def _walk(value, depth: int, found: dict) -> None:
    if depth > MAX_DEPTH:
        return
    if isinstance(value, str):
        found.update(dict.fromkeys(re.findall(PATH_SHAPE, value)))
    elif isinstance(value, (dict, list)):
        for x in value.values() if isinstance(value, dict) else value:
            _walk(x, depth + 1, found)


def tool_paths(text: str | None) -> list[str]:
    """Path-shaped strings of a tool's input: named files, then a `path` with a suffix, then any in its values."""
    try:
        given = json.loads(text or "")
    except ValueError:
        return []
    if not isinstance(given, dict):
        return []
    found: dict[str, None] = {}
    for key in (*FILE_KEYS, *MAYBE_FILE_KEYS):
        v = given.get(key)
        if isinstance(v, str) and v and (key in FILE_KEYS or PurePosixPath(v).suffix):
            found[v] = None
    _walk(given, 0, found)
    return list(found)


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _all_tool_paths(inputs: pd.Series) -> pd.Series:
    return inputs.map(lambda xs: [tool_paths(x) for x in xs] if xs is not None else None)


BLOCK = "struct<type:string,text:string,thinking:string,id:string,name:string,input:string,tool_use_id:string,content:string,is_error:string>"


def tool_summary(name: Column, given: Column) -> Column:
    """name(value) by the first key that holds a string; quoted values only."""
    named = [F.nullif(F.get_json_object(given, f"$.{k}"), F.lit("")) for k in (*FILE_KEYS, *MAYBE_FILE_KEYS)]
    other = [truncate(F.nullif(F.get_json_object(given, f"$.{k}"), F.lit("")), TOOL_CHARS) for k in SUMMARY_KEYS]
    return F.coalesce(*(F.concat(name, F.lit("("), v, F.lit(")")) for v in named + other), name)


def _truthy(c: Column) -> Column:
    """What a JSON value is as a condition: null, false, 0 and empty values are false."""
    return F.coalesce(~c.isin("", "false", "0", "0.0", "[]", "{}", "null"), F.lit(False))


def _result_text(content: Column) -> Column:
    parts = F.from_json(content, "array<struct<type:string,text:string>>")
    joined = F.array_join(F.transform(F.filter(parts, lambda b: (b["type"] == "text") & (F.length(b["text"]) > 0)), lambda b: b["text"]), "\n")
    return F.when(F.startswith(F.ltrim(content), F.lit("[")), F.coalesce(joined, F.lit(""))).when(F.startswith(F.ltrim(content), F.lit("{")), "").otherwise(F.coalesce(content, F.lit("")))


CALLS = "array<struct<id:string,name:string,paths:array<string>,text:string>>"
RESULTS = "array<struct<tool_use_id:string,is_error:boolean,text:string>>"


def parse(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, sessions) of lines(file, line_no, value). Lines that aren't JSON objects, and conversation lines that say
    nothing, are counted as skipped; other types are listed."""
    j = lambda path: F.get_json_object("value", path)
    good = F.try_parse_json("value").isNotNull() & F.startswith("value", F.lit("{"))
    quoted = F.schema_of_variant(F.variant_get(F.try_parse_json("value"), "$.type", "variant")) == "STRING"
    kind = F.when(good & quoted, j("$.type"))
    raw = lines.select("file", "line_no", "value", good.alias("good"), kind.alias("type"))
    talk = F.col("type").isin("user", "assistant")
    content = j("$.message.content")
    # get_json_object unquotes strings, so a list is told from a string by the raw message
    is_list = F.get_json_object("value", "$.message.content[0]").isNotNull() | (content == "[]")
    blocks = F.from_json(F.when(F.col("_list"), F.col("_content")), f"array<{BLOCK}>")
    rows = raw.withColumn("_talk", F.coalesce(talk, F.lit(False))).withColumn("_content", F.when(F.col("_talk"), content)).withColumn("_list", F.col("_talk") & F.coalesce(is_list, F.lit(False)))
    rows = rows.withColumn("_blocks", F.coalesce(blocks, F.array().cast(f"array<{BLOCK}>")))
    some = lambda c: F.coalesce(F.length(strip(c)) > 0, F.lit(False))
    said = F.filter("_blocks", lambda b: ((b["type"] == "text") & some(b["text"])) | ((F.col("type") == "assistant") & (b["type"] == "thinking") & some(b["thinking"])))
    texts = F.transform(said, lambda b: F.when(b["type"] == "text", strip(b["text"])).otherwise(F.concat(F.lit("[thinking] "), truncate(b["thinking"], THINKING_CHARS))))
    uses = F.filter("_blocks", lambda b: (F.col("type") == "assistant") & (b["type"] == "tool_use"))
    name = lambda b: F.coalesce(F.nullif(b["name"], F.lit("")), F.lit("unknown"))
    answers = F.filter("_blocks", lambda b: (F.col("type") == "user") & (b["type"] == "tool_result"))
    rows = rows.withColumn("_texts", texts).withColumn("_uses", uses)
    rows = rows.withColumn("_paths", F.when(F.size("_uses") > 0, _all_tool_paths(F.transform("_uses", lambda b: b["input"]))))
    calls = F.transform("_uses", lambda b, i: F.struct(F.coalesce(b["id"], F.lit("")).alias("id"), name(b).alias("name"), F.get("_paths", i).alias("paths"), tool_summary(name(b), b["input"]).alias("text")))
    results = F.transform(answers, lambda b: F.struct(F.coalesce(b["tool_use_id"], F.lit("")).alias("tool_use_id"), _truthy(b["is_error"]).alias("is_error"), truncate_ends(_result_text(b["content"]), RESULT_HEAD, RESULT_TAIL).alias("text")))
    plain = (F.col("type") == "user") & ~F.col("_list") & some(F.col("_content")) & ~F.startswith(F.ltrim("_content"), F.lit("{"))
    meta = (F.col("type") == "user") & _truthy(j("$.isMeta"))
    human = F.coalesce(j("$.origin.kind") == "human", F.lit(False))
    rows = rows.withColumn("tool_calls", calls.cast(CALLS)).withColumn("tool_results", results.cast(RESULTS)).withColumn("_plain", F.coalesce(plain, F.lit(False)))
    kept = F.col("_talk") & ~meta & (F.col("_plain") | (F.size("_texts") > 0) | (F.size("tool_calls") > 0) | (F.size("tool_results") > 0))
    text = F.when(F.col("_plain"), truncate(F.col("_content"), TURN_CHARS)).otherwise(truncate(F.array_join("_texts", "\n"), TURN_CHARS))
    is_human = (F.col("type") == "user") & F.when(F.col("_plain"), human | F.coalesce(j("$.promptSource") == "typed", F.lit(False))).otherwise(human & (F.size("_texts") > 0))
    session = F.coalesce(F.nullif(j("$.sessionId"), F.lit("")), F.nullif(j("$.session_id"), F.lit("")))
    rows = rows.withColumn("_kept", kept).select(
        "file", "line_no", "good", "type", "_talk", "_kept", "tool_calls", "tool_results",
        text.alias("text"), is_human.alias("is_human"), F.when(F.col("_talk"), session).alias("_session"), F.when(F.col("_talk"), j("$.cwd")).alias("cwd"),
        F.try_to_timestamp(j("$.timestamp")).alias("ts"), j("$.uuid").alias("uuid"), j("$.gitBranch").alias("git_branch"), _truthy(j("$.isSidechain")).alias("is_sidechain"),
    )
    stem = F.regexp_extract("file", r"([^/]+?)(?:\.[^./]*)?$", 1)
    sessions = rows.groupBy("file").agg(
        F.coalesce(F.max_by("_session", F.when(F.col("_session").isNotNull(), F.col("line_no"))), F.first(stem)).alias("session_id"),
        F.min_by("cwd", F.when(F.col("cwd").isNotNull(), F.col("line_no"))).alias("cwd"),
        F.count_if("_kept").alias("n_turns"),
        F.count_if(~F.col("good") | F.col("type").isNull() | (F.col("_talk") & ~F.col("_kept"))).alias("skipped_lines"),
        F.sort_array(F.collect_set(F.when(F.col("good") & ~F.col("_talk"), F.col("type")))).alias("unknown_types"),
    )
    idx = (F.row_number().over(Window.partitionBy("file").orderBy("line_no")) - 1).alias("idx")
    turns = rows.where("_kept").select("file", idx, F.col("type").alias("role"), "ts", "text", "tool_calls", "tool_results", "uuid", "is_sidechain", "is_human", "cwd", "git_branch")
    return turns.join(sessions.select("file", "session_id"), "file"), sessions


def lexical(path: Column, root: Column) -> Column:
    """The path below root, without dots, or null if it is outside or is the root; links are not followed."""
    clean = F.regexp_replace(strip(path), r"^[`'\"(),;:]+|[`'\"(),;:]+$", "")
    whole = F.when(F.startswith(clean, F.lit("/")), clean).otherwise(F.concat(root, F.lit("/"), clean))
    step = lambda acc, x: F.when(x.isin("", "."), acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    parts = F.aggregate(F.split(whole, "/"), F.array().cast("array<string>"), step)
    full = F.concat(F.lit("/"), F.array_join(parts, "/"))
    inside = (F.length(clean) > 0) & F.startswith(full, F.concat(root, F.lit("/")))
    return F.when(inside, F.substr(full, F.length(root) + 2))


def candidate_paths(turns: DataFrame, root: str) -> DataFrame:
    """Distinct paths below root that the turns' tool calls name."""
    every = F.flatten(F.transform("tool_calls", lambda c: c["paths"]))
    return turns.select(F.explode(every).alias("p")).select(lexical(F.col("p"), F.lit(root)).alias("path")).where("path is not null").distinct()


def allowed_files(candidates: DataFrame, tracked: DataFrame, ignored: DataFrame) -> DataFrame:
    """Tracked files, and candidates that aren't ignored."""
    return tracked.select("path").union(candidates.join(ignored.select("path"), "path", "left_anti")).distinct()


def normalize_paths(turns: DataFrame, root: str, known: DataFrame) -> DataFrame:
    """Keep, of each call's paths, those among known(path), below the root and without repeats; take the root out of all
    texts. turns has session_id and idx."""
    e = turns.select("session_id", "idx", F.posexplode("tool_calls").alias("call", "c")).select("session_id", "idx", "call", F.posexplode("c.paths").alias("at", "p"))
    e = e.withColumn("path", lexical(F.col("p"), F.lit(root))).join(known.select("path").distinct(), "path", "left_semi")
    per_call = e.groupBy("session_id", "idx", "call").agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("at", "path"))), lambda x: x["path"])).alias("paths"))
    per_turn = per_call.groupBy("session_id", "idx").agg(F.map_from_entries(F.collect_list(F.struct("call", "paths"))).alias("_by_call"))
    bare = lambda c: F.replace(c, F.lit(root + "/"), F.lit(""))
    t = turns.join(per_turn, ["session_id", "idx"], "left")
    calls = F.transform("tool_calls", lambda c, i: F.struct(c["id"].alias("id"), c["name"].alias("name"), F.coalesce(F.try_element_at("_by_call", i), F.array().cast("array<string>")).alias("paths"), bare(c["text"]).alias("text")))
    results = F.transform("tool_results", lambda r: F.struct(r["tool_use_id"].alias("tool_use_id"), r["is_error"].alias("is_error"), bare(r["text"]).alias("text")))
    return t.withColumn("tool_calls", calls).withColumn("tool_results", results).withColumn("text", bare(F.col("text"))).drop("_by_call")


def with_steps(turns: DataFrame) -> DataFrame:
    """Add what segmentation reads: files, failed, passed."""
    files = F.array_distinct(F.flatten(F.transform("tool_calls", lambda c: c["paths"])))
    return turns.withColumn("files", files).withColumn("failed", shows_failure(F.col("tool_results"))).withColumn("passed", shows_success(F.col("tool_results")))
