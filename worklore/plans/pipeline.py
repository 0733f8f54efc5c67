"""Drivers: transcripts to records in one run, or through a durable queue that is staged and drained apart."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from worklore.config import CHARS_PER_TOKEN, DOLLARS_IN, DOLLARS_OUT, TOKENS_OUT, Config
from worklore.functions.predicates import is_dead_end
from worklore.functions.redact import redact, redact_column
from worklore.operators import anchors as anchor_ops
from worklore.operators import store
from worklore.operators.classify import Classifier, classify, extractor_id, prompt_of
from worklore.operators.segments import first_per_session, render, segment_members, segments, unprocessed
from worklore.sources import repos, transcripts


@dataclass(frozen=True)
class Repo:
    """One repository's tables."""

    state: DataFrame
    files: DataFrame
    commits: DataFrame
    commit_files: DataFrame
    diffs: DataFrame
    sources: DataFrame

    @classmethod
    def read(cls, spark: SparkSession, name: str, root: str, extra: list[str] | None = None) -> Repo:
        files = repos.repo_files(spark, name, root)
        paths = [r["path"] for r in files.select("path").collect() if r["path"].endswith(anchor_ops.SOURCE_SUFFIXES)] + list(extra or [])
        return cls(repos.repo_state(spark, name, root), files, repos.commits(spark, name, root), repos.commit_files(spark, name, root), repos.diffs(spark, name, root), repos.sources(spark, name, root, list(dict.fromkeys(paths))))


def load(spark: SparkSession, paths: str | list[str], root: str, tracked: DataFrame, ignored: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(turns, sessions) with paths below root that are tracked, or named and not ignored."""
    turns, sessions = transcripts.parse(transcripts.read_lines(spark, paths))
    named = transcripts.candidate_paths(turns, root)
    if ignored is None:
        named = repos.existing_files(spark, root, named)
        ignored = repos.ignored_files(spark, root, named)
    known = transcripts.allowed_files(named, tracked, ignored)
    return transcripts.with_steps(transcripts.normalize_paths(turns, root, known)), sessions


def units(turns: DataFrame, cfg: Config) -> DataFrame:
    """Segments with their rendered text, first branch and hash."""
    segs = segments(turns, cfg.segmentation)
    m = segment_members(turns, cfg.segmentation)
    one = F.struct("idx", "role", "is_human", "text", "tool_calls", "tool_results", "git_branch")
    t = turns.join(m, ["session_id", "idx"]).groupBy("session_id", "start_turn", "end_turn").agg(F.sort_array(F.collect_list(F.struct("idx", one.alias("t")))).alias("ts"))
    named = F.filter("ts", lambda x: x["t"]["git_branch"].isNotNull() & (x["t"]["git_branch"] != "HEAD"))
    t = t.select("session_id", "start_turn", "end_turn", render(F.transform("ts", lambda x: x["t"])).alias("rendered"), F.get(named, F.lit(0))["t"]["git_branch"].alias("git_branch"))
    return segs.join(t, ["session_id", "start_turn", "end_turn"])


def totals(segs: DataFrame, new: DataFrame, sessions: DataFrame, dropped: int = 0) -> DataFrame:
    """One row: transcripts, segments_total, segments_new, input_chars, dropped, dollars."""
    k = F.lit(1).alias("_k")
    a = sessions.agg(F.countDistinct("session_id").alias("transcripts"), k)
    b = segs.agg(F.count("*").alias("segments_total"), k)
    c = new.agg(F.count("*").alias("segments_new"), F.coalesce(F.sum(F.length("rendered")), F.lit(0)).alias("input_chars"), k)
    return a.join(b, "_k").join(c, "_k").drop("_k").withColumn("dropped", F.lit(dropped)).withColumn("dollars", dollars(F.col("input_chars"), F.col("segments_new")))


def dollars(chars, n):
    """What classifying would cost."""
    return (chars / CHARS_PER_TOKEN * DOLLARS_IN + n * TOKENS_OUT * DOLLARS_OUT) / 1e6


def records_of(classified: DataFrame, anchored: DataFrame, extractor: str, created_at: str) -> DataFrame:
    """Records of units that were classified; anchored has hash, session_id, start_turn, end_turn, started_at, anchors."""
    r = classified.where("not dropped").select("hash", F.posexplode("candidates").alias("at", "c")).join(anchored, "hash")
    made = F.lit(created_at).cast("timestamp")
    return r.select(
        F.lit(store.SCHEMA_VERSION).alias("schema_version"), store.record_id(F.col("hash"), F.col("at").cast("string"), F.col("c.summary")).alias("id"), F.coalesce("started_at", made).alias("occurred_at"), made.alias("created_at"),
        "session_id", F.struct("start_turn", "end_turn").alias("segment"), "anchors", "c.kind", "c.outcome", "c.summary", "c.detail", "c.evidence", "c.source", "c.confidence", F.lit(extractor).alias("extractor"), F.lit(None).cast("string").alias("supersedes"),
    )


def read_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A state table, empty where it isn't there yet."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


CURSORS, SEEN = "session_id string, last_turn int", "hash string"
QUEUED = f"hash string, session_id string, start_turn int, end_turn int, started_at timestamp, anchors {anchor_ops.ANCHORS_DDL}, prompt string"


def _mark(done: DataFrame, home: str) -> None:
    """State is appended after the log, so that a crash between them repeats work and loses none; ids come from content,
    so repeated records are the same."""
    done.select("session_id", F.col("end_turn").alias("last_turn")).write.mode("append").json(f"{home}/cursors")
    done.select("hash").write.mode("append").json(f"{home}/seen")


def _anchored(new: DataFrame, repo: Repo, cfg: Config) -> DataFrame:
    return anchor_ops.resolve(new, repo.state, repo.commits, repo.commit_files, repos.diff_lines(repo.diffs), repos.hunks(repo.diffs), repo.sources, cfg.issue_pattern)


def _new_units(turns: DataFrame, home: str, cfg: Config, limit: int) -> tuple[DataFrame, DataFrame]:
    spark = turns.sparkSession
    every = units(turns, cfg)
    new = unprocessed(every, read_state(spark, f"{home}/cursors", CURSORS), read_state(spark, f"{home}/seen", SEEN))
    return every, first_per_session(new, limit) if limit else new


def process(turns: DataFrame, sessions: DataFrame, repo: Repo, home: str, cfg: Config, created_at: str, classifier: Classifier | None = None, limit: int = 0) -> DataFrame:
    """Records of what is new in the turns, appended to home/records; without a classifier nothing is written. One row of
    totals comes back. The new units are written once, so that every later step reads the same ones."""
    every, new = _new_units(turns, home, cfg, limit)
    if classifier is None:
        return totals(every, new, sessions)
    spark = turns.sparkSession
    work = f"{home}/work"
    _anchored(new, repo, cfg).write.mode("overwrite").parquet(f"{work}/units")
    anchored = spark.read.parquet(f"{work}/units")
    prompts = redact_column(anchored.select("hash", prompt_of(F.col("rendered")).alias("prompt")), "prompt")
    classify(prompts, classifier).write.mode("overwrite").parquet(f"{work}/classified")
    classified = spark.read.parquet(f"{work}/classified")
    store.append(records_of(classified, anchored, extractor_id(cfg.model), created_at), f"{home}/records")
    _mark(anchored, home)
    return totals(every, anchored, sessions, classified.where("dropped").count())


def stage(turns: DataFrame, repo: Repo, home: str, cfg: Config) -> int:
    """Queue what is new and not yet queued, redacted; no classifier is needed. Returns how many."""
    spark = turns.sparkSession
    _, new = _new_units(turns, home, cfg, 0)
    queued = read_state(spark, f"{home}/pending", QUEUED).select("hash")
    new = new.join(queued, "hash", "left_anti")
    prompts = redact_column(_anchored(new, repo, cfg).withColumn("prompt", prompt_of(F.col("rendered"))), "prompt")
    ready = prompts.df.select("hash", "session_id", "start_turn", "end_turn", "started_at", "anchors", "prompt")
    ready.write.mode("overwrite").parquet(f"{home}/work/staged")
    staged = spark.read.parquet(f"{home}/work/staged")
    staged.write.mode("append").json(f"{home}/pending")
    if not prompts.failed.isEmpty():
        _mark(prompts.failed, home)
    return staged.count()


def pending(spark: SparkSession, home: str) -> DataFrame:
    """The queue: what was staged and not drained."""
    gone = read_state(spark, f"{home}/drained", SEEN)
    return read_state(spark, f"{home}/pending", QUEUED).dropDuplicates(["hash"]).join(gone, "hash", "left_anti")


def drain(spark: SparkSession, home: str, cfg: Config, created_at: str, classifier: Classifier | None = None, results: DataFrame | None = None, limit: int = 0) -> DataFrame:
    """Records of queued units, by a classifier or from results(hash, reply) made elsewhere. Units without a result stay;
    with an invalid one they stay too and count as dropped; those that a classifier could not do leave the queue. Drained
    units are marked, so that they aren't staged again. Returns one row: drained, dropped, records, input_chars."""
    if classifier is None and results is None:
        raise ValueError("drain takes a classifier or results")
    queue = pending(spark, home)
    if limit:
        queue = queue.orderBy("hash").limit(limit)
    queue.write.mode("overwrite").parquet(f"{home}/work/draining")
    queue = spark.read.parquet(f"{home}/work/draining")
    if results is not None:
        answers = results.select("hash", "reply").dropDuplicates(["hash"])
        got = queue.select("hash").join(answers, "hash")
        parsed = got.withColumn("candidates", store.candidates_of(F.col("reply")))
        clean = lambda c: c.withField("summary", redact(c["summary"])).withField("detail", redact(c["detail"]))
        classified = parsed.select("hash", F.transform("candidates", clean).alias("candidates"), F.col("candidates").isNull().alias("dropped"))
    else:
        classified = classify(redact_column(queue, "prompt"), classifier).drop("drop_reason")
    classified.write.mode("overwrite").parquet(f"{home}/work/answers")
    classified = spark.read.parquet(f"{home}/work/answers")
    made = records_of(classified, queue, extractor_id(cfg.model), created_at)
    store.append(made, f"{home}/records")
    finished = classified.where("not dropped") if results is not None else classified
    done = queue.join(finished.select("hash"), "hash", "left_semi")
    _mark(done, home)
    done.select("hash").write.mode("append").json(f"{home}/drained")
    k = F.lit(1).alias("_k")
    a = classified.agg(F.count("*").alias("drained"), F.count_if("dropped").alias("dropped"), k)
    b = made.agg(F.count("*").alias("records"), F.count_if(is_dead_end(F.col("kind"), F.col("outcome"), F.col("evidence"))).alias("dead_ends"), k)
    c = queue.join(classified.where("not dropped"), "hash", "left_semi").agg(F.coalesce(F.sum(F.length("prompt")), F.lit(0)).alias("input_chars"), k)
    return a.join(b, "_k").join(c, "_k").drop("_k")
