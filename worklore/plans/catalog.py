"""Queries over the driver's tables, by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worklore.config import RESULT_HEAD, RESULT_TAIL, Segmentation
from worklore.functions import redact as rx
from worklore.functions.expressions import truncate, truncate_ends
from worklore.operators import anchors as an
from worklore.operators import context, quality, retrieve, segments, store
from worklore.plans.adapters import GAP_MINUTES, RECORDS_SQL, TURNS_SQL, documents_for_search, documents_index, records, table, turns
from worklore.plans.pipeline import dollars

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def epoch(c: str):
    return F.floor(F.unix_micros(c) / 1_000_000).cast("long")


UNIT_GAP = 1440  # minutes; several units to a session

# Work units


@query()
def segment_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments.segments(turns(spark, sf_dir), Segmentation(max_gap_minutes=GAP_MINUTES))
    return s.select("session_id", "start_turn", "end_turn", "turn_count", F.array_join("files", ",").alias("files"), "tool_errors", epoch("started_at").alias("started"), epoch("ended_at").alias("ended"), "hash")


GAPS_SQL = f"""{TURNS_SQL}, flagged AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY session_id ORDER BY idx) > {UNIT_GAP}::BIGINT * 60000000 THEN 1 ELSE 0 END AS g FROM turns),
gaps AS (SELECT *, sum(g) OVER (PARTITION BY session_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS gap_no FROM flagged)"""


@query(f"WITH {GAPS_SQL} SELECT session_id, idx, gap_no::BIGINT AS gap_no FROM gaps")
def gap_sessionize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.gap_sessions(turns(spark, sf_dir), UNIT_GAP).select("session_id", "idx", F.col("gap_no").cast("long").alias("gap_no"))


def _gap_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = segments.gap_sessions(turns(spark, sf_dir), UNIT_GAP)
    return t.groupBy("session_id", "gap_no").agg(F.min("idx").alias("start_turn"), F.max("idx").alias("end_turn"), F.count("*").alias("turn_count"), F.count_if("failed").alias("tool_errors"), F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.sort_array(F.collect_set(F.get("files", F.lit(0)))).alias("files"))


UNITS_SQL = f"""{GAPS_SQL}, units AS (SELECT session_id, gap_no, min(idx) AS start_turn, max(idx) AS end_turn, count(*) AS turn_count, count(*) FILTER (failed) AS tool_errors, min(ts) AS started, max(ts) AS ended,
 coalesce(list_sort(list(DISTINCT files[1]) FILTER (len(files) > 0)), []) AS files FROM gaps GROUP BY ALL)"""


@query(f"WITH {UNITS_SQL} SELECT session_id, start_turn, end_turn, turn_count, tool_errors, epoch_us(started) // 1000000 AS started, epoch_us(ended) // 1000000 AS ended, array_to_string(files, ',') AS files FROM units")
def session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gap_units(spark, sf_dir).select("session_id", "start_turn", "end_turn", "turn_count", "tool_errors", epoch("started_at").alias("started"), epoch("ended_at").alias("ended"), F.array_join("files", ",").alias("files"))


HASH_SQL = "substr(sha256(session_id || ':' || start_turn::VARCHAR || ':' || end_turn::VARCHAR), 1, 16)"


@query(f"WITH {UNITS_SQL} SELECT session_id, start_turn, end_turn, {HASH_SQL} AS hash FROM units")
def segment_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gap_units(spark, sf_dir).select("session_id", "start_turn", "end_turn", segments.segment_hash().alias("hash"))


@query(f"""WITH {UNITS_SQL}, h AS (SELECT *, {HASH_SQL} AS hash FROM units), cursors AS (SELECT session_id, max(end_turn) AS last_turn FROM h WHERE gap_no <= 1 GROUP BY 1),
 seen AS (SELECT hash FROM h WHERE gap_no % 3 = 2)
 SELECT h.session_id, h.start_turn, h.end_turn FROM h LEFT JOIN cursors c USING (session_id) WHERE hash NOT IN (SELECT hash FROM seen) AND h.end_turn > coalesce(c.last_turn, -1)""")
def unprocessed_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _gap_units(spark, sf_dir).withColumn("hash", segments.segment_hash())
    cursors = u.where("gap_no <= 1").select("session_id", F.col("end_turn").alias("last_turn"))
    return segments.unprocessed(u, cursors, u.where("gap_no % 3 = 2").select("hash")).select("session_id", "start_turn", "end_turn")


@query(f"""WITH {TURNS_SQL} SELECT session_id, idx, coalesce(last_value(CASE WHEN failed THEN true WHEN passed THEN false END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY idx ROWS UNBOUNDED PRECEDING), false) AS unresolved FROM turns""")
def failure_latch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.failure_latch(turns(spark, sf_dir)).select("session_id", "idx", "unresolved")


@query(f"""WITH {TURNS_SQL}, f AS (SELECT * FROM turns WHERE len(files) > 0), w AS (SELECT *, list(files[1]) OVER (PARTITION BY session_id ORDER BY idx ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS recent FROM f)
 SELECT session_id, idx, CASE WHEN recent IS NOT NULL AND len(recent) > 0 THEN list_contains(recent, files[1]) END AS overlap FROM w""")
def sliding_file_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.file_window_overlap(turns(spark, sf_dir)).select("session_id", "idx", F.col("overlaps").alias("overlap"))


@query(f"""WITH {GAPS_SQL}, windows AS (SELECT session_id, session_id::BIGINT % 100 AS repo, gap_no, min(ts) AS a, max(ts) AS b FROM gaps GROUP BY ALL), marks AS (SELECT event_id, user_id % 100 AS repo, ts FROM events WHERE event_type = 'signup')
 SELECT session_id, gap_no::BIGINT AS gap_no, event_id FROM windows JOIN marks ON windows.repo = marks.repo AND ts BETWEEN a AND b""")
def commit_window_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = segments.gap_sessions(turns(spark, sf_dir), UNIT_GAP).groupBy("session_id", "gap_no").agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at")).withColumn("repo", F.col("session_id").cast("long") % 100)
    marks = table(spark, sf_dir, "events").where(F.col("event_type") == "signup").select("event_id", (F.col("user_id") % 100).alias("repo"), F.col("ts").cast("timestamp").alias("committed_at"))
    return an.commits_in_windows(w, marks, ["repo"]).select("session_id", F.col("gap_no").cast("long").alias("gap_no"), "event_id")


@query(f"""WITH {TURNS_SQL}, points AS (SELECT session_id, idx FROM turns WHERE failed), marks AS (SELECT session_id, idx AS mark FROM turns WHERE passed)
 SELECT p.session_id, p.idx, m.mark FROM points p ASOF JOIN marks m ON p.session_id = m.session_id AND p.idx >= m.mark""")
def asof_last_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir)
    near = an.as_of(t.where("failed").select("session_id", F.col("idx").alias("line")), t.where("passed").select("session_id", F.col("idx").alias("mark_line"), F.col("idx").cast("string").alias("name")), ["session_id"])
    return near.select("session_id", F.col("line").alias("idx"), F.col("name").cast("int").alias("mark"))


@query("""WITH spans AS (SELECT l_orderkey, l_linenumber AS at, l_partkey % 100 AS s_start, l_partkey % 100 + l_quantity::BIGINT AS s_stop, l_linenumber::VARCHAR AS name FROM lineitem),
 ranges AS (SELECT l_orderkey, l_linenumber AS ord, l_suppkey % 100 AS start, l_suppkey % 100 + 5 AS stop FROM lineitem)
 SELECT r.l_orderkey, r.ord, arg_min(s.name, (s.s_stop - s.s_start) * 1000 + s.at) AS name FROM ranges r JOIN spans s ON r.l_orderkey = s.l_orderkey AND s.s_start <= r.stop AND s.s_stop >= r.start GROUP BY r.l_orderkey, r.ord, r.start, r.stop""")
def interval_innermost(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    spans = li.select("l_orderkey", F.col("l_linenumber").alias("at"), (F.col("l_partkey") % 100).alias("s_start"), (F.col("l_partkey") % 100 + F.col("l_quantity").cast("long")).alias("s_stop"), F.col("l_linenumber").cast("string").alias("name"))
    ranges = li.select("l_orderkey", F.col("l_linenumber").alias("ord"), (F.col("l_suppkey") % 100).alias("start"), (F.col("l_suppkey") % 100 + 5).alias("stop"))
    return an.innermost(ranges, spans, ["l_orderkey"]).select("l_orderkey", "ord", "name")


# Redaction and text


@query(r"""SELECT doc_id, sha256(regexp_replace(text, '\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b', '[REDACTED:email]', 'g')) AS digest FROM documents""")
def redact_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(rx.redact_email(F.col("text")), 256).alias("digest"))


@query(r"""SELECT doc_id, sha256(regexp_replace(text, '(^|[^\p{L}\p{N}_.])((?:\+\d{1,3}[ .\-]?)?(?:\(\d{3}\)[ .\-]?|\d{3}[ .\-])\d{3}[ .\-]\d{4})\b', '\1[REDACTED:phone]', 'g')) AS digest FROM documents""")
def redact_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(rx.redact_phone(F.col("text")), 256).alias("digest"))


@query()
def redact_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(rx.redact_assignments(F.col("text")), 256).alias("digest"))


@query()
def redact_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules over whole documents and pages."""
    texts = table(spark, sf_dir, "documents").select(F.lit("documents").alias("source"), F.col("doc_id").alias("id"), "text")
    texts = texts.unionByName(table(spark, sf_dir, "pages").select(F.lit("pages").alias("source"), F.col("page_id").alias("id"), F.col("html").alias("text")))
    d = texts.select("source", "id", rx.redact(F.col("text")).alias("clean"))
    return d.select("source", "id", F.sha2("clean", 256).alias("digest"), F.regexp_count("clean", F.lit(r"\[REDACTED:[a-z_ ]+\]")).alias("hits"))


STRIP_SQL = r"regexp_replace(regexp_replace({0}, '^\s+', ''), '\s+$', '')"


@query(f"""WITH t AS (SELECT conv_id, turn, {STRIP_SQL.format('text')} AS s FROM conversations)
 SELECT conv_id, turn, CASE WHEN length(s) > 300 THEN regexp_replace(substr(s, 1, 300), '\\s+$', '') || ' …[truncated]' ELSE s END AS text FROM t""")
def truncate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", truncate(F.col("text"), 300).alias("text"))


@query(f"""WITH t AS (SELECT conv_id, turn, {STRIP_SQL.format('text')} AS s FROM conversations)
 SELECT conv_id, turn, CASE WHEN length(s) > 900 THEN regexp_replace(substr(s, 1, 300), '\\s+$', '') || chr(10) || '…[' || (length(s) - 900)::VARCHAR || ' chars elided]…' || chr(10) || regexp_replace(right(s, 600), '^\\s+', '') ELSE s END AS text FROM t""")
def truncate_both_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", truncate_ends(F.col("text"), RESULT_HEAD, RESULT_TAIL).alias("text"))


RENDER_SQL = """r AS (SELECT conv_id, string_agg('[' || turn::VARCHAR || '] ' || CASE WHEN role = 'user' THEN 'human' ELSE role END || ':' || CASE WHEN length(text) > 0 THEN chr(10) || '  ' || text ELSE '' END, chr(10) ORDER BY turn) AS body FROM conversations GROUP BY 1),
 rendered AS (SELECT conv_id, CASE WHEN length(body) > 12000 THEN substr(body, 1, 6000) || chr(10) || chr(10) || '…[middle of segment elided]…' || chr(10) || chr(10) || right(body, 6000) ELSE body END AS body FROM r)"""


def _rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    turn = F.struct(F.col("turn").alias("idx"), "role", (F.col("role") == "user").alias("is_human"), "text", F.array().cast("array<struct<text:string>>").alias("tool_calls"), F.array().cast("array<struct<is_error:boolean,text:string>>").alias("tool_results"))
    g = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", turn.alias("t")))).alias("ts"))
    return g.select("conv_id", segments.render(F.transform("ts", lambda x: x["t"])).alias("body"))


@query(f"WITH {RENDER_SQL} SELECT conv_id, sha256(body) AS digest, length(body)::BIGINT AS n FROM rendered")
def render_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rendered(spark, sf_dir).select("conv_id", F.sha2("body", 256).alias("digest"), F.length("body").cast("long").alias("n"))


@query(f"WITH {RENDER_SQL} SELECT count(*) AS segments, sum(length(body))::BIGINT AS input_chars, round((sum(length(body)) / 4.0 * 1.0 + count(*) * 400 * 5.0) / 1e6, 6) AS dollars FROM rendered")
def cost_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _rendered(spark, sf_dir).agg(F.count("*").alias("segments"), F.sum(F.length("body")).cast("long").alias("input_chars"))
    return t.withColumn("dollars", F.round(dollars(F.col("input_chars"), F.col("segments")), 6))


@query(f"WITH {UNITS_SQL} SELECT count(*) AS segments, count(DISTINCT session_id) AS sessions, sum(turn_count)::BIGINT AS turns, sum(tool_errors)::BIGINT AS errors FROM units")
def dry_run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gap_units(spark, sf_dir).agg(F.count("*").alias("segments"), F.countDistinct("session_id").alias("sessions"), F.sum("turn_count").alias("turns"), F.sum("tool_errors").alias("errors"))


# The record store


@query(f"""WITH {RECORDS_SQL}, k AS (SELECT id, substr(regexp_replace(lower(summary), '[^a-z ]', '', 'g'), 1, 70) AS key FROM records),
 w AS (SELECT *, first_value(id) OVER (PARTITION BY key ORDER BY id) AS head, row_number() OVER (PARTITION BY key ORDER BY id) AS n FROM k) SELECT id, head FROM w WHERE n > 1 AND key <> ''""")
def near_duplicate_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = quality.by_key("key").orderBy("id")
    r = records(spark, sf_dir).select("id", quality.summary_key(F.col("summary")).alias("key"))
    return r.withColumn("head", F.first("id").over(w)).withColumn("n", F.row_number().over(w)).where("n > 1 and key <> ''").select("id", "head")


W_SQL = r"[\p{L}\p{N}_.\-]"
FINDINGS_SQL = rf"""{RECORDS_SQL}, b AS (SELECT *, summary || ' ' || detail AS body, substr(regexp_replace(lower(summary), '[^a-z ]', '', 'g'), 1, 70) AS key FROM records),
 w AS (SELECT *, first_value(id) OVER (PARTITION BY key ORDER BY created, id) AS head, row_number() OVER (PARTITION BY key ORDER BY created, id) AS n FROM b),
 found AS (
 SELECT id AS record_id, 'names-a-path' AS check_name, regexp_extract(body, '(?:{W_SQL}+/)+{W_SQL}+|\b{W_SQL}+\.(?:py|ts|tsx|js|jsx|go|rs|rb|java|sql|ya?ml|toml|json|md|sh)\b') AS detail FROM w
 UNION ALL SELECT id, 'names-a-commit-or-ticket', regexp_extract(body, '\b(?:commit\s+)?[0-9a-f]{{7,40}}\b|\bPR\s*#?\d+\b|\b[A-Z]{{2,10}}-\d+\b') FROM w
 UNION ALL SELECT id, 'references-slice-numbering', regexp_extract(body, '(?i)\b(?:line|turn)s?\s+\d+') FROM w
 UNION ALL SELECT id, 'git-already-records-this', regexp_extract(summary, '(?i)\b(?:created?|opened?|merged?|pushed?|committed|squash(?:ed)?)\b.{{0,30}}\b(?:PR|pull request|branch|commit)\b') FROM w
 UNION ALL SELECT id, 'attempt-without-evidence', 'outcome=' || outcome FROM w WHERE kind = 'attempt' AND evidence = 'none'
 UNION ALL SELECT id, 'near-duplicate', 'of ' || substr(head, 1, 12) FROM w WHERE key <> '' AND n > 1)"""


@query(f"WITH {FINDINGS_SQL} SELECT record_id, check_name, detail FROM found WHERE detail <> ''")
def lint_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.findings(records(spark, sf_dir)).withColumnRenamed("check", "check_name")


@query(f"WITH {FINDINGS_SQL} SELECT check_name, count(*) AS n FROM found WHERE detail <> '' GROUP BY 1")
def lint_by_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.by_check(quality.findings(records(spark, sf_dir))).withColumnRenamed("check", "check_name")


@query(f"""WITH {FINDINGS_SQL} SELECT (SELECT count(*) FROM records) AS total, (SELECT count(*) FROM records WHERE outcome = 'failed') AS failed_attempts,
 round((SELECT count(*) FROM records WHERE outcome = 'failed') / (SELECT count(*) FROM records)::DOUBLE, 9) AS failed_share,
 (SELECT count(*) FROM records) - (SELECT count(DISTINCT record_id) FROM found WHERE detail <> '') AS clean""")
def lint_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    return quality.report(r, quality.findings(r)).withColumn("failed_share", F.round("failed_share", 9))


@query(f"WITH {RECORDS_SQL} SELECT kind || coalesce('/' || outcome, '') AS label, count(*) AS n FROM records GROUP BY 1")
def lint_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.kinds(records(spark, sf_dir))


@query(f"""WITH {RECORDS_SQL} SELECT count(*) AS records, count(*) FILTER (outcome = 'failed' AND evidence <> 'none') AS dead_ends, count(*) FILTER (source = 'inferred') AS inferred, count(DISTINCT session_id) AS sessions,
 strftime(to_timestamp(min(occurred)) AT TIME ZONE 'UTC', '%Y-%m-%d') AS first_day, strftime(to_timestamp(max(occurred)) AT TIME ZONE 'UTC', '%Y-%m-%d') AS last_day FROM records""")
def status_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.status(records(spark, sf_dir))


@query(f"""WITH {RECORDS_SQL} SELECT id AS record_id, 'file' AS kind, file AS value FROM records UNION ALL SELECT id, 'setting', setting FROM records UNION ALL SELECT id, 'branch', 'main' FROM records""")
def anchor_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.anchor_rows(records(spark, sf_dir))


@query(f"WITH {RECORDS_SQL} SELECT id FROM live")
def live_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.live(records(spark, sf_dir)).select("id")


def _rank_sql(weight: float, source: str) -> str:
    return f"""hits AS ({source}), bounds AS (SELECT max(created) AS hi, min(created) AS lo FROM hits)
 SELECT id, round({weight} + CASE WHEN kind = 'attempt' AND outcome = 'failed' AND evidence <> 'none' THEN 40 ELSE 0 END + CASE WHEN hi > lo THEN (occurred - lo)::DOUBLE / (hi - lo) * 10 ELSE 0 END, 6) AS score, occurred"""


FILE, SETTING, SEARCH = "src3", "fr", "was OR nicht OR pour"


@query(f"WITH {RECORDS_SQL}, {_rank_sql(45.0, f'''SELECT * FROM live WHERE setting = '{SETTING}' ''')} FROM hits, bounds")
def by_anchor_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    return retrieve.by_anchor(r, store.anchor_rows(r), "setting", SETTING).select("id", F.round("score", 6).alias("score"), epoch("occurred_at").alias("occurred"))


@query(f"WITH {RECORDS_SQL}, {_rank_sql(50.0, f'''SELECT * FROM live WHERE file = '{FILE}' ''')} FROM hits, bounds")
def file_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    return retrieve.timeline(r, store.anchor_rows(r), FILE).select("id", F.round("score", 6).alias("score"), epoch("occurred_at").alias("occurred"))


BM25_SQL = r"""toks AS (SELECT 'rec_' || lpad(doc_id::VARCHAR, 10, '0') AS id, list_filter(regexp_split_to_array(lower(strip_accents(text)), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
 tf AS (SELECT id, len(w) AS dl, len(list_filter(w, lambda x: x = 'was')) AS a, len(list_filter(w, lambda x: x = 'nicht')) AS b, len(list_filter(w, lambda x: x = 'pour')) AS c FROM toks),
 st AS (SELECT count(*) AS n, avg(dl) AS av, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db, count(*) FILTER (c > 0) AS dc FROM tf),
 sc AS (SELECT id, a + b + c AS any_tf, greatest(1e-6, ln((n - da + 0.5) / (da + 0.5))) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * dl / av)) + greatest(1e-6, ln((n - db + 0.5) / (db + 0.5))) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * dl / av)) + greatest(1e-6, ln((n - dc + 0.5) / (dc + 0.5))) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * dl / av)) AS s FROM tf, st),
 top AS (SELECT id, s FROM sc WHERE any_tf > 0 ORDER BY s DESC, id LIMIT 50)"""


@query(f"WITH {BM25_SQL} SELECT id, round(s, 6) AS bm25 FROM top")
def keyword_search_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    postings, totals = documents_index(spark, sf_dir)
    return retrieve.bm25_indexed(documents_for_search(spark, sf_dir), postings, totals, SEARCH, 50, ("summary",)).select("id", F.round("bm25", 6).alias("bm25"))


@query(f"WITH {RECORDS_SQL}, {BM25_SQL}, {_rank_sql(5.0, 'SELECT live.*, s FROM live JOIN top USING (id)')}, round(s, 6) AS bm25 FROM hits, bounds")
def search_then_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    postings, totals = documents_index(spark, sf_dir)
    found = retrieve.bm25_indexed(documents_for_search(spark, sf_dir), postings, totals, SEARCH, 50, ("summary",))
    hits = retrieve.ranked_by_text(found, records(spark, sf_dir))
    return hits.select("id", F.round("score", 6).alias("score"), epoch("occurred_at").alias("occurred"), F.round("bm25", 6).alias("bm25"))


@query(f"""WITH {RECORDS_SQL} SELECT 'even' AS repo, id, occurred FROM live WHERE file = '{FILE}' AND substr(id, 14, 1)::INT % 2 = 0 UNION ALL SELECT 'odd', id, occurred FROM live WHERE file = '{FILE}' AND substr(id, 14, 1)::INT % 2 = 1""")
def multi_repo_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One store split in two by parity; records are superseded in the whole, as it was before the split."""
    r = store.live(records(spark, sf_dir))
    a = store.anchor_rows(r)
    parts = []
    for name, rest in (("even", 0), ("odd", 1)):
        mine = r.where(F.substring("id", 14, 1).cast("int") % 2 == rest).withColumn("supersedes", F.lit(None).cast("string"))
        parts.append((name, retrieve.timeline(mine, a, FILE)))
    return retrieve.timeline_across(parts).select("repo", "id", epoch("occurred_at").alias("occurred"))


LINE_SQL = """'- [' || strftime(to_timestamp(occurred) AT TIME ZONE 'UTC', '%Y-%m-%d') || '] ' || kind || coalesce('/' || outcome, '') || ': ' || summary || CASE WHEN length(detail) > 0 THEN chr(10) || '  ' || detail ELSE '' END || chr(10) || '  (settings ' || setting || '; files ' || file || ')'"""


@query(f"""WITH {RECORDS_SQL}, l AS (SELECT id, {LINE_SQL} AS line, (kind = 'attempt' AND outcome = 'failed' AND evidence <> 'none')::INT AS dead, occurred FROM live),
 u AS (SELECT *, sum(length(line) + 1) OVER (ORDER BY dead DESC, occurred DESC, id ROWS UNBOUNDED PRECEDING) + {len(context.OPENING) + len(context.CLOSING)} AS used FROM l) SELECT id, line FROM u WHERE used <= 6000""")
def context_block_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.block_rows(records(spark, sf_dir), "main", None).select("id", "line")


STOP_SQL = ", ".join(f"'{w}'" for w in context.COMMON_WORDS)


@query(f"""WITH p AS (SELECT conv_id, turn, list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9\\-]{{4,}}'), lambda x: lower(x)) AS w FROM conversations WHERE role = 'user'),
 d AS (SELECT conv_id, turn, list_filter(w, lambda x, i: list_position(w, x) = i AND x NOT IN ({STOP_SQL})) AS w FROM p)
 SELECT conv_id, turn, CASE WHEN len(w) >= 2 THEN array_to_string(w[1:12], ' ') ELSE '' END AS words FROM d""")
def prompt_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    return c.select("conv_id", "turn", F.array_join(context.words_in(F.col("text")), " ").alias("words"))


@query(f"""WITH {RECORDS_SQL}, m AS (SELECT s_suppkey AS prompt_id, 'src' || (s_nationkey % 20)::VARCHAR AS f FROM supplier),
 j AS (SELECT m.prompt_id, live.id, (kind = 'attempt' AND outcome = 'failed' AND evidence <> 'none')::INT AS dead, occurred, {LINE_SQL} AS line FROM m JOIN live ON live.file = m.f),
 r AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY dead DESC, occurred DESC, id) AS n FROM j),
 u AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY prompt_id ORDER BY dead DESC, occurred DESC, id ROWS UNBOUNDED PRECEDING) + {len(context.PROMPT_OPENING) + len(context.CLOSING)} AS used FROM r WHERE n <= 3) SELECT prompt_id, id FROM u WHERE used <= 2400""")
def prompt_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier as a prompt that names its nation's file."""
    named = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("prompt_id"), F.concat(F.lit("src"), (F.col("s_nationkey") % 20).cast("string")).alias("value"))
    r = records(spark, sf_dir)
    a = store.anchor_rows(r.select("id", "anchors")).where("kind = 'file'").withColumnRenamed("record_id", "id")
    return context.chosen_for_prompts(named.join(context.first_of(a, r), "value"), r)


PHRASE, NEARBY = '"de la"', "NEAR(der die, 3)"
FOLDED_SQL = r"""f AS (SELECT 'rec_' || lpad(doc_id::VARCHAR, 10, '0') AS id, ' ' || array_to_string(list_filter(regexp_split_to_array(lower(strip_accents(text)), '[^\p{L}\p{N}]+'), lambda x: x <> ''), ' ') || ' ' AS s FROM documents)"""


@query(f"""WITH {FOLDED_SQL} SELECT id FROM f WHERE contains(s, ' de la ') OR regexp_matches(s, ' der ([^ ]+ ){{0,3}}die ') OR regexp_matches(s, ' die ([^ ]+ ){{0,3}}der ')""")
def phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phrase, or two words close together: postings name the records that hold the words, whose texts are then read."""
    postings, totals = documents_index(spark, sf_dir)
    docs = documents_for_search(spark, sf_dir)
    return retrieve.bm25_indexed(docs, postings, totals, f"{PHRASE} OR {NEARBY}", totals[0], ("summary",)).select("id")


@query(f"""WITH c AS (SELECT conv_id, turn, list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9\\-]{{4,}}'), lambda x: lower(x)) AS w FROM conversations WHERE role = 'user'),
 p AS (SELECT conv_id * 1000 + turn AS prompt_id, list_filter(w, lambda x, i: list_position(w, x) = i AND x NOT IN ({STOP_SQL})) AS w FROM c), w AS (SELECT prompt_id, unnest(w[1:12]) AS word FROM p WHERE len(w) >= 2),
 tk AS (SELECT 'rec_' || lpad(doc_id::VARCHAR, 10, '0') AS id, list_filter(regexp_split_to_array(lower(strip_accents(text)), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS t FROM documents),
 st AS (SELECT count(*) AS n, avg(len(t)) AS av FROM tk), po AS (SELECT id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM tk) WHERE term IN (SELECT word FROM w) GROUP BY 1, 2),
 d AS (SELECT term, count(*) AS df FROM po GROUP BY 1),
 s AS (SELECT prompt_id, po.id, sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av))) AS bm25 FROM w JOIN po ON po.term = w.word JOIN d ON d.term = w.word, st GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY round(bm25, 6) DESC, id) AS k FROM s)
 SELECT prompt_id, id, 'text' AS kind FROM r WHERE k <= 6""")
def prompt_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as prompts that name no file: the best records by their words."""
    prompts = table(spark, sf_dir, "conversations").where(F.col("role") == "user").select((F.col("conv_id") * 1000 + F.col("turn")).alias("prompt_id"), F.col("text").alias("prompt"))
    postings, totals = documents_index(spark, sf_dir)
    return context.keyword_matches(prompts, documents_for_search(spark, sf_dir), postings, totals, ("summary",))


@query(r"""WITH toks AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(strip_accents(text)), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS term FROM documents)
 SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM toks GROUP BY 1""")
def corpus_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = store.postings(documents_for_search(spark, sf_dir), ("summary",))
    return p.groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))
