"""The driver's tables in the shapes that operators take, in Spark and, for oracles, in SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from worklore.operators.anchors import ANCHORS_DDL
from worklore.operators.index import write_segments
from worklore.operators.store import postings
from worklore.sources.tables import dealt, read_table, shared_dir

GAP_MINUTES = 4320  # a gap at which all of the fold's branches are taken on these events


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    t = read_table(spark, sf_dir, name)
    return dealt(t) if name in ("documents", "conversations", "pages") else t


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as turns of a session: views name no file, errors fail, purchases pass."""
    e = table(spark, sf_dir, "events")
    idx = (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("int")
    file = F.concat(F.lit("f"), (F.get_json_object("props", "$.k").cast("int") % 4).cast("string"))
    files = F.when(F.col("event_type") == "view", F.array().cast("array<string>")).otherwise(F.array(file))
    return e.select(F.col("user_id").cast("string").alias("session_id"), idx.alias("idx"), F.col("ts").cast("timestamp").alias("ts"), files.alias("files"), (F.col("event_type") == "error").alias("failed"), (F.col("event_type") == "purchase").alias("passed"))


TURNS_SQL = """turns AS (SELECT user_id::VARCHAR AS session_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS idx, ts,
 CASE WHEN event_type = 'view' THEN []::VARCHAR[] ELSE ['f' || ((json_extract_string(props, '$.k'))::INT % 4)::VARCHAR] END AS files,
 event_type = 'error' AS failed, event_type = 'purchase' AS passed FROM events)"""


def rec(c) -> F.Column:
    return F.concat(F.lit("rec_"), F.lpad(c.cast("string"), 10, "0"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records: labels give the kind, toxic attempts failed, Spanish ones were inferred, and each tenth
    supersedes the one before it. The first 200 characters are the summary, all the rest is the detail."""
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    r = d.join(labels, "doc_id", "left")
    kind = F.when(F.col("quality").isNull(), "note").when(F.col("quality") == 0, "decision").otherwise("attempt")
    attempt, toxic = F.col("kind") == "attempt", F.coalesce(F.col("toxic") == 1, F.lit(False))
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 3600)
    empty = F.array().cast("array<string>")
    a = F.struct(F.array("source").alias("files"), empty.alias("routes"), empty.alias("symbols"), F.array("lang").alias("settings"), F.lit("main").alias("branch"), F.lit(None).cast("string").alias("issue"), empty.alias("commits"), F.lit(None).cast("string").alias("head_sha"))
    return r.withColumn("kind", kind).select(
        rec(F.col("doc_id")).alias("id"), at.alias("occurred_at"), F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 3600 + 86400).alias("created_at"), F.col("source").alias("session_id"), a.cast(ANCHORS_DDL).alias("anchors"),
        "kind", F.when(attempt, F.when(toxic, "failed").otherwise("worked")).alias("outcome"), F.substring("text", 1, 200).alias("summary"), F.substr("text", F.lit(201)).alias("detail"),
        F.when(attempt & toxic, "error_output").otherwise("none").alias("evidence"), F.when(F.col("lang") == "es", "inferred").otherwise("stated").alias("source"),
        F.when((F.col("doc_id") % 10 == 0) & (F.col("doc_id") > 0), rec(F.col("doc_id") - 1)).alias("supersedes"),
    )


RECORDS_SQL = """records AS (SELECT 'rec_' || lpad(d.doc_id::VARCHAR, 10, '0') AS id, 1704067200 + d.doc_id * 3600 AS occurred, 1704067200 + d.doc_id * 3600 + 86400 AS created, d.source AS session_id, d.source AS file, d.lang AS setting,
 CASE WHEN quality IS NULL THEN 'note' WHEN quality = 0 THEN 'decision' ELSE 'attempt' END AS kind,
 CASE WHEN quality = 1 THEN CASE WHEN toxic = 1 THEN 'failed' ELSE 'worked' END END AS outcome, substr(text, 1, 200) AS summary, substr(text, 201) AS detail,
 CASE WHEN quality = 1 AND toxic = 1 THEN 'error_output' ELSE 'none' END AS evidence, CASE WHEN lang = 'es' THEN 'inferred' ELSE 'stated' END AS source,
 CASE WHEN d.doc_id % 10 = 0 AND d.doc_id > 0 THEN 'rec_' || lpad((d.doc_id - 1)::VARCHAR, 10, '0') END AS supersedes
 FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
live AS (SELECT * FROM records WHERE id NOT IN (SELECT supersedes FROM records WHERE supersedes IS NOT NULL) AND source = 'stated')"""


def documents_for_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(rec(F.col("doc_id")).alias("record_id"), F.col("text").alias("summary"))


def documents_index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, tuple[int, float]]:
    """Postings of the documents, and their number and mean length. They are written once for a state of the table, in the
    shared folder, and later queries read them."""
    docs = documents_for_search(spark, sf_dir)
    files = sorted(r[0] for r in read_table(spark, sf_dir, "documents").select(F.concat_ws("|", "_metadata.file_path", F.col("_metadata.file_size").cast("string"), F.col("_metadata.file_modification_time").cast("string"))).distinct().collect())
    path = f"{shared_dir(spark)}/worklore/postings-{hashlib.sha256(repr(files).encode()).hexdigest()[:16]}"
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/totals/_SUCCESS")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        write_segments(postings(docs, ("summary",)), f"{path}/postings")
        sums = spark.read.parquet(f"{path}/postings").agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("terms"))
        sums.withColumn("n", F.lit(docs.count())).write.mode("overwrite").parquet(f"{path}/totals")
    row = spark.read.parquet(f"{path}/totals").first()
    return spark.read.parquet(f"{path}/postings"), (row["n"], row["terms"] / row["n"] if row["n"] else 0.0)
