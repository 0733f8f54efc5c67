"""The record store: an append-only JSON log, and tables derived from it.

The log is the truth. Anchors are rows of (kind, value), by which they are looked up; postings hold term counts for keyword
search. `worklore.operators.index` keeps both on disk and follows the log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worklore.functions.expressions import let
from worklore.functions.predicates import KINDS, valid_candidate
from worklore.operators.anchors import ANCHORS_DDL

SCHEMA_VERSION = 1
RECORD_DDL = (
    "schema_version int, id string, occurred_at timestamp, created_at timestamp, session_id string, segment struct<start_turn:int,end_turn:int>, "
    f"anchors {ANCHORS_DDL}, kind string, outcome string, summary string, detail string, evidence string, source string, confidence string, extractor string, supersedes string"
)
RECORD_COLUMNS = [c.strip().split(" ")[0] for c in "schema_version,id,occurred_at,created_at,session_id,segment,anchors,kind,outcome,summary,detail,evidence,source,confidence,extractor,supersedes".split(",")]
ANCHOR_ARRAYS = (("file", "files"), ("route", "routes"), ("symbol", "symbols"), ("setting", "settings"), ("commit", "commits"))
ANCHOR_SCALARS = ("issue", "branch")


def record_id(*parts: Column) -> Column:
    """`rec_` and 20 hex digits of what the record is made from, so that a retried task makes the same id."""
    return F.concat(F.lit("rec_"), F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 20))


def append(records: DataFrame, path: str) -> None:
    records.select(*RECORD_COLUMNS).write.mode("append").option("ignoreNullFields", "false").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)


def read_log(spark: SparkSession, path: str | list[str], placed: bool = False) -> DataFrame:
    """The log's valid records; lines that aren't records are left out, and so is a log that isn't there. With `placed`, each
    has its `place` in the log: its file's time and name, and its line."""
    paths = [path] if isinstance(path, str) else path
    there = [p for p in paths if (where := spark._jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)]
    place = "place struct<time:timestamp,file:string,block:long,row:long>"
    if not there:
        return spark.createDataFrame([], RECORD_DDL + (f", {place}" if placed else ""))
    raw = spark.read.schema(RECORD_DDL + ", _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(there)
    if placed:
        raw = raw.withColumn("place", F.struct(F.col("_metadata.file_modification_time").alias("time"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")))
    return raw.where(F.col("_corrupt_record").isNull() & F.col("id").isNotNull() & F.col("occurred_at").isNotNull() & F.col("kind").isin(*KINDS) & F.col("summary").isNotNull()).drop("_corrupt_record")


def count(spark: SparkSession, path: str) -> int:
    """How many records the log holds."""
    return read_log(spark, path).count()


def latest(records: DataFrame) -> DataFrame:
    """One record for each id, the last created."""
    from pyspark.sql import Window

    w = Window.partitionBy("id").orderBy(F.col("created_at").desc(), F.col("summary"))
    return records.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def anchor_rows(records: DataFrame) -> DataFrame:
    """(record_id, kind, value), each once."""
    entry = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))
    lists = [_entries(kind, F.col(f"anchors.{name}")) for kind, name in ANCHOR_ARRAYS]
    single = [F.when(F.length(F.col(f"anchors.{k}")) > 0, F.array(entry(k, F.col(f"anchors.{k}")))).otherwise(F.array().cast("array<struct<kind:string,value:string>>")) for k in ANCHOR_SCALARS]
    return records.select(F.col("id").alias("record_id"), F.explode(F.concat(*lists, *single)).alias("a")).select("record_id", "a.kind", "a.value").where("value is not null").dropDuplicates()


def _entries(kind: str, values: Column) -> Column:
    return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))


# Fixed value: letters with marks and their plain forms, for folding as keyword search does.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďēěęğīıłńňōőřśšťūůűźżž"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccdeeegiilnnoorsstuuuzzz"


def terms(text: Column) -> Column:
    """Lower-case alphanumeric words without accents."""
    folded = F.translate(F.lower(F.coalesce(text, F.lit(""))), MARKED, PLAIN)
    return F.filter(F.split(folded, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def searchable(records: DataFrame) -> DataFrame:
    """(record_id, summary, detail, anchor_text) as keyword search indexes them."""
    a = F.col("anchors")
    anchor_text = F.concat_ws(" ", *(a[n] for _, n in ANCHOR_ARRAYS), *(a[k] for k in ANCHOR_SCALARS))
    return records.select(F.col("id").alias("record_id"), "summary", "detail", anchor_text.alias("anchor_text"))


def postings(docs: DataFrame, fields: tuple[str, ...] = ("summary", "detail", "anchor_text")) -> DataFrame:
    """(record_id, term, tf, dl): counts over all fields, and the record's number of terms. Terms are sorted and counted as
    runs inside each record, so nothing is exchanged."""
    words = F.sort_array(F.concat(*(terms(F.col(f)) for f in fields)))

    def runs(w: Column) -> Column:
        places = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.size(w) - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(places, lambda i: (i == 0) | (F.get(w, i) != F.get(w, i - 1)))
        return let(starts, lambda s: F.transform(s, lambda at, j: F.struct(F.get(w, at).alias("term"), (F.coalesce(F.get(s, j + 1), F.size(w)) - at).cast("long").alias("tf"), F.size(w).alias("dl"))))

    return docs.select("record_id", F.explode(let(words, runs)).alias("p")).select("record_id", "p.term", "p.tf", "p.dl")


def get(records: DataFrame, suffix: str) -> DataFrame:
    """The first record whose id is or ends with the text: in the order of the log if records have their `place` in it
    (`read_log` with placed), else by time of creation."""
    order = ["place"] if "place" in records.columns else ["created_at", "id"]
    return records.where(F.endswith("id", F.lit(suffix))).orderBy(*order).limit(1)


def superseded(records: DataFrame) -> DataFrame:
    return records.where(F.col("supersedes").isNotNull()).select(F.col("supersedes").alias("id")).distinct()


def live(records: DataFrame, include_inferred: bool = False) -> DataFrame:
    """Records that no record supersedes; those that were inferred only if asked for."""
    out = records.join(superseded(records), "id", "left_anti")
    return out if include_inferred else out.where(F.col("source") == "stated")


def candidates_of(response: Column) -> Column:
    """Valid candidates of a classifier's JSON reply, or null if any part of it is invalid."""
    ddl = "struct<kind:string,outcome:string,summary:string,detail:string,evidence:string,source:string,confidence:string>"
    parsed = F.from_json(response, f"struct<records:array<{ddl}>>", {"mode": "PERMISSIVE"})["records"]
    filled = F.transform(parsed, lambda c: F.struct(c["kind"].alias("kind"), c["outcome"].alias("outcome"), c["summary"].alias("summary"), F.coalesce(c["detail"], F.lit("")).alias("detail"), F.coalesce(c["evidence"], F.lit("none")).alias("evidence"), F.coalesce(c["source"], F.lit("stated")).alias("source"), F.coalesce(c["confidence"], F.lit("medium")).alias("confidence")))
    known = F.coalesce(F.json_object_keys(response), F.array().cast("array<string>"))
    extra = F.size(F.array_except(known, F.array(F.lit("records")))) > 0
    good = F.try_parse_json(response).isNotNull() & F.startswith(F.ltrim(response), F.lit("{")) & ~extra & F.coalesce(F.forall(filled, valid_candidate), F.size(known) == 0)
    return F.when(good, F.coalesce(filled, F.array().cast(f"array<{ddl}>")))
