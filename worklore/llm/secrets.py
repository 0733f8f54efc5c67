"""Secret scans over an incremental ledger of blobs.

Every version of a text is a blob, addressed by its SHA-256. The ledger holds, for each blob and rule version that was
scanned, what was found; a scan reads only blobs that the ledger lacks at this rule version, one copy of each, and
findings are joined back to every path that holds the blob.

Edge cases: null text is the empty blob; null ids and repeated rows are kept, one output row for each input row; an
empty table gives an empty result; other columns may have any name; a hot blob is combined before the exchange, and the join back to paths is by a
key that adaptive execution may split.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worklore.llm.common import fresh_name, joined, matches, shared_dir, table

RULE_VERSION = "1"
BASE_KINDS = ("assign", "access", "hex")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind -> (pattern, substring of any match or null)
RULES = {
    "assign": (ASSIGN, None),
    "access": (r"AKIA[A-Z0-9]{12,}+", "AKIA"),
    "hex": (r"(?<![0-9a-f])[0-9a-f]{32,}+", None),
    "pem": (r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", "PRIVATE KEY"),
    "github": (r"(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{36,}+", "_"),
    "slack": (r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}+", "xox"),
    "jwt": (r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", "eyJ"),
}
#: the value of an assignment is of this many characters at least
ASSIGN_VALUE = r"""(?i)^(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8,}$"""
FINDINGS = "array<struct<kind:string,start:bigint,end:bigint,match:string>>"


def findings(text: Column) -> Column:
    """FINDINGS of one text, ordered by start, then by kind as in RULES."""
    parts = []
    for at, (kind, (pattern, part)) in enumerate(RULES.items()):
        found = matches(text, pattern, F.contains(text, F.lit(part)) if part else None)
        if kind == "assign":
            found = F.filter(found, lambda s: s["match"].rlike(ASSIGN_VALUE))
        parts.append(_tagged(found, at, kind))
    return F.transform(F.sort_array(F.concat(*parts)), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match")))


def _tagged(found: Column, at: int, kind: str) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(at).alias("n"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["match"].alias("match")))


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def scan_blobs(versions: DataFrame, ledger: DataFrame | None = None, rule_version: str = RULE_VERSION) -> DataFrame:
    """versions(path, text) -> (blob, rule_version, findings) for the blobs that the ledger lacks at this version."""
    v = versions.select("path", F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", blob_id(F.col("text")))
    unseen = v.groupBy("blob").agg(F.min("path").alias("first_path"))
    if ledger is not None:
        unseen = unseen.join(ledger.where(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")
    one = unseen.select(F.col("blob").alias("b"), "first_path")
    texts = v.join(one, (F.col("blob") == F.col("b")) & F.col("path").eqNullSafe(F.col("first_path")), "left_semi")
    scanned = texts.select("blob", F.lit(rule_version).alias("rule_version"), findings(F.col("text")).alias("findings"))
    return scanned.dropDuplicates(["blob"])  # a path may be listed twice with one text


def update_ledger(versions: DataFrame, ledger_path: str, rule_version: str = RULE_VERSION) -> DataFrame:
    """Scan what is new, append it to the Parquet ledger at ledger_path and return the whole ledger."""
    spark = versions.sparkSession
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(ledger_path)
    there = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)
    scan_blobs(versions, spark.read.parquet(ledger_path) if there else None, rule_version).write.mode("append").parquet(ledger_path)
    return spark.read.parquet(ledger_path)


def new_ledger(spark: SparkSession) -> str:
    """A path for a ledger of this run's own, in the folder that all share."""
    return f"{shared_dir(spark)}/worklore/ledger-{uuid.uuid4().hex[:12]}"


def joined_back(versions: DataFrame, ledger: DataFrame, rule_version: str = RULE_VERSION) -> DataFrame:
    """(path, blob, findings) for every row of versions(path, text) whose blobs the ledger has. The ledger is a table, so a
    hot blob's paths can be split over tasks."""
    hits = ledger.where((F.col("rule_version") == rule_version) & (F.size("findings") > 0)).select("blob", "findings")
    paths = versions.select("path", blob_id(F.col("text")).alias("blob"))
    return paths.join(hits, "blob", "left").select("path", "blob", F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings"))


def find_secrets(versions: DataFrame, ledger_path: str, rule_version: str = RULE_VERSION) -> DataFrame:
    """(path, blob, findings) for every row of versions(path, text): what the ledger at ledger_path lacks is scanned and
    added, and findings come from the ledger."""
    return joined_back(versions, update_ledger(versions, ledger_path, rule_version), rule_version)


def redact_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger_path: str | None = None) -> DataFrame:
    """docs with each finding in the text replaced by its kind in brackets; of overlapping findings the first counts. Texts
    are scanned once per blob, by way of the ledger (one of the run's own where no path is given). Columns of docs pass
    through whatever their names."""
    ledger = update_ledger(docs.select(F.col(id_col).alias("path"), F.col(text_col).alias("text")), ledger_path or new_ledger(docs.sparkSession))
    own, blob, found = (fresh_name(docs.columns, c) for c in ("own_blob", "ledger_blob", "ledger_findings"))
    hits = ledger.where((F.col("rule_version") == RULE_VERSION) & (F.size("findings") > 0)).select(F.col("blob").alias(blob), F.col("findings").alias(found))
    text = F.col(text_col)
    piece = lambda a, b: F.substr(text, (a + 1).cast("int"), (b - a).cast("int"))
    step = lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["out"], piece(acc["at"], s["start"]), F.lit("["), s["kind"], F.lit("]")).alias("out")))
    done = F.aggregate(found, F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], piece(acc["at"], F.length(text))))
    marked = docs.withColumn(own, blob_id(text)).join(hits, F.col(own) == F.col(blob), "left")
    return marked.withColumn(text_col, F.when(F.col(found).isNotNull(), done).otherwise(text)).select(*docs.columns)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents come as two loads, by a hash of their ids, to one ledger: of the second, only blobs that the first didn't
    have are scanned. Findings go back to all documents."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")
    ledger, load = new_ledger(spark), F.coalesce(F.pmod(F.xxhash64("path"), F.lit(2)), F.lit(0))
    for k in (0, 1):
        known = update_ledger(docs.where(load == k), ledger)
    count = lambda k: F.size(F.filter("findings", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("findings", lambda s: s["kind"].isin(*BASE_KINDS))
    return joined_back(docs, known).select(F.col("path").alias("doc_id"), *map(count, BASE_KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"))
