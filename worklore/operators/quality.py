"""Quality checks over records, as rows of findings and sums over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from worklore.functions.expressions import first_match

# What records should leave to anchors and to git.
NAMED_PATH = r"(?U)(?:[\w.\-]+/)+[\w.\-]+|\b[\w.\-]+\.(?:py|ts|tsx|js|jsx|go|rs|rb|java|sql|ya?ml|toml|json|md|sh)\b"
NAMED_COMMIT = r"(?U)\b(?:commit\s+)?[0-9a-f]{7,40}\b|\bPR\s*#?\d+\b|\b[A-Z]{2,10}-\d+\b"
SLICE_NUMBER = r"(?Ui)\b(?:line|turn)s?\s+\d+"
IN_GIT = r"(?Ui)\b(?:created?|opened?|merged?|pushed?|committed|squash(?:ed)?)\b.{0,30}\b(?:PR|pull request|branch|commit)\b"
KEY_CHARS, ID_CHARS = 70, 12


def summary_key(summary: Column) -> Column:
    return F.substring(F.regexp_replace(F.lower(summary), "[^a-z ]", ""), 1, KEY_CHARS)


def label(kind: Column, outcome: Column) -> Column:
    return F.when(outcome.isNotNull() & (outcome != ""), F.concat(kind, F.lit("/"), outcome)).otherwise(kind)


def by_key(key: str) -> WindowSpec:
    """Rows with one key together, and each row whose key is empty by itself."""
    return Window.partitionBy(key, F.when(F.col(key) == "", F.col("id")))


def findings(records: DataFrame, order: tuple[str, ...] = ("created_at", "id")) -> DataFrame:
    """(record_id, check, detail). `order` is the log's order: of records with one summary key the first is the original.
    The rows of a key are numbered, so a common key is sorted within its partition and never gathered; rows without a key are
    kept apart."""
    body = F.concat_ws(" ", "summary", F.coalesce("detail", F.lit("")))
    key = summary_key(F.col("summary"))
    w = by_key("_key").orderBy(*order)
    r = records.withColumn("_key", key).withColumn("_first", F.first("id").over(w)).withColumn("_n", F.row_number().over(w))
    one = lambda name, detail: F.struct(F.lit(name).alias("check"), detail.alias("detail"))
    checks = F.array(
        one("names-a-path", first_match(body, NAMED_PATH)),
        one("names-a-commit-or-ticket", first_match(body, NAMED_COMMIT)),
        one("references-slice-numbering", first_match(body, SLICE_NUMBER)),
        one("git-already-records-this", first_match(F.col("summary"), IN_GIT)),
        one("attempt-without-evidence", F.when((F.col("kind") == "attempt") & (F.col("evidence") == "none"), F.concat(F.lit("outcome="), F.coalesce("outcome", F.lit("None"))))),
        one("near-duplicate", F.when((F.col("_key") != "") & (F.col("_n") > 1), F.concat(F.lit("of "), F.substring("_first", 1, ID_CHARS)))),
    )
    return r.select(F.col("id").alias("record_id"), F.explode(F.filter(checks, lambda c: c["detail"].isNotNull())).alias("c")).select("record_id", "c.check", "c.detail")


def kinds(records: DataFrame) -> DataFrame:
    return records.groupBy(label(F.col("kind"), F.col("outcome")).alias("label")).agg(F.count("*").alias("n"))


def by_check(found: DataFrame) -> DataFrame:
    return found.groupBy("check").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "check")


def report(records: DataFrame, found: DataFrame) -> DataFrame:
    """One row: total, failed_attempts (whatever their evidence), share of them, clean."""
    failed = F.count_if((F.col("kind") == "attempt") & (F.col("outcome") == "failed"))
    totals = records.agg(F.count("*").alias("total"), failed.alias("failed_attempts"), F.lit(1).alias("_k"))
    flagged = found.agg(F.countDistinct("record_id").alias("flagged"), F.lit(1).alias("_k"))
    both = totals.join(flagged, "_k")
    return both.select("total", "failed_attempts", F.coalesce(F.try_divide("failed_attempts", "total"), F.lit(0.0)).alias("failed_share"), (F.col("total") - F.col("flagged")).alias("clean"))


def status(records: DataFrame) -> DataFrame:
    """One row: records, dead_ends, inferred, sessions, first and last day."""
    from worklore.functions.predicates import is_dead_end

    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return records.agg(
        F.count("*").alias("records"), F.count_if(is_dead_end(F.col("kind"), F.col("outcome"), F.col("evidence"))).alias("dead_ends"), F.count_if(F.col("source") == "inferred").alias("inferred"),
        F.countDistinct("session_id").alias("sessions"), day(F.min("occurred_at")).alias("first_day"), day(F.max("occurred_at")).alias("last_day"),
    )
