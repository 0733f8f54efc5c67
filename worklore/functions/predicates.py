"""Predicates over turns, records and candidates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a failed and a passed verification look like in a tool's output.
FAILURE = r"(?Udm)^\s*FAILED\b|\b\d+ failed\b|Traceback \(most recent call last\)|^\s*E\s+\w*Error\b"
SUCCESS = r"(?Udm)\b\d+ passed\b|All checks passed|\bBuild succeeded\b|\b0 errors?\b"
# A record's vocabulary.
KINDS = ("attempt", "decision", "note")
OUTCOMES = ("worked", "failed", "partial")
EVIDENCE = ("test_failure", "error_output", "user_rejected", "agent_abandoned", "none")
SOURCES = ("stated", "inferred")
CONFIDENCE = ("low", "medium", "high")


def shows_failure(results: Column) -> Column:
    return F.coalesce(F.exists(results, lambda r: r["is_error"] | r["text"].rlike(FAILURE)), F.lit(False))


def shows_success(results: Column) -> Column:
    return F.coalesce(F.exists(results, lambda r: r["text"].rlike(SUCCESS)), F.lit(False))


def is_dead_end(kind: Column, outcome: Column, evidence: Column) -> Column:
    return (kind == "attempt") & outcome.eqNullSafe("failed") & (evidence != "none")


def valid_candidate(c: Column) -> Column:
    """An attempt has an outcome and nothing else has; the summary isn't blank; every word is of its vocabulary."""
    outcome = F.when(c["kind"] == "attempt", c["outcome"].isin(*OUTCOMES)).otherwise(c["outcome"].isNull())
    return F.coalesce(
        c["kind"].isin(*KINDS) & outcome & c["summary"].rlike(r"(?U)[^\s\x1c-\x1f]") & c["evidence"].isin(*EVIDENCE) & c["source"].isin(*SOURCES) & c["confidence"].isin(*CONFIDENCE),
        F.lit(False),
    )


def no_anchors(a: Column) -> Column:
    """Branch and commits don't count."""
    empty = lambda x: F.coalesce(F.size(a[x]) == 0, F.lit(True))
    return empty("files") & empty("routes") & empty("symbols") & empty("settings") & a["issue"].isNull()
