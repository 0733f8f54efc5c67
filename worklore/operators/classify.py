"""Turning work units into candidate records, through a classifier that is given.

A classifier is a function of a list of redacted prompts that returns a JSON reply, or None, for each. It runs in
Arrow batches on the executors; a call that fails, or returns None, is made once more; units without a valid reply are
dropped with a reason, never lost. Only what `redact_column` made is accepted.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklore.functions.redact import Redacted, redact
from worklore.operators.store import candidates_of

Classifier = Callable[[list[str]], list[str | None]]
PROMPT_VERSION = "v1"


def prompt_of(rendered: Column) -> Column:
    return F.concat(F.lit("This is a slice of a session. Say what was tried and how it went.\n\n<slice>\n"), rendered, F.lit("\n</slice>"))


def extractor_id(model: str) -> str:
    """family-major.minor/version of a model's name, without a vendor prefix or a date at its end."""
    parts = model.removeprefix("claude-").split("-")
    if re.fullmatch(r"[0-9]{8}", parts[-1]):
        parts = parts[:-1]
    name = parts[0] + ("-" + ".".join(parts[1:]) if parts[1:] else "")
    return f"{name}/{PROMPT_VERSION}"


def rule_classifier(prompts: list[str]) -> list[str | None]:
    """A classifier without a model: an attempt that failed or worked, by what tools said last."""
    out: list[str | None] = []
    for p in prompts:
        failed = [m.start() for m in re.finditer(r"\[ERROR\]|\b\d+ failed\b|Traceback", p)]
        passed = [m.start() for m in re.finditer(r"\b\d+ passed\b|All checks passed", p)]
        first = next((x.strip() for x in p.splitlines() if x.startswith("  ") and x.strip() and not x.strip().startswith(("->", "<-"))), "")
        if not first or not failed and not passed:
            out.append(json.dumps({"records": []}))
            continue
        bad = bool(failed) and (not passed or failed[-1] > passed[-1])
        record = {"kind": "attempt", "outcome": "failed" if bad else "worked", "summary": first[:200], "evidence": "error_output" if bad else "none", "source": "stated", "confidence": "low"}
        out.append(json.dumps({"records": [record]}))
    return out


def _called(batches: Iterator[pd.DataFrame], classifier: Classifier) -> Iterator[pd.DataFrame]:
    def attempt(prompts: list[str]) -> list[str | None]:
        try:
            return list(classifier(prompts))
        except Exception:  # noqa: BLE001 - one bad call must not end the run
            return [None] * len(prompts)

    for b in batches:
        prompts = b["_prompt"].tolist()
        replies = attempt(prompts)
        again = [i for i, r in enumerate(replies) if r is None]
        for i in again:  # alone, so that one bad prompt doesn't take its batch with it
            replies[i] = attempt([prompts[i]])[0]
        yield b.drop(columns="_prompt").assign(reply=replies)


def classify(units: Redacted, classifier: Classifier, key: str = "hash") -> DataFrame:
    """(key, candidates, dropped, drop_reason) for each unit; summaries and details of candidates are redacted too."""
    if not isinstance(units, Redacted):
        raise TypeError("classify takes what redact_column made")
    rows = units.df.select(key, F.col(units.column).alias("_prompt"))
    schema = f"{key} {units.df.schema[key].dataType.simpleString()}, reply string"
    replies = rows.mapInPandas(lambda b: _called(b, classifier), schema)
    clean = lambda c: F.struct(c["kind"].alias("kind"), c["outcome"].alias("outcome"), redact(c["summary"]).alias("summary"), redact(c["detail"]).alias("detail"), c["evidence"].alias("evidence"), c["source"].alias("source"), c["confidence"].alias("confidence"))
    parsed = replies.withColumn("_c", candidates_of(F.col("reply"))).select(key, F.transform("_c", clean).alias("candidates"))
    judged = parsed.withColumn("dropped", F.col("candidates").isNull()).withColumn("drop_reason", F.when(F.col("candidates").isNull(), "no valid reply after one retry"))
    failed = units.failed.select(key, F.lit(None).cast(judged.schema["candidates"].dataType).alias("candidates"), F.lit(True).alias("dropped"), F.lit("redaction failed").alias("drop_reason"))
    return judged.unionByName(failed)
