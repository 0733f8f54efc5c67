"""The front door: python -m worklore [--home NAME=DIR]… file|search|setting|show|status|lint|reindex …

A home holds a repository's log (`records`), its index and its state. With several homes, lookups go over all of them and
each hit names its repository; show, status, lint and reindex are about the first.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worklore.functions.predicates import no_anchors
from worklore.operators import context, quality, retrieve, store
from worklore.operators.index import Index


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="worklore", description="Look up what earlier sessions tried.")
    p.add_argument("--home", action="append", default=[], metavar="NAME=DIR", help="a repository's home; again for each one more")
    commands = p.add_subparsers(dest="command", required=True)
    for name, value, text in (("file", "path", "what happened to a file, oldest first"), ("setting", "key", "all that touched a setting, oldest first"), ("search", "query", "keyword search")):
        c = commands.add_parser(name, help=text)
        c.add_argument(value)
        c.add_argument("--inferred", action="store_true", help="with inferred records")
        c.add_argument("--limit", type=int, default=20)
    commands.add_parser("show", help="one record as stored").add_argument("id")
    for name, text in (("status", "counts"), ("lint", "quality checks"), ("reindex", "derive the index anew")):
        commands.add_parser(name, help=text)
    return p


def homes(values: list[str]) -> list[tuple[str, str]]:
    """(name, folder) of each; a folder without a name is named by its last part."""
    out = []
    for v in values or ["."]:
        name, eq, folder = v.partition("=")
        out.append((name, folder) if eq else (v.rstrip("/").rpartition("/")[2], v))
    return out


def current(spark: SparkSession, home: str) -> Index:
    index = Index(spark, f"{home}/index")
    index.ensure_current(f"{home}/records")
    return index


def lookup(spark: SparkSession, repos: list[tuple[str, str]], args: argparse.Namespace) -> DataFrame:
    """Hits of file, setting or search over all repositories, in the order that each is shown in."""
    indexes = [(name, current(spark, home)) for name, home in repos]
    if args.command == "file":
        return retrieve.timeline_across([(name, i.timeline(args.path, args.inferred)) for name, i in indexes]).limit(args.limit)
    if args.command == "setting":
        return retrieve.by_anchor_across([(name, i.by_anchor("setting", args.key, args.inferred)) for name, i in indexes]).limit(args.limit)
    return retrieve.search_across([(name, i.search(args.query, args.inferred, args.limit)) for name, i in indexes], args.limit)


def status(spark: SparkSession, home: str) -> dict:
    """Counts of the log, and of the records that nothing but their branch anchors."""
    records = current(spark, home).records()
    row = quality.status(records).first().asDict()
    row["unanchored"] = records.where(no_anchors(F.col("anchors"))).count()
    row["kinds"] = {r["label"]: r["n"] for r in quality.kinds(records).orderBy("label").collect()}
    return row


def run(spark: SparkSession, argv: list[str], say: Callable[[str], None] = print) -> int:
    args = parser().parse_args(argv)
    repos = homes(args.home)
    home = repos[0][1]
    if args.command in ("file", "setting", "search"):
        hits = lookup(spark, repos, args).withColumn("line", context.line()).select("repo", "id", "line").collect()
        for r in hits:
            say(" ".join(x for x in (r["repo"], r["id"], r["line"]) if x))
        if not hits:
            say("nothing found")
    elif args.command == "show":
        row = store.get(store.read_log(spark, f"{home}/records", placed=True), args.id).drop("place").select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).first()
        if row is None:
            say(f"there is no record {args.id}")
            return 1
        say(json.dumps(json.loads(row["j"]), indent=2, ensure_ascii=False))
    elif args.command == "status":
        for k, v in status(spark, home).items():
            say(f"{k}: {v}")
    elif args.command == "lint":
        records = current(spark, home).records()
        found = quality.findings(records)
        for r in quality.by_check(found).collect():
            say(f"{r['check']}: {r['n']}")
        for k, v in quality.report(records, found).first().asDict().items():
            say(f"{k}: {v}")
    else:
        Index(spark, f"{home}/index").rebuild(f"{home}/records")
        say(f"records: {store.count(spark, f'{home}/records')}")
    return 0


if __name__ == "__main__":
    session = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    sys.exit(run(session, sys.argv[1:]))
