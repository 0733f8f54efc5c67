"""The index: tables derived from the log and read with pruning.

Records, anchors and postings come in generations, folders `gen=0`, `gen=1`, …: `rebuild` writes the first anew, `add` puts
one more beside them, and `gone` names the records of earlier generations that a later one holds again. Anchors are sorted by
(kind, value) and postings by term, dealt by ranges that a common value may fill several of, so a lookup's filters reach
Parquet and skip all row groups but a few: what it reads follows its matches, not the log. Meta has a row for each
generation: the log's files that it holds, and its sums for keyword search.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worklore.operators import retrieve, store

META_DDL = "gen int, files string, n long, terms long"


def log_files(spark: SparkSession, path: str) -> dict[str, list]:
    """name -> [size, time] of the log's files."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return {}
    return {f.getPath().getName(): [f.getLen(), f.getModificationTime()] for f in fs.listStatus(where) if f.isFile() and not f.getPath().getName().startswith(("_", "."))}


class Index:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def exists(self) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/meta/_SUCCESS")
        return bool(where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where))

    def meta(self) -> list:
        """A row for each generation."""
        return self.spark.read.schema(META_DDL).json(f"{self.path}/meta").orderBy("gen").collect() if self.exists() else []

    def _table(self, name: str, key: str) -> DataFrame:
        """A table's rows but for those that a later generation replaces. A generation counts once meta has its row."""
        known = len(self.meta())
        rows = self.spark.read.parquet(f"{self.path}/{name}").where(F.col("gen") < known)
        if known > 1:
            gone = self.spark.read.parquet(f"{self.path}/gone").where(F.col("gen") < known).groupBy("id").agg(F.max("gen").alias("until"))
            rows = rows.join(gone, (rows[key] == gone["id"]) & (rows["gen"] < gone["until"]), "left_anti")
        return rows.drop("gen")

    def records(self) -> DataFrame:
        return self._table("records", "id")

    def anchors(self) -> DataFrame:
        return self._table("anchors", "record_id")

    def postings(self) -> DataFrame:
        return self._table("postings", "record_id")

    def totals(self) -> tuple[int, float]:
        """(number of records, their mean number of terms)."""
        rows = self.meta()
        n, terms = sum(r["n"] for r in rows), sum(r["terms"] for r in rows)
        return n, terms / n if n else 0.0

    def _write(self, records: DataFrame, gen: int) -> None:
        records.write.mode("overwrite").parquet(f"{self.path}/records/gen={gen}")
        held = self.spark.read.parquet(f"{self.path}/records/gen={gen}")
        store.anchor_rows(held).repartitionByRange("kind", "value", "record_id").sortWithinPartitions("kind", "value").write.mode("overwrite").parquet(f"{self.path}/anchors/gen={gen}")
        write_postings(store.postings(store.searchable(held)), f"{self.path}/postings/gen={gen}")

    def _sums(self, gen: int) -> tuple[int, int]:
        n = self.spark.read.parquet(f"{self.path}/records/gen={gen}").count()
        return n, self.spark.read.parquet(f"{self.path}/postings/gen={gen}").agg(F.coalesce(F.sum("tf"), F.lit(0))).first()[0]

    def _note(self, mode: str, gen: int, files: dict, n: int, terms: int) -> None:
        self.spark.createDataFrame([(gen, json.dumps(files), n, terms)], META_DDL).coalesce(1).write.mode(mode).json(f"{self.path}/meta")

    def rebuild(self, log_path: str) -> None:
        """Derive everything from the log."""
        files = log_files(self.spark, log_path)
        for name in ("records", "anchors", "postings", "gone", "meta"):
            where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        self._write(store.latest(store.read_log(self.spark, log_path)), 0)
        self._note("overwrite", 0, files, *self._sums(0))

    def add(self, records: DataFrame, files: dict | None = None) -> None:
        """Put records into the index, in place of those that have their ids."""
        gen = len(self.meta())
        self._write(store.latest(records), gen)
        new = self.spark.read.parquet(f"{self.path}/records/gen={gen}").select("id")
        replaced = self.records().join(new, "id", "left_semi").select("id")
        replaced.write.mode("overwrite").parquet(f"{self.path}/gone/gen={gen}")
        gone = self.spark.read.parquet(f"{self.path}/gone/gen={gen}")
        lost = self.postings().join(gone.withColumnRenamed("id", "record_id"), "record_id", "left_semi").agg(F.coalesce(F.sum("tf"), F.lit(0))).first()[0]
        n, terms = self._sums(gen)
        self._note("append", gen, files or {}, n - gone.count(), terms - lost)

    def ensure_current(self, log_path: str) -> bool:
        """Follow the log; True if it has changed. Files that were only added are read alone, else all is derived anew."""
        now, rows = log_files(self.spark, log_path), self.meta()
        known: dict = {}
        for r in rows:
            known |= json.loads(r["files"])
        if rows and known == now:
            return False
        if rows and all(now.get(name) == seen for name, seen in known.items()):
            new = {name: seen for name, seen in now.items() if name not in known}
            self.add(store.read_log(self.spark, [f"{log_path}/{name}" for name in sorted(new)]), new)
        else:
            self.rebuild(log_path)
        return True

    def by_anchor(self, kind: str, value: str, include_inferred: bool = False) -> DataFrame:
        return retrieve.by_anchor(self.records(), self.anchors(), kind, value, include_inferred)

    def timeline(self, path: str, include_inferred: bool = False) -> DataFrame:
        return retrieve.timeline(self.records(), self.anchors(), path, include_inferred)

    def bm25(self, query: str, limit: int) -> DataFrame:
        return retrieve.bm25_indexed(store.searchable(self.records()), self.postings(), self.totals(), query, limit)

    def search(self, query: str, include_inferred: bool = False, limit: int = 50) -> DataFrame:
        """Keyword search: the best `limit` by BM25, of which live ones are ranked."""
        return retrieve.ranked(retrieve.ranked_by_text(self.bm25(query, limit), self.records(), include_inferred))


def write_postings(postings: DataFrame, path: str) -> None:
    """Sorted by term, in ranges; a common term's records may fill several."""
    postings.repartitionByRange("term", "record_id").sortWithinPartitions("term", "record_id").write.mode("overwrite").parquet(path)


def write_segments(postings: DataFrame, path: str) -> None:
    """Each task's postings sorted by term, in a file of its own. Nothing is exchanged, and texts are split once, where ranges
    take a sample of all first. A lookup reads its term's pages in each file, so this suits postings that few lookups read."""
    postings.sortWithinPartitions("term", "record_id").write.mode("overwrite").parquet(path)
