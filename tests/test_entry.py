"""The driver's contract, with and without the corpus operators; the catalog against DuckDB."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

ALONE = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("worklore.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert not [n for n in e.queries() if n.startswith("op") or n == "pipeline"], e.queries()
assert len(e.queries()) > 25 and set(e.oracle_sql()) <= set(e.queries())
"""


def test_the_rest_works_alone():
    done = subprocess.run([sys.executable, "-c", ALONE], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_other_missing_modules_are_errors():
    broken = ALONE.replace('name.startswith("worklore.llm") or name == "corpus_pipeline"', 'name == "worklore.operators.store"')
    done = subprocess.run([sys.executable, "-c", broken], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode != 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")
def test_catalog_equals_duckdb(spark):
    import duckdb

    from worklore.plans import catalog

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    for name, sql in catalog.ORACLE_SQL.items():
        df = catalog.QUERIES[name](spark, DATA)
        want = con.sql(sql)
        columns = sorted(want.columns)
        assert sorted(df.columns) == columns, name
        rows = [tuple(r) for r in con.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()]
        assert sorted(map(repr, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(repr, rows)), name


def test_stream_to_queue(spark, tmp_path):
    from worklore.plans.pipeline import pending
    from worklore.streaming import queue

    ddl = "session_id string, start_turn int, end_turn int, started_at timestamp, files array<string>"
    rows = [("s", 0, 3, None, ["a.py"]), ("s", 4, 9, None, ["b.py"])]
    src, home = str(tmp_path / "in"), str(tmp_path / "home")
    spark.createDataFrame(rows, ddl).write.json(src)
    for again in range(2):  # the second run starts anew and finds everything queued
        q = queue.stage_stream(spark.readStream.schema(ddl).json(src), home, queue.plain_payload, str(tmp_path / f"cp{again}"))
        assert q.awaitTermination(120)
    got = pending(spark, home).collect()
    assert {(r["start_turn"], r["anchors"]["files"][0]) for r in got} == {(0, "a.py"), (4, "b.py")}
