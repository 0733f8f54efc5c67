"""The log, derived tables, lookups, search, checks and context blocks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from worklore.operators import context, quality, retrieve, store
from worklore.operators.index import Index

NONE = {"files": [], "routes": [], "symbols": [], "settings": [], "branch": "main", "issue": None, "commits": [], "head_sha": None}


def record(i, summary, kind="note", outcome=None, evidence="none", source="stated", files=(), settings=(), supersedes=None, detail="", hours=0, issue=None):
    at = dt.datetime(2026, 6, 1) + dt.timedelta(hours=hours or i)
    return (1, f"rec_{i:04d}", at, at, "s", (0, 3), {**NONE, "files": list(files), "settings": list(settings), "issue": issue}, kind, outcome, summary, detail, evidence, source, "high", "x/v1", supersedes)


@pytest.fixture(scope="module")
def records(spark):
    rows = [
        record(1, "worked with fast-mode on", "attempt", "worked", "none", files=["a.py"], settings=["max_size"]),
        record(2, "failed to load big file", "attempt", "failed", "error_output", files=["a.py"], issue="AB-1"),
        record(3, "a note on src/x.py and commit abcdef1", files=["b.py"]),
        record(4, "inferred thing", source="inferred", files=["a.py"]),
        record(5, "newer word", files=["a.py"], supersedes="rec_0001"),
        record(6, "Failed to load BIG file", files=["c.py"], detail="max_size réglé"),
    ]
    return spark.createDataFrame(rows, store.RECORD_DDL).cache()


def test_log_round_trip(spark, records, tmp_path):
    log, index = str(tmp_path / "log"), str(tmp_path / "index")
    assert store.read_log(spark, log).count() == 0
    store.append(records, log)
    (tmp_path / "log" / "zz.json").write_text('{"broken\n{"id":"x"}\n')
    back = store.read_log(spark, log)
    assert back.count() == 6 and back.where("id = 'rec_0002'").first()["anchors"]["issue"] == "AB-1"
    assert store.count(spark, log) == 6
    i = Index(spark, index)
    assert i.ensure_current(log) and not i.ensure_current(log)
    assert i.anchors().where("kind = 'file'").count() == 6
    store.append(records.where("id = 'rec_0001'"), log)
    assert i.ensure_current(log) and i.records().count() == 6 and len(i.meta()) == 2


def test_index_follows_the_log(spark, records, tmp_path):
    """Added records are found, changed ones replace their old rows, and sums are those of a rebuilt index."""
    log, i = str(tmp_path / "log"), Index(spark, str(tmp_path / "index"))
    store.append(records.where("id < 'rec_0004'"), log)
    assert i.ensure_current(log)
    changed = [record(2, "loaded the big file at last", "attempt", "worked", "none", files=["d.py"], hours=50), record(9, "brand new word", files=["a.py"])]
    store.append(records.where("id > 'rec_0003'").unionByName(spark.createDataFrame(changed, store.RECORD_DDL)), log)
    assert i.ensure_current(log) and len(i.meta()) == 2
    plain = Index(spark, str(tmp_path / "plain"))
    plain.rebuild(log)
    assert i.totals() == plain.totals() and i.totals()[0] == 7
    rows = lambda x: sorted(map(str, x.collect()))
    assert rows(i.postings().select("record_id", "term", "tf", "dl")) == rows(plain.postings().select("record_id", "term", "tf", "dl"))
    assert ids(i.timeline("a.py")) == ids(plain.timeline("a.py")) == ["rec_0005", "rec_0009"] and ids(i.by_anchor("file", "d.py")) == ["rec_0002"]
    for q in ("failed OR big", "load*", "summary:big", '"big file"', "word NOT newer", "NEAR(loaded file, 2)", "nothing", '"'):
        want = {r["id"]: round(r["bm25"], 9) for r in retrieve.bm25(store.searchable(plain.records()), q, 50).collect()}
        assert {r["id"]: round(r["bm25"], 9) for r in i.bm25(q, 50).collect()} == want, q
    (tmp_path / "log" / sorted(p.name for p in (tmp_path / "log").glob("part*.json"))[0]).unlink()
    assert i.ensure_current(log) and len(i.meta()) == 1
    plan = i.by_anchor("file", "a.py")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(kind,file)" in plan and "EqualTo(value,a.py)" in plan


def test_near(records):
    docs = store.searchable(records)
    found = lambda q: sorted(ids(retrieve.bm25(docs, q, 50)))
    assert found("NEAR(failed file)") == ["rec_0002", "rec_0006"] and found("NEAR(failed file, 3)") == ["rec_0002", "rec_0006"]
    assert found("NEAR(file failed, 2)") == [] and found('NEAR("to load" file, 1)') == ["rec_0002", "rec_0006"]
    assert found("NEAR(newer word) OR inferred") == ["rec_0004", "rec_0005"] and found("NEAR(failed)") == ["rec_0002", "rec_0006"]
    assert found("NEAR(failed file, x)") == [] and found("NEAR(failed file") == [] and found("near a note") == [] and found("a, b") == []


def test_first_in_the_log_is_shown(spark, tmp_path):
    log = str(tmp_path / "log")
    late, early = record(1, "written first, created last", hours=90), record(1, "created first")
    store.append(spark.createDataFrame([late], store.RECORD_DDL), log)
    store.append(spark.createDataFrame([early], store.RECORD_DDL), log)
    for n, p in enumerate(sorted((tmp_path / "log").glob("part*.json"), key=lambda p: "written first" not in p.read_text())):
        import os

        os.utime(p, (1_700_000_000 + n, 1_700_000_000 + n))
    assert store.get(store.read_log(spark, log, placed=True), "0001").first()["summary"] == "written first, created last"
    assert store.get(store.read_log(spark, log), "0001").first()["summary"] == "created first"


def test_front_door(spark, records, tmp_path):
    from worklore.__main__ import run

    one, two = tmp_path / "one", tmp_path / "two"
    store.append(records, f"{one}/records")
    store.append(spark.createDataFrame([record(7, "elsewhere on the same path", files=["a.py"], settings=["max_size"])], store.RECORD_DDL), f"{two}/records")

    def said(*argv, homes=(f"a={one}", f"b={two}")):
        out: list[str] = []
        code = run(spark, [x for h in homes for x in ("--home", h)] + list(argv), out.append)
        return code, "\n".join(out)

    code, text = said("file", "a.py")
    assert code == 0 and [x.split()[:2] for x in text.split("\n") if x[:2] in ("a ", "b ")] == [["a", "rec_0002"], ["a", "rec_0005"], ["b", "rec_0007"]]
    assert said("setting", "max_size")[1].startswith("b rec_0007") and "rec_0004" in said("file", "a.py", "--inferred")[1]
    assert "rec_0006" in said("search", "big NOT nothing")[1] and said("search", "nowhere")[1] == "nothing found"
    assert said("search", "elsewhere", homes=(str(two),))[1].startswith("rec_0007")
    assert '"summary": "newer word"' in said("show", "0005")[1] and said("show", "none")[0] == 1
    text = said("status")[1]
    assert "records: 6" in text and "dead_ends: 1" in text and "unanchored: 0" in text
    assert "near-duplicate: 1" in said("lint")[1] and said("reindex")[1] == "records: 6"


def ids(df):
    return [r["id"] for r in df.collect()]


def test_anchor_lookup(records):
    a = store.anchor_rows(records)
    assert ids(retrieve.by_anchor(records, a, "file", "a.py")) == ["rec_0002", "rec_0005"]
    assert ids(retrieve.timeline(records, a, "a.py", include_inferred=True)) == ["rec_0002", "rec_0004", "rec_0005"]
    hit = retrieve.by_anchor(records, a, "file", "a.py").first()
    assert hit["score"] == 90.0 and hit["matched"] == ["file"]
    assert ids(store.get(records, "0003")) == ["rec_0003"]
    assert retrieve.with_anchors(records, a).where("id = 'rec_0002'").first()["issue_anchors"] == ["AB-1"]


def test_search(records):
    docs = store.searchable(records)
    found = lambda q, n=50: sorted(ids(retrieve.bm25(docs, q, n)))
    assert found("failed load") == ["rec_0002", "rec_0006"]
    assert found('"fast-mode"') == ["rec_0001"] and found("fast-mode") == [] and found('"') == [] and found("") == []
    assert found("max_size") == ["rec_0001", "rec_0006"] and found("regle") == ["rec_0006"]
    assert found("failed NOT detail:max_size") == ["rec_0002"] and found("inferr* OR newer") == ["rec_0004", "rec_0005"]
    assert found("^failed AND (big OR nothing)") == ["rec_0002", "rec_0006"]
    assert sorted(ids(retrieve.search(records, docs, "failed OR newer OR inferred OR mode"))) == ["rec_0002", "rec_0005", "rec_0006"]


def test_bm25_equals_plain_formula(records):
    import math
    import re

    texts = {r["record_id"]: [w for f in ("summary", "detail", "anchor_text") for w in re.split(r"[\W_]+", (r[f] or "").lower().replace("é", "e")) if w] for r in store.searchable(records).collect()}
    n, avg = len(texts), sum(map(len, texts.values())) / len(texts)
    want = {}
    for i, w in texts.items():
        for t in ("failed", "py"):
            df, tf = sum(t in x for x in texts.values()), w.count(t)
            if tf:
                want[i] = want.get(i, 0) + max(1e-6, math.log((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / avg))
    got = {r["id"]: r["bm25"] for r in retrieve.bm25(store.searchable(records), "failed OR py", 50).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_quality(records):
    found = quality.findings(records)
    got = {(r["record_id"], r["check"]): r["detail"] for r in found.collect()}
    assert got["rec_0003", "names-a-path"] == "src/x.py" and got["rec_0003", "names-a-commit-or-ticket"] == "commit abcdef1"
    assert got["rec_0001", "attempt-without-evidence"] == "outcome=worked" and got["rec_0006", "near-duplicate"] == "of rec_0002"
    r = quality.report(records, found).first()
    assert (r["total"], r["failed_attempts"], r["clean"]) == (6, 1, 3)
    assert quality.status(records).first()["dead_ends"] == 1


def test_context(spark, records):
    rows = context.block_rows(records).orderBy(*context.order()).collect()
    assert [r["id"] for r in rows] == ["rec_0002", "rec_0006", "rec_0005", "rec_0003"]
    assert [r["id"] for r in context.block_rows(records, issue="AB-1").collect()] == ["rec_0002"]
    text = context.block(records)
    assert text.startswith(context.OPENING) and text.endswith(context.CLOSING) and "attempt/failed: failed to load big file" in text
    small = context.block(records, budget=(len(context.OPENING) + len(context.CLOSING) + 90) // 4)
    assert "The budget left out" in small and len(small) < len(text)
    prompts = spark.createDataFrame([(1, "see `a.py` and max_size now"), (2, "anything about words?")], "prompt_id int, prompt string")
    m = context.exact_matches(prompts, store.anchor_rows(records))
    assert {(r["prompt_id"], r["id"]) for r in m.collect()} == {(1, f"rec_000{i}") for i in (1, 2, 4, 5)}
    assert {r["id"] for r in context.for_prompts(m, records).collect()} == {"rec_0002", "rec_0005"}
    words = spark.createDataFrame([("the loader crashed loader again Please",), ("hi there",)], "p string").select(context.words_in(F.col("p")).alias("w")).collect()
    assert [r["w"] for r in words] == [["loader", "crashed"], []] and context.query_for(["a", "b"]) == '"a" OR "b"'


def test_prompts_fall_back_to_keywords(spark, records):
    prompts = spark.createDataFrame([(1, "see `b.py` about loading files"), (2, "the max_size thing crashed"), (3, "inferred stuff about newer words like newer fast-mode"), (4, "see gone.py and failed loader, failed"), (5, "hi")], "prompt_id int, prompt string")
    docs = store.searchable(records)
    postings = store.postings(docs)
    sums = postings.select("record_id", "dl").distinct().agg(F.count("*"), F.avg("dl")).first()
    m = context.match_prompts(prompts, store.anchor_rows(records), docs, postings, (sums[0], sums[1]), store.live(records))
    got: dict = {}
    for r in m.collect():
        got.setdefault((r["prompt_id"], r["kind"]), set()).add(r["id"])
    # the record with prompt 2's setting is superseded, and one word is too few to search by
    assert got == {(1, "file"): {"rec_0003"}, (3, "text"): {"rec_0001", "rec_0004", "rec_0005"}, (4, "text"): {"rec_0002", "rec_0006"}}
    plain = {r["id"] for r in retrieve.bm25(docs, context.query_for(["inferred", "newer", "words", "fast-mode"]), 6).collect()}
    assert got[3, "text"] == plain


def test_prompts_meet_a_values_first_records(spark):
    """A file that many records name: a prompt meets the first few live ones, and its block is that of all of them."""
    rows = [(f"r{i:02}", dt.datetime(2026, 1, 1 + i % 7), "x", "attempt" if i % 5 == 0 else "note", "failed" if i % 5 == 0 else None, "s" * (i % 9), "error_output", "inferred" if i % 4 == 0 else "stated", f"r{i - 1:02}" if i % 6 == 0 else None) for i in range(60)]
    r = spark.createDataFrame(rows, "id string, occurred_at timestamp, detail string, kind string, outcome string, summary string, evidence string, source string, supersedes string")
    r = r.withColumn("anchors", F.struct(F.array(F.concat(F.lit("f"), (F.length("summary") % 2).cast("string"))).alias("files"), *(F.array().cast("array<string>").alias(n) for n in ("routes", "symbols", "settings", "commits")), F.lit("main").alias("branch"), F.lit(None).cast("string").alias("issue")))
    named = spark.range(20).selectExpr("cast(id AS int) AS prompt_id", "explode(array('file')) AS kind", "concat('f', id % 2) AS value").union(spark.createDataFrame([(99, "file", "f0"), (99, "file", "f1")], "prompt_id int, kind string, value string"))
    a = store.anchor_rows(r).withColumnRenamed("record_id", "id")
    few, every = (named.join(t, ["kind", "value"]).select("prompt_id", "id") for t in (context.first_of(a, r), a))
    assert few.count() == 3 * 22 and every.count() == 660
    got = [sorted(map(tuple, f(m, r).select("prompt_id", "id").collect())) for f in (context.chosen_for_prompts, context.for_prompts) for m in (few, every)]
    assert got[0] == got[1] == got[2] == got[3] and len(got[0]) == 63


def test_documents_are_split_once(spark, tmp_path, monkeypatch):
    """Postings of the driver's documents are written in one pass over the texts, each file in order of terms."""
    from worklore.plans import adapters

    spark.createDataFrame([(i, f"w{i % 7} common w{i % 3}é {'x ' * (i % 4)}") for i in range(40)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    seen, plain = spark.sparkContext.accumulator(0), adapters.documents_for_search

    def counting(spark, sf_dir):
        def noted(text):
            seen.add(1)
            return text

        return plain(spark, sf_dir).withColumn("summary", F.udf(noted, "string")("summary"))

    monkeypatch.setattr(adapters, "documents_for_search", counting)
    got, totals = adapters.documents_index(spark, str(tmp_path))
    assert seen.value == 40
    want = store.postings(plain(spark, str(tmp_path)), ("summary",))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and totals[0] == 40
    files: dict = {}
    for r in got.select(F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("n"), "term", "record_id").orderBy("n").collect():
        files.setdefault(r["f"], []).append((r["term"], r["record_id"]))
    assert all(f == sorted(f) for f in files.values())


def test_shown(spark, tmp_path):
    home = str(tmp_path)
    assert context.shown(spark, home).count() == 0
    ddl = "session_id string, id string, n int"
    context.note_shown(spark.createDataFrame([("s", "b", 2), ("s", "a", 1)], ddl), home, 10)
    context.note_shown(spark.createDataFrame([("s", "c", 1), ("s", "a", 2), ("t", "x", 1)], ddl), home, 20)
    assert {r["session_id"]: r["ids"] for r in context.shown(spark, home).collect()} == {"s": ["a", "b", "c"], "t": ["x"]}


def test_remember(spark):
    s = "session_id string, ids array<string>"
    out = context.remember(spark.createDataFrame([("s", ["a", "b"])], s), spark.createDataFrame([("s", ["b", "c"]), ("t", ["x"])], s), keep=2)
    assert {r["session_id"]: r["ids"] for r in out.collect()} == {"s": ["b", "c"], "t": ["x"]}


def test_config(tmp_path):
    from worklore import config

    p = tmp_path / "c.json"
    assert config.load_config(p).segmentation.max_turns == 60
    p.write_text('{"token_budget": 9, "segmentation": {"window": 3}}')
    assert (config.load_config(p).token_budget, config.load_config(p).segmentation.window) == (9, 3)
    for bad in ("[", "[]", '{"nope": 1}', '{"segmentation": 3}'):
        p.write_text(bad)
        with pytest.raises(config.ConfigError):
            config.load_config(p)


def test_topk_equals_all_sums(spark, monkeypatch):
    """Blocks, floors and lists below the floor lose nothing: common and rare words, copies with equal scores, few hits. Only few rows besides the best come out."""
    import random

    from worklore.operators import topk

    rnd = random.Random(5)
    docs = {f"r{i:03}": {w: rnd.choice((0.5, 0.9, 1.7)) for w in range(30) if rnd.random() < (0.8 if w < 6 else 0.1)} for i in range(300)}
    docs |= {f"s{i:03}": docs["r007"] for i in range(200)}
    rows = [(d, w, p) for d, ws in docs.items() for w, p in ws.items()]
    queries = [(q, [(w, 0.01 if w < 6 else 1.0 + w / 7) for w in sorted(rnd.sample(range(33), rnd.randint(1, 8)))]) for q in range(60)]
    reached = {w: (sorted(p for _, v, p in rows if v == w) or [0])[-6:][0] for w in range(33)}
    asked = [(q, max(x * reached[w] for w, x in ws), [w for w, _ in ws], [x for _, x in ws]) for q, ws in queries]
    parts = spark.createDataFrame(rows, "record_id string, no long, part double")
    got: dict = {}
    for r in topk.best(parts, spark.createDataFrame(asked, "query long, floor double, nos array<long>, weights array<double>"), len(docs), 6).collect():
        got.setdefault(r["query"], []).append((-round(r["bm25"], 6), r["id"]))
    for q, ws in queries:
        sums = {d: sum(x * held[w] for w, x in ws if w in held) for d, held in docs.items()}
        assert sorted(got.get(q, []))[:6] == sorted((-round(s, 6), d) for d, s in sums.items() if s > 0)[:6], q
    assert sum(map(len, got.values())) < 60 * 6 * 4 * 3
