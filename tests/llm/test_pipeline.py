"""The pipeline's stages on a small corpus, against plain Python."""

import random

import numpy as np

from worklore.llm import packing


def test_stages(spark, tmp_path):
    import corpus_pipeline as cp

    rng = random.Random(2)
    word = lambda a: "".join(rng.choice(a) for _ in range(rng.randint(3, 8)))
    prose = lambda n, a="aeioustrn": " ".join(word(a) for _ in range(n))
    item = prose(40)
    base = prose(100).split()
    near = " ".join([*base[:50], "changed", *base[51:]])
    rows = [(i, prose(60), "en") for i in range(30)] + [(100 + i, prose(60, "kzwüchß"), "de") for i in range(30)]
    rows += [(200, " ".join(base), "en"), (201, near, None), (202, " ".join(base), "en"), (203, "12 34 !!", "en"), (204, None, "en"), (205, prose(20) + " " + item + " " + prose(20), "en"), (206, prose(30) + " token=abcdefgh123 " + prose(30), "en")]
    path = str(tmp_path)
    docs = spark.createDataFrame([(i, t, lang, "src", len(t) if t else None) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    out = spark.read.parquet(f"{path}/documents.parquet")
    kept = []
    for name, stage in cp.STAGES:
        result = stage(spark, out, path)
        result.write.parquet(f"{path}/{name}")
        out = spark.read.parquet(f"{path}/{name}")
        kept.append({r["doc_id"] for r in out.select("doc_id").collect()})
        if name != "packing":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    every = {r[0] for r in rows}
    assert kept[0] == every - {203, 204}
    assert kept[1] == kept[0] - {201, 202} and kept[2] == kept[1] - {205} and kept[3] == kept[2] == kept[4]
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{path}/secrets").collect()}
    assert "abcdefgh123" not in text[206] and "[assign]" in text[206]
    enc = packing.ChunkEncoder(packing.default_tokenizer())
    for r in out.collect():
        want = np.frombuffer(enc.encode([text[r["doc_id"]]])[0], "<u4").tolist() + [2]
        assert np.frombuffer(r["ids"], "<u4").tolist() == want[r["start"] : r["start"] + r["length"]]
    assert cp.run(spark, path).count() == out.count()


def test_odd_rows(spark, tmp_path):
    """Nulls, repeated rows, unlike texts under one id, ties, a long text and columns whose names the stages use."""
    import corpus_pipeline as cp

    rng = random.Random(7)
    prose = lambda n: " ".join("".join(rng.choice("aeioustrn") for _ in range(rng.randint(3, 8))) for _ in range(n))
    text, other, long = prose(60), prose(60), prose(30_000)
    near = text + " once more"
    rows = [(1, text, "en"), (1, text, "en"), (1, other, None), (2, near, "en"), (3, text, "xx"), (None, text, "en"), (4, None, "en"), (5, "", None), (6, long, "en"), (7, long + " end", "en"), (8, "?!", None), (9, "token=abcdefgh123 " + prose(40), "en")]
    names = ["score", "lang_pred", "findings", "own_blob", "odd_id", "NTH", "component", "bin", "whole_text"]
    docs = spark.createDataFrame([(*r, "src", None, *([i] * len(names))) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names))
    path = str(tmp_path)
    spark.createDataFrame([(1, "nothing that any of these documents holds at all"), (2, None), (3, "?")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    out = docs
    kept = []
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, out, path)
        assert out.columns == docs.columns
        kept.append(out.collect())
        assert all(r[n] == r["score"] for r in kept[-1] for n in names)
    assert sorted(r["score"] for r in kept[0]) == [0, 1, 2, 3, 4, 5, 8, 9, 11]
    # of the group of text: one of rows 0 and 1; the row without an id stays; of the long ones the first
    left = sorted(r["score"] for r in kept[1])
    assert left in ([0, 2, 5, 8, 11], [1, 2, 5, 8, 11])
    assert sorted(r["score"] for r in kept[2]) == left and sorted(r["score"] for r in kept[3]) == left
    secret = next(r for r in kept[3] if r["doc_id"] == 9)
    assert secret["text"].startswith("[assign] ") and secret["n_chars"] == len(secret["text"])
    pieces = cp.STAGES[-1][1](spark, out, path).collect()
    assert {r["doc_id"] for r in pieces} == {1, None, 6, 9} and max(r["length"] for r in pieces) == 1024
    for _, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), path).count() == 0
