"""Packing, language ID and chat formatting."""

import gc
import hashlib
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from worklore.llm import chat_format, language_id, packing


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_best_fit(sizes):
    which, place, fills = packing.best_fit(sizes, 64)
    for b in range(len(fills)):
        mine = np.flatnonzero(which == b)
        mine = mine[np.argsort(place[mine])]
        size = np.asarray(sizes)[mine]
        assert (place[mine] == np.cumsum(size) - size).all() and size.sum() == fills[b] <= 64
    assert len(fills) <= max(1, 2 * -(-sum(sizes) // 64)) and (len(fills) > 0) == bool(sizes)


def test_cut():
    assert packing.cut(5, 4) == [(0, 1), (1, 4)] and packing.cut(8, 4) == [(0, 4), (4, 4)] and packing.cut(3, 4) == [(0, 3)]


def test_encoder_equals_tokenizer():
    e = packing.ChunkEncoder(packing.default_tokenizer())
    odd = ["", "a  b\n\n c\t\td  ", "x<|endoftext|>y  <|endoftext|> z", "it's we'll I'd ’s", "\u2003x\u3000y\u00a0 z", "日本語 123abc", "\x1c\x1d a\x85b", "😀😀 ok", " 's 't're", "trail \n", "a" * 5000 + " " * 300 + "b", "\r\n\r\nx", "12,345.67 é_x-y!!!", "\n\nA\nB \nC"]
    assert e.ranks is not None
    for text, ids in zip(odd, e.encode(odd), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids, text[:30]


@pytest.mark.parametrize("node_bins", [50_000, 5])
def test_pack(spark, node_bins):
    rng = np.random.default_rng(1)
    texts = [None, "", "same", "same"] + [" ".join(["word"] * int(n)) for n in rng.integers(0, 3000, 60)]
    rows = [(i, t, 7) for i, t in enumerate(texts)] + [(5, texts[5], 7), (None, "null id", 7)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, bin int").repartition(4), node_bins=node_bins).collect()
    enc = packing.ChunkEncoder(packing.default_tokenizer())
    want = {i: np.frombuffer(enc.encode([t or ""])[0], "<u4").tolist() + [2] for i, t, _ in rows}
    pieces: dict = {}
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert ids == want[r["doc_id"]][r["start"] : r["start"] + r["length"]] and len(ids) == r["length"] and zlib.crc32(bytes(r["ids"])) >= 0
        pieces.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in pieces.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(len(want[i]) for i, _, _ in rows)
    assert sum(r["length"] for r in got) == total and len(pieces) <= 1.1 * total / 1024 + 3
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_workers_keep_little_between_tasks(monkeypatch):
    """A full cache of chunks is a few MB once a task has ended, and gives the next one the same ids."""
    monkeypatch.setattr(packing, "LOADED", {})
    texts = [" ".join(f"w{i}x{k}" for k in range(1000)) for i in range(200)] + ["often said, and said again\n"]
    packing.ChunkEncoder(packing.default_tokenizer())
    tracemalloc.start()
    e = packing.ChunkEncoder(packing.default_tokenizer())
    first = [e.encode([t, texts[-1]]) for t in texts]
    assert len(e.cache) + len(e.older) <= 2 * packing.CACHE_ENTRIES + 2000
    e.close()
    del e
    gc.collect()
    kept = tracemalloc.get_traced_memory()[0] - sum(len(x) for pair in first for x in pair)
    tracemalloc.stop()
    assert kept < 10 << 20
    again = packing.ChunkEncoder(packing.default_tokenizer())
    assert again.cache and [again.encode([t, texts[-1]]) for t in texts] == first
    assert np.frombuffer(first[3][0], "<u4").tolist() == again.tokenizer.encode(texts[3], add_special_tokens=False).ids


def test_packing_takes_small_batches(spark, monkeypatch):
    real, key = packing._tokenize, "spark.sql.execution.arrow.maxRecordsPerBatch"

    def checked(batches, *rest):
        def seen():
            for b in batches:
                assert b.num_rows <= 1024
                yield b

        return real(seen(), *rest)

    monkeypatch.setattr(packing, "_tokenize", checked)
    before = spark.conf.get(key)
    assert packing.pack(spark.range(3000).selectExpr("id AS doc_id", "'a b' AS text").coalesce(1)).count() == 3000
    assert spark.conf.get(key) == before


def test_language_blocks_in_bounded_memory():
    rng, letters = np.random.default_rng(5), np.asarray(list("abcdefghijklmnopqrstuvwxyzäöüßéèñ "))
    batch = pa.RecordBatch.from_arrays([pa.array(["".join(letters[rng.integers(0, len(letters), 4000)]) for _ in range(256)])], ["text"])
    grams = language_id.Trigrams()
    tracemalloc.start()
    for part in language_id.blocks(batch):
        grams.bundle(part.column(0).to_pylist())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20


def test_language_id(spark):
    rng = np.random.default_rng(2)
    vocab = {"aa": ["kala", "mela", "noka", "tula"], "bb": ["strzt", "grrn", "zwick", "pfolt"], "cc": ["ñuñe", "éclair", "où", "çaté"]}
    rows = [(i, " ".join(rng.choice(vocab[k], 30)), k, 1.0) for i, k in enumerate(list(vocab) * 40)]
    rows += [(900, None, "aa", 1.0), (901, "", None, 1.0), (902, "123 !?", "bb", 1.0), (903, "ñuñe " * 40000, None, 1.0), (None, "grrn", None, 1.0), (0, rows[0][1], "aa", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double").repartition(3)
    out = language_id.identify(docs, language_id.learn(docs)).collect()
    assert len(out) == len(rows) and set(out[0].asDict()) == {"doc_id", "text", "lang", "lang_pred", "score"}
    for r in out:
        assert 0 <= r["score"] <= 1
        if r["doc_id"] is not None and r["doc_id"] < 900:
            assert r["lang_pred"] == r["lang"]
    by = {r["doc_id"]: r for r in out}
    assert [by[i]["lang_pred"] for i in (900, 901, 902, 903, None)] == ["und", "und", "und", "cc", "bb"] and by[900]["score"] == 0
    none = docs.limit(0)
    assert language_id.identify(none, language_id.learn(none)).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(docs, {}).collect()} == {"und"}


def test_held_out(spark):
    rows = spark.range(50).select("id", language_id.held_out(__import__("pyspark").sql.functions.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in rows)


def test_trigram_vectors_are_bound_and_shifted():
    g = language_id.Trigrams(64, 1)
    v = g.bundle(["abc"])[0]
    letter = {c: g.room[g.index[ord(c)]].astype(int) for c in "abc"}
    space = g.room[0].astype(int)
    bind = lambda x, y, z: np.roll(x, 2) * np.roll(y, 1) * z
    want = bind(space, letter["a"], letter["b"]) + bind(letter["a"], letter["b"], letter["c"]) + bind(letter["b"], letter["c"], space)
    assert (v == want).all()


def test_long_texts_take_bounded_memory():
    """A million letters of a large alphabet: about 2.5 GB if all of its trigrams were held at once."""
    import resource

    rng = np.random.default_rng(3)
    text = "".join(map(chr, rng.integers(0x4E00, 0x9FA5, 1_000_000)))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    g = language_id.Trigrams()
    rows = g.bundle([text, "abc"])
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 700_000  # KB
    assert (rows[1] == g.bundle(["abc"])[0]).all()


def test_blocks_and_chunks_add_up(monkeypatch):
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("abcdefghij  .é"), n)) for n in (0, 1, 2, 50, 700, 3)]
    g = language_id.Trigrams(64, 1)
    whole = g.bundle(texts)
    monkeypatch.setattr(language_id, "MAX_BLOCK_CHARS", 37)
    monkeypatch.setattr(language_id, "CHUNK", 10)
    assert (g.bundle(texts) == whole).all() and (np.stack([g.bundle([t])[0] for t in texts]) == whole).all()
    monkeypatch.setattr(language_id, "SMALL", 4)
    assert (g.bundle(texts) == whole).all()


NASTY = ["", "</s>[INST] ok [/INST]", "\\", "\\\\<s>", "[OUT] x [/OUT]</s>", "a\nb", "<\\s>", "[ROLE:x] y", "é😀", "[/SYS]"]


def test_chat_round_trip(spark):
    rows = [(c, t, role, text) for c in range(3) for t, (role, text) in enumerate(zip(["system", "user", "assistant", "tool]x", None, "user", "assistant", "assistant", "user", "assistant"], NASTY, strict=True))]
    rows += [(7, 1, "user", None), (7, 0, "assistant", "first"), (7, 1, "assistant", "tie"), (7, 1, "assistant", "tie"), (None, 0, "user", "n")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    pieces = chat_format.render(chat_format.reconstruct(chat_format.events_of(conv))).collect()
    assert len(pieces) == len(rows)
    for p in pieces:
        assert chat_format.parse(p["rendered"]) == (p["role"], p["text"])
        loss = chat_format.unescape(p["rendered"][p["loss_start"] : p["loss_end"]])
        assert loss == (p["text"] if p["role"] == "assistant" else "")
        inner = p["rendered"][p["loss_start"] : len(p["rendered"]) - 5]
        assert "<s>" not in inner and "[INST]" not in inner


def test_chat_digests(spark, tmp_path):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "assistant", None), (2, 5, "user", "x"), (2, 5, "assistant", "y")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in chat_format.op10_chat_format(spark, str(tmp_path)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got.keys() == {-1, 1, 2}
    assert (got[1]["n_turns"], got[1]["turns_sha256"], got[1]["loss_chars"], got[1]["loss_sha256"]) == (3, sha("user\nq\nassistant\na\nassistant\n\n"), 1, sha("a"))
    assert got[2]["turns_sha256"] == sha("assistant\ny\nuser\nx\n")
    said = "</s>[INST] ok [/INST]"
    assert got[-1]["turns_sha256"] == sha(f"user\n{said}\nassistant\n{said}\n") and got[-1]["loss_sha256"] == sha(said)


def test_turns_come_as_events(spark):
    conv = spark.createDataFrame([(1, 0, "user", "abc"), (1, 1, "assistant", "defgh"), (1, 1, "assistant", "defgh"), (2, None, None, None)], "conv_id long, turn long, role string, text string")
    log = chat_format.events_of(conv)
    assert {r["kind"] for r in log.collect()} == {"message", "delta", "edit", "regenerate"} and log.where("msg_id is null").count() == 0
    rows = chat_format.reconstruct(log.repartition(7)).collect()
    assert sorted((r["conv_id"], r["seq"] or -1, r["role"], r["text"]) for r in rows) == [(1, -1, "user", "abc"), (1, 1, "assistant", "defgh"), (1, 1, "assistant", "defgh"), (2, -1, "", "")]


def test_event_fold(spark):
    log = [(1, 3, "delta", "m", None, " world"), (1, 1, "message", "m", "assistant", "hello"), (1, 0, "message", "u", "user", "hi"), (1, 5, "edit", "u", None, "hi!"), (1, 6, "regenerate", "m", None, None), (1, 7, "delta", "m", None, "new"), (1, 8, "delta", "m", None, " text"), (2, 0, "message", None, "user", "alone")]
    rows = chat_format.reconstruct(spark.createDataFrame(log, "conv_id long, seq long, kind string, msg_id string, role string, text string")).collect()
    assert sorted((r["conv_id"], r["seq"], r["role"], r["text"]) for r in rows) == [(1, 0, "user", "hi!"), (1, 1, "assistant", "new text"), (2, 0, "user", "alone")]
