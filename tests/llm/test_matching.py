"""Jaccard join, repeated substrings, decontamination and the pipeline, against brute force."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions

from worklore.llm import decontaminate, jaccard_join, suffix_dedup

W = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t, k):
    w = W.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return frozenset([tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [tuple(w)] if w else [])


def brute_components(rows, k, num, den):
    sets = {i: shingles(t, k) for i, t in rows}
    up = {i: i for i in sets}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed=1, n=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 6)))
    texts = [None, "", " \n", "One", "one", "a b", "A  b", "a b c d", "a b c d e f g h i j", "a b c d e f g h i j k", "Ä b c d"]
    shared = " ".join(word() for _ in range(60))
    for _ in range(n):
        base = [word() for _ in range(rng.choice([8, 14, 17, 20, 60, 200]))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                at = rng.randrange(len(w))
                w[at : at + rng.choice([0, 1])] = [word()] * rng.choice([0, 1])
            texts.append(" ".join(w))
        if rng.random() < 0.5:
            texts.append(shared + " " + " ".join(word() for _ in range(30)))
    rng.shuffle(texts)
    return list(enumerate(texts, 10))


@pytest.mark.parametrize(("k", "num", "den"), [(4, 85, 100), (5, 80, 100)])
def test_components(spark, k, num, den):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 0) for i, t in rows] + [(rows[0][0], rows[0][1], 0), (None, "a b c d", 0)], "doc_id long, text string, n int").repartition(5)
    got = jaccard_join.jaccard_components(df, shingle=k, num=num, den=den).collect()
    want = brute_components(rows, k, num, den)
    assert len(got) == len(rows) + 2
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]


def linked_pairs(num, den, seed=7):
    rng = np.random.default_rng(seed)
    for size in [*range(1, 40), 60, 100, 333, 900]:
        for _ in range(16):
            pool = np.unique(rng.integers(0, 1 << 63, 3 * size).astype(np.uint64))
            a = rng.choice(pool, size, replace=False)
            drop, add = rng.integers(0, max(1, size // 3) + 1, 2)
            b = np.concatenate([rng.permutation(a)[drop:], rng.choice(np.setdiff1d(pool, a), min(add, len(pool) - size), replace=False)])
            a, b = np.unique(a), np.unique(b)
            if len(b) and not np.array_equal(a, b) and jaccard_join.linked(a, b, num, den):
                yield a, b


@pytest.mark.parametrize("limit", [0, 6, 13, 20])
@pytest.mark.parametrize(("num", "den"), [(85, 100), (80, 100), (70, 100)])
def test_every_linked_pair_meets_in_a_list_and_passes(num, den, limit):
    pairs = 0
    for a, b in linked_pairs(num, den):
        pairs += 1
        x = np.concatenate([a, b])
        bounds = np.asarray([0, len(a), len(x)])
        common = np.unique(x[::3])
        order = jaccard_join.Order(common, 100 + common % np.uint64(7))
        reach = -(-num * (limit + 1) // den)
        heavy = np.asarray([i for i in (0, 1) if bounds[i + 1] - bounds[i] >= reach], np.int64)
        names, owner, place, _ = order.first(x, bounds, heavy, num, den)
        met = False
        for name in np.intersect1d(names[owner == 0], names[owner == 1]):
            p, q = place[(owner == 0) & (names == name)][0], place[(owner == 1) & (names == name)][0]
            met |= bool(jaccard_join.may_link(len(a), p, len(b), q, num, den))
        if max(len(a), len(b)) <= limit:
            met |= bool(np.intersect1d(jaccard_join.light_signatures(a, num, den), jaccard_join.light_signatures(b, num, den)).size)
        assert met, (len(a), len(b))
        difference = len(a) + len(b) - 2 * len(np.intersect1d(a, b))
        assert jaccard_join.least_difference(*jaccard_join.parities(x, bounds)) <= difference <= (den - num) * (len(a) + len(b)) / (den + num)
    assert pairs > 50


def test_classes_take_small_batches(spark, monkeypatch):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for name in ("_sets", "_entries"):

        def checked(batches, *rest, real=getattr(jaccard_join, name)):
            def small():
                for b in batches:
                    assert b.num_rows <= 1024
                    yield b

            return real(small(), *rest)

        monkeypatch.setattr(jaccard_join, name, checked)
    before = spark.conf.get(key)
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('a b c ', id % 7, ' ', id % 5, ' e') AS text").coalesce(1)
    kept = jaccard_join.one_of_each(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(35))
    assert spark.conf.get(key) == before


def test_boundary_follows_cost():
    sizes = {s: 10 for s in range(1, 25)}
    limits = [jaccard_join.choose_limit(sizes, r, 85, 100) for r in (0.0, 0.05, 0.2, 1.0)]
    assert limits == sorted(limits) and limits[0] < limits[-1]
    assert jaccard_join.choose_limit({}, 0.5, 85, 100) == 0


def test_counts_of_common_shingles_in_bounded_room(monkeypatch):
    monkeypatch.setattr(jaccard_join, "COUNTED", 500)
    monkeypatch.setattr(jaccard_join, "ROOM", 64)
    rng, often = np.random.default_rng(1), jaccard_join.Frequent()
    for _ in range(60):
        often.add(np.concatenate([np.arange(5, dtype=np.uint64), rng.integers(100, 1 << 60, 95).astype(np.uint64)]))
    names, counts = often.reported()
    assert set(range(5)) <= set(names.tolist()) and len(often.names) <= 64 and counts.max() <= 60


def thue_morse(bits):
    t = "a"
    for _ in range(bits):
        t += t.translate(str.maketrans("ab", "ba"))
    return t


def test_names_of_words_with_structure_differ(spark):
    a = thue_morse(11)
    rows = [(1, a + " x y z"), (2, a.translate(str.maketrans("ab", "ba")) + " x y z"), (3, a + " x y z")]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_long_lists_and_blocks(monkeypatch, spark):
    """Lists beyond LONG members get a leader by aggregation, and are scanned in pairs of blocks."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.choice([1, 1, 2, 3])):
            w[rng.randrange(60)] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    want = brute_components(rows, 4, 85, 100)
    real = jaccard_join._scan

    def shorter(batches, num, den):
        jaccard_join.LONG = 8
        return real(batches, num, den)

    monkeypatch.setattr(jaccard_join, "_scan", shorter)
    monkeypatch.setattr(jaccard_join, "BLOCK", 20)
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_join_query_against_brute_force(spark, tmp_path):
    rows = corpus(seed=5, n=60)
    rows += [(5000, "one text under an id"), (5000, "another text under the same id"), (7, "Very Long " + "word another " * 40000), (8, "very long " + "word another " * 40000)]
    spark.createDataFrame([(i, t, "en", 0) for i, t in rows], "doc_id long, text string, component_id string, n int").write.parquet(f"{tmp_path}/documents.parquet")
    got = jaccard_join.op3_jaccard_join(spark, str(tmp_path)).collect()
    alone = [r for r in rows if r[0] != 5000]
    want = brute_components(alone, 4, 85, 100)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] != 5000} == want
    assert len(got) == len(rows)


def test_one_of_each(spark):
    base = [f"w{i}" for i in range(80)]
    near = " ".join([*base[:40], "changed", *base[41:]])
    text = " ".join(base)
    rows = [(2, text, 0, "a"), (2, "quite another text under the id", 1, "b"), (3, near, 2, "c"), (4, text, 3, "d"), (5, None, 4, "e"), (5, None, 4, "e"), (6, "", 5, "f"), (None, text, 6, "g"), (7, "a b", 7, "h"), (7, "a b", 7, "h"), (8, "A  B", 8, "i")]
    df = spark.createDataFrame(rows, "doc_id long, text string, odd_id int, TAG string")
    got = sorted((r["odd_id"] for r in jaccard_join.one_of_each(df).collect()))
    assert got == [0, 1, 4, 4, 5, 6, 7] and jaccard_join.one_of_each(df).columns == df.columns
    assert jaccard_join.one_of_each(df.limit(0)).count() == 0


def test_one_hot_group(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(300):
        w = list(base)
        w[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(w)))
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {0}


def test_rounds_let_broadcasts_go(spark, monkeypatch):
    """A broadcast table of three rows holds a page of tens of MB until the driver forgets it."""
    memory, called, real = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().memoryManager(), [], jaccard_join.let_go
    held = lambda: memory.storageMemoryUsed() >> 20
    few = spark.range(3).selectExpr("cast(id AS string) AS k")
    assert spark.range(9).selectExpr("cast(id AS string) AS k").join(functions.broadcast(few), "k").count() == 3
    assert held() >= 16
    real(spark)
    until = time.time() + 20
    while held() >= 16 and time.time() < until:
        time.sleep(0.2)
    assert held() < 16
    monkeypatch.setattr(jaccard_join, "let_go", lambda s: called.append(real(s)))
    chain = [(i, " ".join(f"w{j}" for j in range(3 * i, 3 * i + 60))) for i in range(4)]
    got = jaccard_join.jaccard_components(spark.createDataFrame(chain, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {0} and len(called) >= 5


def test_components_of_nothing(spark):
    assert jaccard_join.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_removal(rows, length=50):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        new = []
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            if w in seen:
                gone[k : k + length] = b"\1" * length
            else:
                new.append(w)
        seen.update(new)
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1])), hashlib.sha256(kept).hexdigest())
    return out


def test_repeats(spark):
    rng = random.Random(4)
    prose = lambda n: "".join(rng.choice("abcdefgh éñ") for _ in range(n))
    common, shared = prose(400), [prose(rng.randint(40, 160)) for _ in range(6)]
    texts = [None, "", "x" * 49, "x" * 50, "x" * 50, "x" * 120, "ab" * 200, "ab" * 300, common, common]
    for _ in range(60):
        parts = [prose(rng.randint(0, 150)) for _ in range(rng.randint(1, 4))] + rng.sample(shared, rng.randint(0, 3)) + ([common[rng.randint(0, 300) :]] if rng.random() < 0.4 else [])
        rng.shuffle(parts)
        texts.append("".join(parts))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows] + [(20, texts[20], 1), (None, common, 1)], "doc_id long, text string, kind int").repartition(6)
    want = brute_removal(rows)
    got = suffix_dedup.remove_repeats(df).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        mine = (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest())
        assert mine == (want[r["doc_id"]] if r["doc_id"] is not None else (len(common.encode()), 0, 0, hashlib.sha256(common.encode()).hexdigest()))
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


def test_long_texts_go_in_parts(monkeypatch, spark):
    monkeypatch.setattr(suffix_dedup, "POSITION_BITS", 10)
    rng = random.Random(8)
    a = "".join(rng.choice("abcd") for _ in range(5000))
    rows = [(1, a), (2, a[3000:] + a[:2500]), (3, "z" * 3000), (4, "z" * 70)]
    want = brute_removal(rows)
    for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) == want[r["doc_id"]]


def edit_distance_to_best_place(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return min(row)


def test_edit_place():
    rng = random.Random(6)
    for _ in range(200):
        item = [rng.randrange(4) for _ in range(rng.randint(1, 90))]
        text = [rng.randrange(4) for _ in range(rng.randint(0, 60))] + (item[: rng.randint(0, len(item))] if rng.random() < 0.5 else [])
        assert decontaminate.edit_place(np.asarray(item), np.asarray(text))[0] == edit_distance_to_best_place(item, text)


def leaks(seed=9, n=150, rate=0.02):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8)))
    prose = lambda k: " ".join(word() for _ in range(k))
    items = [(i, prose(rng.randint(16, 60))) for i in range(12)] + [(50, "tiny"), (51, None), (52, "exactly these words"), (53, "")]
    docs = [(i, prose(rng.randint(0, 200))) for i in range(n)] + [(900, None), (901, "")]
    planted = set()
    for i in range(0, n, 3):
        k = rng.randrange(12)
        q = list(items[k][1])
        for _ in range(int(rate * len(q))):
            q[rng.randrange(len(q))] = rng.choice("xyz")
        docs[i] = (i, docs[i][1] + "\n" + "".join(q).upper() + "!\n" + prose(5))
        planted.add((i, k))
    docs.append((902, "so, Exactly these... words"))
    planted.add((902, 52))
    return docs, items, planted


@pytest.mark.parametrize(("rate", "least"), [(0.0, 1.0), (0.02, 0.98), (0.05, 0.9)])
def test_leaks(spark, rate, least):
    docs, items, planted = leaks(rate=rate)
    d = spark.createDataFrame([(i, t, 5) for i, t in docs], "doc_id long, text string, item_id int").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.find_leaks(d, b).collect()
    got = {(r["doc_id"], r["item_id"]) for r in rows}
    assert got <= planted and len(got) >= least * len(planted)
    text = dict(docs)
    for r in rows:
        assert r["similarity"] >= 0.8 and 0 <= r["start"] < r["end"] <= len(text[r["doc_id"]])
    clean = decontaminate.drop_leaky(d, b, block_chars=500)
    assert {r["doc_id"] for r in clean.collect()} == {i for i, _ in docs} - {i for i, _ in got}


def found(items, texts):
    index = decontaminate.ItemIndex(items)
    sym, keep, ends = index.alphabet.codes(texts)
    return {(text, item): edits for text, item, edits, _, _ in index.verify(sym, ends, keep)}


def test_leak_that_lacks_the_items_first_letters():
    for _, item in leaks()[1][:12]:
        hits = found([(3, item)], [item[9:], item[9:]])  # the first text and one with another before it
        assert len(hits) == 2 and hits[0, 0] == hits[1, 0]


@pytest.mark.parametrize("rate", [0.1, 0.15, 0.2])
def test_no_leak_within_the_edits_is_missed(rate):
    rng = random.Random(int(100 * rate))
    prose = lambda n: "".join(rng.choice("etaoinshrdlu") for _ in range(n))
    items = [(i, prose(n)) for i, n in enumerate([20, 24, 39, 40, 60, 80, 90, 99, 100, 150, 300, 399, 400, 401, 900, 2500])]
    texts, planted = [], {}
    for again in range(6):
        for i, item in items:
            q, k = list(item), int(rate * len(item))
            for _ in range(k):
                at, kind = rng.randrange(len(q)), (again + rng.randrange(3)) % 3 if again < 5 else 1
                q[at : at + (kind != 0)] = [] if kind == 1 else ["x"]
            planted[len(texts), i] = k
            texts.append(prose(rng.choice([0, 1, 50, 700])) + "".join(q) + prose(rng.choice([0, 2, 300])))
    got = found(items, texts)
    assert {p for p, k in planted.items() if got.get(p, k + 1) > k} == set()
    alone = [found(items, [t]) for t in texts[:32]]
    assert all({(n, i): e for (_, i), e in one.items()} == {p: e for p, e in got.items() if p[0] == n} for n, one in enumerate(alone))


def test_short_items():
    items = [(0, "4 + 4"), (1, "x"), (2, "Paris!"), (3, "blue whale"), (4, "the speed of light"), (5, "?!")]
    texts = ["so 4, 4.", "44", "144 x", "In paris", "parish comparis", "Par", "is", "a blu whale", "a blue wale", "bl whole", "the sped of lihgt", "teh sped of lihgt", "x", ""]
    got = found(items, texts)
    want = {(0, 0): 0, (1, 0): 0, (2, 1): 0, (3, 2): 0, (7, 3): 1, (8, 3): 1, (10, 4): 3, (12, 1): 0}
    assert got == want


def test_no_benchmark(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    d = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert decontaminate.find_leaks(d, none).count() == 0 and decontaminate.drop_leaky(d, none).count() == 1
    assert decontaminate.find_leaks(d.limit(0), none).count() == 0
