"""N-gram Jaccard join: size-aware, heavy and light.

A document's set holds its distinct word shingles. Two sets are linked when den * |A & B| >= num * |A | B|. Equal sets
are one class from the start, named by a 128-bit BLAKE2 digest of their sorted shingles; all further work is on classes.

Light sets (few shingles): a linked pair shares a subset of the size that the larger one's link needs, so each light set
enumerates its subsets of those fixed sizes, and equal subsets meet in a list. Heavy sets: inverted lists on shingles. The
shingles of all sets have one order, in which common ones come last; a linked pair shares one of the first few of both
(`prefix`), so a set enters the lists of these alone, with its size and the shingle's place. Lists are scanned: where the
first shingle that two sets share stands bounds how many more they can share (`may_link`). Which shingles are common comes
from counts that every task sums up in bounded room (`Frequent`); any order gives the same links, a good one short lists.
The boundary between light and heavy is the one of least cost for the sizes and the recurrence of shingles that the first
pass counts (`choose_limit`); sets within a link's reach of it enter both ways.

Only components are asked for. First each member of a list is paired with one leader, the member that holds the shingle
earliest and may be linked; then, in the lists that still have members of several components, members of different ones.
So groups of copies give rows in proportion to their members. Pairs are tested by sketches (`parities`), which never
refuse a link, and then on whole texts. Lists of more than LONG members get their leader by aggregation, and are scanned in
pairs of blocks of BLOCK members, by as many tasks.

Edge cases: null or empty text has an empty set, linked with nothing; rows with null id keep their set's size, have a null
component and link nothing; repeated rows give one output row each, and an id may come with several texts; other columns
are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from worklore.llm import blobs
from worklore.llm.blobs import COUNTED, ROOM, mix, new_groups
from worklore.llm.common import drop_written, fanout, fresh_name, held_small, let_go, table, written

SHINGLE, NUM, DEN = 4, 85, 100
MULTIPLIERS = mix(np.arange(11, 27, dtype=np.uint64)) | np.uint64(1)
CACHED_WORDS, CACHED_BYTES = 100_000, 48
#: of the shingles that tasks report as frequent, so many are used at most, and those of this count at least
COMMON, LEAST_COUNT = 1 << 18, 16
#: largest size that can be light; what testing a candidate costs, in list entries
LIGHT_MOST, TEST_COST = 24, 40
LONG, BLOCK = 1024, 2048
#: rows of a batch of texts, which an executor holds in several copies for each task, and bytes of text taken at a time
BATCH_ROWS, TEXT_BYTES = 1024, 1 << 20
SALT = 256


class Frequent(blobs.Frequent):
    """Counts of shingles, in this module's room."""

    def __init__(self):
        super().__init__(COUNTED, ROOM)


class Words(dict):
    """64-bit names of words, by BLAKE2. Short ones are kept, a bounded number of them."""

    def __missing__(self, word: bytes) -> int:
        name = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= CACHED_BYTES:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = name
        return name


class Shingles:
    """Sets of blocks of texts: a shingle's name mixes its words' names."""

    def __init__(self, k: int):
        self.k, self.words = k, Words()

    def sets(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(names of all texts' distinct shingles, sorted within each text; n+1 bounds of the texts). Bytes' own lower()
        and split() know just A-Z and the six ASCII blanks."""
        k, each = self.k, [t.lower().split() for t in texts]
        n_words = np.asarray([len(w) for w in each], np.int64)
        h = np.fromiter(map(self.words.__getitem__, itertools.chain.from_iterable(each)), np.uint64, int(n_words.sum()))
        doc = np.repeat(np.arange(len(texts)), n_words)
        names, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(h) >= k:
            whole = doc[: len(h) - k + 1] == doc[k - 1 :]
            out = h[: len(h) - k + 1] * MULTIPLIERS[0]
            for i in range(1, k):
                out = out + h[i : len(h) - k + 1 + i] * MULTIPLIERS[i]
            names, owner = mix(out[whole]), doc[: len(h) - k + 1][whole]
        short = np.flatnonzero((n_words > 0) & (n_words < k))
        if len(short):
            at = np.concatenate([[0], np.cumsum(n_words)])
            few = [np.sum(h[at[d] : at[d + 1]] * MULTIPLIERS[: n_words[d]], dtype=np.uint64) + np.uint64(n_words[d]) for d in short]
            names, owner = np.concatenate([names, mix(np.asarray(few, np.uint64))]), np.concatenate([owner, short])
            order = np.argsort(owner, kind="stable")
            names, owner = names[order], owner[order]
        bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
        for a, b in itertools.pairwise(bounds.tolist()):
            names[a:b].sort()
        fresh = new_groups(names, owner)
        names, owner = names[fresh], owner[fresh]
        return names, np.searchsorted(owner, np.arange(len(texts) + 1))

    def of_texts(self, texts: list[bytes]) -> list[np.ndarray]:
        names, bounds = self.sets(texts)
        return np.split(names, bounds[1:-1])


def texts_of(part: pa.RecordBatch) -> list[bytes]:
    return part.column("text").fill_null("").cast(pa.binary()).to_pylist()


def set_names(names: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """128-bit name of each set."""
    view = memoryview(np.ascontiguousarray(names)).cast("B")
    return [blake2b(view[8 * a : 8 * b], digest_size=16).digest() for a, b in itertools.pairwise(bounds.tolist())]


def parities(names: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """A sketch of each set: shingles fall into as many bins as the set has shingles or more (a power of two), and each bin
    keeps whether its number is odd. Sets that differ in k shingles differ in k bins at most. Sketches of twice the bins
    fold in halves."""
    size = np.diff(bounds)
    bins = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(1, size))).astype(np.int64))
    base = np.cumsum(bins) - bins
    at = (mix(names ^ np.uint64(0x5851F42D4C957F2D)) & np.repeat(bins - 1, size).astype(np.uint64)).astype(np.int64) + np.repeat(base, size)
    odd = np.packbits((np.bincount(at, minlength=int(bins.sum())) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [odd[a // 8 : (a + n) // 8] for a, n in zip(base.tolist(), bins.tolist(), strict=True)]


def least_difference(a: bytes, b: bytes) -> int:
    """A number that the sets of two sketches differ in at least."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


@lru_cache(None)
def light_sizes(s: int, num: int, den: int) -> tuple[int, ...]:
    """Sizes of the subsets that a light set of s shingles enumerates. A linked pair shares at least ceil(num/den * b)
    shingles, b being the larger size; both sets enumerate that size, since it depends on b alone."""
    return tuple(sorted({c for b in range(s, s * den // num + 1) if (c := -(-num * b // den)) <= s}))


@lru_cache(None)
def light_cost(s: int, num: int, den: int) -> int:
    return sum(math.comb(s, c) for c in light_sizes(s, num, den))


def prefix(n, num: int, den: int):
    """How many of its first shingles a set of n shingles enters. A linked pair shares num/den * n or more of them, so of
    one more than the others, one is shared; and the first that is shared is among so many of either set."""
    return n + (-num * n) // den + 1


def choose_limit(sizes: dict[int, int], recurring: float, num: int, den: int) -> int:
    """The largest light size, by cost in list entries: a light set has one for each subset, a heavy one for each shingle
    of its prefix, of which the share `recurring` meets a candidate that is to be tested. Sets in a link's reach of the
    limit pay for both."""
    heavy = lambda s: prefix(s, num, den) * (1 + recurring * TEST_COST)
    cost = {}
    for limit in range(LIGHT_MOST + 1):
        reach = -(-num * (limit + 1) // den)
        cost[limit] = sum(k * ((light_cost(s, num, den) if s <= limit else 0) + (heavy(s) if s >= reach else 0)) for s, k in sizes.items() if s <= LIGHT_MOST)
    return min(cost, key=lambda x: (cost[x], x))


def light_signatures(s: np.ndarray, num: int, den: int) -> np.ndarray:
    whole, out = mix(s), []
    total = np.sum(whole, dtype=np.uint64)
    for c in light_sizes(len(s), num, den):
        left = np.asarray([np.sum(whole[list(x)], dtype=np.uint64) for x in itertools.combinations(range(len(s)), len(s) - c)], np.uint64)
        out.append(mix(total - left + np.uint64(c * 0x9E3779B97F4A7C15 % (1 << 64))))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


SETS_DDL = "kind int, doc_id long, tag long, n long, set binary, sketch binary, shingle long, count long"
SETS = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("tag", pa.int64()), ("n", pa.int64()), ("set", pa.binary()), ("sketch", pa.binary()), ("shingle", pa.int64()), ("count", pa.int64())])
DOC, SHARED, RECURRING = range(3)


def _rows(schema: pa.Schema, length: int, /, **columns) -> pa.RecordBatch:
    made = [columns[f.name] if f.name in columns else pa.nulls(length, f.type) for f in schema]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(made, schema, strict=True)], schema=schema)


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """A DOC row for each text, with a sketch at the first of equal sets in a block; at the end the task's counts."""
    maker, often = Shingles(k), Frequent()
    for part in blobs.text_blocks(batches, size=TEXT_BYTES):
        names, bounds = maker.sets(texts_of(part))
        which = set_names(names, bounds)
        first = dict(zip(reversed(which), range(len(which) - 1, -1, -1), strict=True))
        sketch: list = parities(names, bounds)
        for i, name in enumerate(which):
            if first[name] != i:
                sketch[i] = None
        once = np.zeros(len(which), bool)
        once[list(first.values())] = True
        often.add(names[np.repeat(once, np.diff(bounds))])
        yield _rows(SETS, len(which), kind=np.full(len(which), DOC, np.int32), doc_id=part.column("doc_id"), tag=part.column("tag"), n=np.diff(bounds), set=which, sketch=sketch)
    names, counts = often.reported()
    if often.seen:
        yield _rows(SETS, len(names), kind=np.full(len(names), SHARED, np.int32), shingle=names.view(np.int64), count=counts)
        yield _rows(SETS, 1, kind=[RECURRING], n=[often.again], count=[often.seen])


class Order:
    """The order of shingles: those not known as common by name, then the common ones, the rarest first."""

    def __init__(self, names: np.ndarray, counts: np.ndarray):
        order = np.argsort(names)
        self.names, self.counts = names[order], counts[order]
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self.names >> np.uint64(42)] = True

    def common(self, names: np.ndarray) -> np.ndarray:
        """Count of each name, 0 for those that aren't common."""
        out = np.zeros(len(names), np.int64)
        may = np.flatnonzero(self.maybe[names >> np.uint64(42)])
        if len(may):
            at = np.minimum(np.searchsorted(self.names, names[may]), len(self.names) - 1)
            out[may] = np.where(self.names[at] == names[may], self.counts[at], 0)
        return out

    def first(self, names: np.ndarray, bounds: np.ndarray, which: np.ndarray, num: int, den: int) -> tuple[np.ndarray, ...]:
        """(shingle, set, place, count) of the wanted sets' prefixes."""
        size = bounds[which + 1] - bounds[which]
        row = np.repeat(np.arange(len(which)), size)
        x = names[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(bounds[which], size)]
        count = self.common(x)
        rare = count == 0
        n_rare = np.bincount(row[rare], minlength=len(which))
        place = np.zeros(len(x), np.int64)
        place[rare] = np.arange(rare.sum()) - np.repeat(np.cumsum(n_rare) - n_rare, n_rare)
        rest = np.flatnonzero(~rare)
        if len(rest):
            rest = rest[np.lexsort((x[rest], count[rest], row[rest]))]
            n_rest = np.bincount(row[rest], minlength=len(which))
            place[rest] = np.arange(len(rest)) - np.repeat(np.cumsum(n_rest) - n_rest, n_rest) + np.repeat(n_rare, n_rest)
        keep = place < np.repeat(prefix(size, num, den), size)
        return x[keep], which[row[keep]], place[keep], count[keep]


ENTRIES_DDL = "list long, part int, set binary, n int, place int"
ENTRIES = pa.schema([("list", pa.int64()), ("part", pa.int32()), ("set", pa.binary()), ("n", pa.int32()), ("place", pa.int32())])


def _entries(batches: Iterator[pa.RecordBatch], k: int, num: int, den: int, limit: int, common: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """What sets enter in lists, each set once in a block. Lists of shingles known as common go in parts, numbered from 1."""
    maker, order = Shingles(k), Order(*common)
    for part in blobs.text_blocks(batches, size=TEXT_BYTES):
        names, bounds = maker.sets(texts_of(part))
        which, size = set_names(names, bounds), np.diff(bounds)
        once = np.asarray(sorted(dict(zip(reversed(which), range(len(which) - 1, -1, -1), strict=True)).values()), np.int64)
        once = once[size[once] > 0]
        light = once[size[once] <= limit]
        made = [light_signatures(names[bounds[d] : bounds[d + 1]], num, den) for d in light.tolist()]
        x, owner, place, count = order.first(names, bounds, once[size[once] >= -(-num * (limit + 1) // den)], num, den)
        lists = np.concatenate([*made, x])
        owner = np.concatenate([*(np.full(len(m), d, np.int64) for m, d in zip(made, light.tolist(), strict=True)), owner])
        none = np.zeros(len(lists) - len(x), np.int64)
        parts = np.concatenate([none, np.where(count > 0, 1 + mix(owner.astype(np.uint64)[len(none) :]) % (1 + count // LONG).astype(np.uint64), 0).astype(np.int64)])
        for at in range(0, len(lists), 100_000):
            s = slice(at, at + 100_000)
            yield _rows(ENTRIES, len(lists[s]), list=lists[s].view(np.int64), part=parts[s], set=pa.array(which, pa.binary()).take(pa.array(owner[s])), n=size[owner[s]], place=np.concatenate([none, place])[s])


def may_link(n, place, n2, place2, num: int, den: int):
    """Two sets that share a shingle at these places, and none before, share no more than what is left from there."""
    return (num + den) * np.minimum(n - place, n2 - place2) >= num * (n + n2)


MEMBERS_DDL = "list long, set binary, n int, place int, long boolean, leader binary"
MEMBERS = pa.schema([("list", pa.int64()), ("set", pa.binary()), ("n", pa.int32()), ("place", pa.int32()), ("long", pa.bool_()), ("leader", pa.binary())])


def name_words(column: pa.Array) -> np.ndarray:
    """A column of 128-bit names as rows of two numbers."""
    return np.frombuffer(column.buffers()[2], np.uint64)[2 * column.offset :][: 2 * len(column)].reshape(-1, 2)


def with_leaders(t: pa.RecordBatch, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Whole lists, as members with their leaders; members that come again and lists of one drop out."""
    lists, n, place = (t.column(c).to_numpy().astype(np.int64) for c in ("list", "n", "place"))
    names, hot = name_words(t.column("set")), t.column("part").to_numpy() > 0
    order = np.lexsort((names[:, 1], names[:, 0], place / n, lists))
    order = order[new_groups(lists[order], names[order, 0], names[order, 1])]
    starts = np.flatnonzero(new_groups(lists[order]))
    size = np.diff(np.append(starts, len(order)))
    keep = np.repeat((size > 1) | hot[order[starts]], size)
    order, size = order[keep], size[(size > 1) | hot[order[starts]]]
    if not len(order):
        return
    lists, n, place, hot = lists[order], n[order], place[order], hot[order]
    hot |= np.repeat(size > LONG, size)
    leader = np.full(len(order), -1, np.int64)
    starts = np.cumsum(size) - size
    two = starts[(size == 2) & ~hot[starts]]
    ok = may_link(n[two], place[two], n[two + 1], place[two + 1], num, den)
    leader[two[ok] + 1] = two[ok]
    for a, m in zip(starts.tolist(), size.tolist(), strict=True):
        if m > 2 and not hot[a]:
            leads = [a]
            for i in range(a + 1, a + m):
                fit = np.flatnonzero(may_link(n[leads], place[leads], n[i], place[i], num, den))
                if len(fit):
                    leader[i] = leads[fit[0]]
                else:
                    leads.append(i)
    every = t.column("set")
    by = every.take(pa.array(order[leader], mask=leader < 0))
    yield _rows(MEMBERS, len(order), list=lists, set=every.take(pa.array(order)), n=n, place=place, long=hot, leader=by)


def _scan(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Lists come sorted by (list, part); a list beyond LONG members goes on as it comes, as a long one."""
    held: list[pa.RecordBatch] = []
    rows, running = 0, None

    def plain(t: pa.RecordBatch) -> pa.RecordBatch:
        return _rows(MEMBERS, len(t), list=t.column("list"), set=t.column("set"), n=t.column("n"), place=t.column("place"), long=np.ones(len(t), bool))

    def flush(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, rows, running
        t = pa.concat_batches(held) if len(held) > 1 else held[0]
        lists = t.column("list").to_numpy()
        if running is not None:  # the rest of a list that has begun to go out
            n = int(np.searchsorted(lists != running, True))
            if n:
                yield plain(t.slice(0, n))
                t, lists = t.slice(n), lists[n:]
        if not len(lists):
            held, rows = [], 0
            return
        running = None
        end = len(lists) if last else int(np.flatnonzero(lists != lists[-1])[-1]) + 1 if (lists != lists[-1]).any() else 0
        if end:
            yield from with_leaders(t.slice(0, end), num, den)
        t = t.slice(end)
        if len(t) > 8 * LONG:
            running = int(lists[-1])
            yield plain(t)
            t = t.slice(len(t))
        held, rows = ([t], len(t)) if len(t) else ([], 0)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 40_000:
                yield from flush(False)
    if rows:
        yield from flush(True)


def _across(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Pairs of members of different components that may be linked, from groups (list, x, y) that come sorted: blocks x
    and y of a list, against each other or within."""
    known: set[tuple[bytes, bytes]] = set()  # pairs repeat from list to list; bounded, the rest is left to distinct()
    at, rows, out = None, [], []

    def pairs() -> Iterator[tuple[bytes, bytes]]:
        if len(rows) < 2:
            return
        names, block, n, place, comps = zip(*rows, strict=True)
        ids = {c: i for i, c in enumerate(dict.fromkeys(comps))}
        block, n, place, comp = np.asarray(block), np.asarray(n, np.int64), np.asarray(place, np.int64), np.asarray([ids[c] for c in comps])
        for i in range(1, len(rows)):
            fit = (comp[:i] != comp[i]) & may_link(n[:i], place[:i], n[i], place[i], num, den)
            if at[1] != at[2]:
                fit &= block[:i] != block[i]
            for j in np.flatnonzero(fit).tolist():
                if names[i] != names[j]:
                    yield min(names[i], names[j]), max(names[i], names[j])

    def made() -> Iterator[pa.RecordBatch]:
        for pair in pairs():
            if pair not in known:
                known.add(pair)
                out.append(pair)
                if len(known) > 200_000:
                    known.clear()
                if len(out) >= 20_000:
                    yield taken()

    def taken() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out, strict=True)], ["a", "b"])
        out.clear()
        return batch

    for batch in batches:
        for list_, x, y, *row in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
            if at != (list_, x, y):
                yield from made()
                at, rows = (list_, x, y), []
            rows.append(row)
    yield from made()
    if out:
        yield taken()


PAIRS_DDL = "a binary, b binary"


def leader_pairs(members: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct (a, b): members with their leaders. A long list's leader is its member that holds the shingle earliest."""
    long = members.where("long")
    top = long.groupBy("list").agg(F.min(F.struct((F.col("place") / F.col("n")).alias("r"), "set", "n", "place")).alias("l"))
    met = long.join(top, "list").where(F.col("set") != F.col("l.set")).where(may_link_sql("n", "place", "l.n", "l.place", num, den))
    own = members.where("leader is not null").select(F.col("leader").alias("a"), F.col("set").alias("b"))
    return own.unionByName(met.select(F.col("l.set").alias("a"), F.col("set").alias("b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def may_link_sql(n: str, place: str, n2: str, place2: str, num: int, den: int) -> Column:
    n, place, n2, place2 = (F.col(c).cast("long") for c in (n, place, n2, place2))
    return (num + den) * F.least(n - place, n2 - place2) >= num * (n + n2)


def across_pairs(members: DataFrame, labels: DataFrame, num: int, den: int, partitions: int) -> DataFrame:
    """Distinct (a, b) of different components, from the lists that have members of several."""
    placed = members.select("list", "set", "n", "place").join(labels.select(F.col("node").alias("set"), "comp"), "set", "left").withColumn("comp", F.coalesce("comp", "set"))
    mixed = placed.groupBy("list").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("m")).where("low < high")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    own = placed.join(mixed.select("list", blocks.alias("blocks")), "list").withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks").cast("long")).cast("int"))
    other = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = other.select("list", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "set", "block", "n", "place", "comp")
    dealt = dealt.repartition(partitions, "list", "x", "y").sortWithinPartitions("list", "x", "y")
    return dealt.mapInArrow(lambda b: blobs.freed(_across(b, num, den)), PAIRS_DDL).distinct()


def _close(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches allow a link."""
    for b in batches:
        a, c, n, m, x, y = (b.column(i).to_pylist() for i in ("a", "b", "an", "bn", "x", "y"))
        ok = [(den + num) * least_difference(p, q) <= (den - num) * (i + j) for i, j, p, q in zip(n, m, x, y, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(list(itertools.compress(z, ok)), pa.binary()) for z in (a, c)], ["a", "b"])


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return den * both >= num * (len(a) + len(b) - both)


def _verify(batches: Iterator[pa.RecordBatch], k: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (a, salt), first a's own text, b being null, then texts of sets that it may be linked with."""
    maker, own = Shingles(k), None
    for part in blobs.text_blocks(batches, size=TEXT_BYTES):
        a, b = part.column("a").to_pylist(), part.column("b").to_pylist()
        found = []
        for x, y, names in zip(a, b, maker.of_texts(texts_of(part)), strict=True):
            if y is None:
                own = names
            elif linked(own, names, num, den):
                found.append((x, y))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*found, strict=True)], ["a", "b"])


def verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, k: int, num: int, den: int, partitions: int) -> DataFrame:
    """Those of pairs(a, b) of set names that are linked. Sketches come first; texts are then read for what is left, one for
    each set. A set in many pairs is `a` in them, its text goes once to each of as many salts as its pairs fill."""
    sketch = sets.select("set", "n", "sketch")
    both = pairs.join(sketch.toDF("a", "an", "x"), "a").join(sketch.toDF("b", "bn", "y"), "b")
    close = written(both.mapInArrow(lambda b: blobs.freed(_close(b, num, den)), PAIRS_DDL), "close")
    uses = close.select(F.col("a").alias("set")).unionByName(close.select(F.col("b").alias("set"))).groupBy("set").agg(F.count("*").alias("uses"))
    wanted = written(uses.join(sets.select("set", "rep"), "set").select("set", "uses", "rep.doc_id", "rep.tag"), "wanted")
    # an id may come with several texts, and rows may repeat: the tag tells texts apart, and one row of each set stays
    texts = docs.join(held_small(wanted), ["doc_id", "tag"]).select("set", "uses", "text")
    texts = written(texts.groupBy("set").agg(F.first("uses").alias("uses"), F.first("text").alias("text")), "texts")
    drop_written(wanted)
    salts = (F.floor(F.col("uses") / SALT) + 1).cast("int")
    p = close.join(wanted_uses(texts, "a"), "a").join(wanted_uses(texts, "b"), "b")
    p = p.select(F.when(F.col("ua") < F.col("ub"), F.col("b")).otherwise(F.col("a")).alias("a"), F.when(F.col("ua") < F.col("ub"), F.col("a")).otherwise(F.col("b")).alias("b"), F.greatest("ua", "ub").alias("uses"))
    p = p.withColumn("salt", F.pmod(F.xxhash64("b"), salts.cast("long")).cast("int"))
    heads = texts.join(p.select(F.col("a").alias("set")).distinct(), "set", "left_semi").select(F.col("set").alias("a"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(None).cast("binary").alias("b"), "text")
    rest = p.join(texts.select(F.col("set").alias("b"), "text"), "b").select("a", "salt", "b", "text")
    met = heads.unionByName(rest).repartition(partitions, "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    with blobs.small_batches(docs.sparkSession, BATCH_ROWS):
        links = written(met.mapInArrow(lambda b: blobs.freed(_verify(b, k, num, den)), PAIRS_DDL), "links")
    drop_written(close)
    drop_written(texts)
    let_go(docs.sparkSession)
    return links


def wanted_uses(texts: DataFrame, side: str) -> DataFrame:
    return texts.select(F.col("set").alias(side), F.col("uses").alias(f"u{side}"))


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the least node reachable from each node of edges(a, b), by least neighbours and pointer jumping."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("low", "a").alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        up = labels.select(F.col("node").alias("up_node"), F.col("comp").alias("up"))
        new = written(step.join(up, step["comp"] == up["up_node"], "left").select("node", F.least("comp", "up").alias("comp"), (F.least("comp", "up") < F.col("was")).alias("moved")), "labels")
        drop_written(labels)
        labels = new
        let_go(labels.sparkSession)
        if not new.where("moved").limit(1).count():
            drop_written(both)
            return labels.select("node", "comp")


def tagged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tag, text): tag is a hash that tells apart texts that come under one id."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("tag"), F.col(text_col).alias("text"))


def jaccard_classes(d: DataFrame, shingle: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """d as of `tagged` -> (doc_id, tag, n, set, component, component_id), a row for each of d's. component is a name of
    its own for each group of linked sets, null for empty sets and null ids; component_id is the least id in it."""
    partitions = fanout(d)
    with blobs.small_batches(d.sparkSession, BATCH_ROWS):
        first = written(d.mapInArrow(lambda b: blobs.freed(_sets(b, shingle)), SETS_DDL), "sets")
    rows = first.where(F.col("kind") == DOC).select("doc_id", "tag", "n", "set", "sketch")
    sets = rows.where("n > 0 and doc_id is not null").groupBy("set").agg(F.min(F.struct("doc_id", "tag")).alias("rep"), F.first("n").alias("n"), F.max("sketch").alias("sketch"))
    sets = written(sets, "classes")
    counted = first.where(F.col("kind") == SHARED).groupBy("shingle").agg(F.sum("count").alias("count")).where(F.col("count") >= LEAST_COUNT)
    # COMMON rows at most; leaving others out only makes lists longer
    top = counted.orderBy(F.desc("count"), "shingle").limit(COMMON).toArrow()
    common = (top.column("shingle").to_numpy().view(np.uint64), top.column("count").to_numpy())
    again, seen = first.where(F.col("kind") == RECURRING).agg(F.sum("n"), F.sum("count")).first()
    sizes = {r["n"]: r["count"] for r in sets.where(F.col("n") <= LIGHT_MOST).groupBy("n").count().collect()}
    limit = choose_limit(sizes, (again or 0) / (seen or 1), num, den)
    live = d.where("doc_id is not null")
    entered = live.mapInArrow(lambda b: blobs.freed(_entries(b, shingle, num, den, limit, common)), ENTRIES_DDL)
    dealt = entered.repartition(partitions, "list", "part").sortWithinPartitions("list", "part")
    with blobs.small_batches(d.sparkSession, BATCH_ROWS):
        members = written(dealt.mapInArrow(lambda b: blobs.freed(_scan(b, num, den)), MEMBERS_DDL), "members")
    near = written(leader_pairs(members, num, den), "leaders")
    let_go(d.sparkSession)
    links = verified(near, live, sets, shingle, num, den, partitions)
    labels = components(links)
    more = written(across_pairs(members, labels, num, den, partitions).join(near, ["a", "b"], "left_anti"), "across")
    let_go(d.sparkSession)
    links2 = verified(more, live, sets, shingle, num, den, partitions)
    for used in (members, near, more):
        drop_written(used)
    if links2.limit(1).count():
        labels = components(links.unionByName(links2))
    least = sets.select("set", "rep").join(labels.withColumnRenamed("node", "set"), "set", "left").select("set", "rep", F.coalesce("comp", "set").alias("component"))
    by = least.groupBy("component").agg(F.min("rep.doc_id").alias("component_id"))
    named = least.join(by, "component").select("set", "component", "component_id")
    out = rows.drop("sketch").join(named, "set", "left")
    mine = lambda c, empty: F.when(F.col("doc_id").isNull(), None).when(F.col("n") == 0, empty).otherwise(F.col(c)).alias(c)
    return out.select("doc_id", "tag", "n", "set", mine("component", None), mine("component_id", F.col("doc_id")))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc_id, n_shingles, component_id): component_id is the least id reachable by links."""
    return jaccard_classes(tagged(docs, id_col, text_col), shingle, num, den).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs(doc_id, text, ...) but for near copies: of each group of linked texts the row of least id stays,
    of rows with one id the one of least hash, of equal rows one. Rows without words, or with null id, stay."""
    d = tagged(docs)
    rows = jaccard_classes(d, shingle, num, den).where("component is not null")
    one = rows.groupBy("component").agg(F.min(F.struct("doc_id", "tag")).alias("head"))
    seen = rows.groupBy("component", "doc_id", "tag").agg(F.count("*").alias("times")).join(one, "component")
    stays = F.struct("doc_id", "tag") == F.col("head")
    odd = written(seen.select("doc_id", "tag", stays.alias("stays"), "times").where("not stays or times > 1"), "odd")
    id_, tag, n = (fresh_name(docs.columns, c) for c in ("odd_id", "odd_tag", "nth"))
    own = F.xxhash64(F.coalesce("text", F.lit("")))
    marks = lambda x: held_small(x.select(F.col("doc_id").alias(id_), F.col("tag").alias(tag)))
    same = (F.col("doc_id").cast("long") == F.col(id_)) & (own == F.col(tag))
    single = docs.join(marks(odd), same, "left_anti")
    again = docs.join(marks(odd.where("stays")), same, "left_semi").withColumn(n, F.row_number().over(Window.partitionBy(F.col("doc_id").cast("long"), own).orderBy(F.lit(1))))
    return single.unionByName(again.where(F.col(n) == 1).select(*docs.columns))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
