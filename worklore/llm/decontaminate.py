"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact pieces, exact edit verification.

Texts are normalised to lower-case letters and digits. Item windows are taken at every offset, document windows at a
stride, so that a copy of an item holds document windows that line up with an item's whatever its place. The CGK walk
maps a window to a sequence of symbols: at step j it emits the symbol under its pointer, which moves on or stays by a
random bit of (j, symbol); windows at a small edit distance come out at a small Hamming distance. Each table samples some
steps of a walk; equal samples make a candidate. Walks and samples are repeated, MOST_TABLES tables at most, for windows
that differ in `DIFFER` of the steps; this alone misses copies with more edits. So items are also cut into short pieces,
which are counted by diagonals of the document: a place within MAX_EDITS always keeps so many pieces whole (`Pieces`), and
no item is missed. Candidates are verified by exact edit distance of the whole item to its best place in the document.

Window sizes follow the items: items are in classes by length, each with its own window and stride; items too short for
a class are found by their pieces alone, and those of fewer than LEAST letters and digits as exact strings between word
bounds, without edits. Items go in blocks of bounded size, each sent to all executors.

Edge cases: null or empty documents have no hits, items without letters or digits match nothing; null ids pass through;
repeated documents give rows each, repeated items a row for each item id; an empty benchmark gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worklore.llm import blobs
from worklore.llm.blobs import mix, new_groups
from worklore.llm.common import table

MAX_EDITS = 0.2  # of an item's length
#: (least item length, window, stride, steps): an item of that length holds a whole window at some stride
CLASSES = ((80, 48, 32, 72), (40, 24, 16, 36), (20, 12, 8, 18))
LEAST = 8  # shorter items than this are looked up as whole words
SAMPLES, DIFFER, RECALL, MOST_TABLES = 12, 0.08, 0.95, 6
TABLES_PER_WALK = 3
#: (least item length, symbols to a piece, edits a piece may have)
PIECES = ((32, 8, 1), (LEAST, 2, 0))
PART, BANDS, GRAM_BITS, KEY_BITS = 400, 4, 20, 21
RUN = 1 << 14  # places whose keys are made at a time, to stay in a core's cache
BLOCK_CHARS = 4 << 20


def tables_needed(samples: int = SAMPLES, differ: float = DIFFER, recall: float = RECALL) -> int:
    """Tables for which one pair of windows that differ in that share of the steps meets with that chance."""
    hit = (1 - differ) ** samples
    return min(MOST_TABLES, max(1, int(np.ceil(np.log(1 - recall) / np.log(1 - hit)))))


class Alphabet:
    """Symbols of code points: 0 for what is dropped, equal ones for upper and lower case."""

    def __init__(self):
        self.of = np.full(0x110000, -1, np.int32)
        self.n = 1

    def codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbols kept, their positions in the joined text, ends of each text in the kept symbols)."""
        raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(raw):
            for c in np.flatnonzero(np.bincount(raw)).tolist():
                if self.of[c] < 0:
                    low = chr(c).lower()
                    # the symbol of a letter is its code point; a letter whose lower case is longer keeps itself
                    self.of[c] = (ord(low) if len(low) == 1 else c) if chr(c).isalnum() else 0
        sym = self.of[raw]
        keep = np.flatnonzero(sym)
        ends = np.searchsorted(keep, np.cumsum([0] + [len(t) for t in texts]))
        return sym[keep].astype(np.uint32), keep, ends


def sixths(sym: np.ndarray) -> np.ndarray:
    """Six bits of each symbol, mixed."""
    known = np.flatnonzero(np.bincount(sym, minlength=1))
    table = np.zeros(int(known[-1]) + 1 if len(known) else 1, np.uint8)
    table[known] = (mix(known.astype(np.uint64)) >> np.uint64(58)).astype(np.uint8)
    return table[sym]


def walk_keys(sym: np.ndarray, bits: np.ndarray, starts: np.ndarray, window: int, steps: int, walk: int, tables: int) -> list[np.ndarray]:
    """Keys of the windows in `tables` tables of one walk; sym, and its `sixths`, go on for at least `steps` symbols after
    the last window's start."""
    rng = np.random.default_rng((walk, window))
    moves = rng.integers(0, 2, (steps, 64), dtype=np.uint8)  # the bit of (step, symbol), symbols taken mod 64
    picks = [set(rng.choice(steps, SAMPLES, replace=False).tolist()) for _ in range(tables)]
    at, end = starts.copy(), starts + window
    keys = [np.full(len(starts), t + 1, np.uint32) for t in range(tables)]
    for j in range(steps):
        mine = [t for t in range(tables) if j in picks[t]]
        if mine:
            here = (sym[at] + np.uint32(1)) * (at < end)
            for t in mine:
                keys[t] = keys[t] * np.uint32(0x9E3779B1) + here
        at += moves[j][bits[at]]
    for t, k in enumerate(keys):
        k ^= np.uint32(walk * 64 + t)
        k ^= k >> np.uint32(16)
        k *= np.uint32(0x85EBCA6B)
        k ^= k >> np.uint32(13)
    return keys


def edit_place(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(least edit distance of the item to any substring of text, end of the first best one): Myers' bit vectors."""
    m, ones = len(item), (1 << len(item)) - 1
    peq: dict[int, int] = {}
    for i, c in enumerate(item.tolist()):
        peq[c] = peq.get(c, 0) | 1 << i
    pv, mv, score, best, where, top = ones, 0, m, m, 0, 1 << (m - 1)
    for j, c in enumerate(text.tolist()):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & ones), pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & ones, (mh << 1) & ones
        pv, mv = mh | (~(xv | ph) & ones), ph & xv
        if score < best:
            best, where = score, j + 1
    return best, where


def grams(sym: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` symbols."""
    h = np.zeros(max(0, len(sym) - size + 1), np.uint32)
    for k in range(size):
        h = (h + sym[k : k + len(h)]) * np.uint32(0x9E3779B1)
    return h >> np.uint32(32 - GRAM_BITS)


def deletion_keys(sym: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """For each symbol of a run of `size`, a hash of the run without it, at each place of sym. Of two runs at edit distance
    1 at most, one of which begins where the other does, some key is equal."""
    n = max(0, len(sym) - size + 1)
    terms = [sym.astype(np.uint32) * np.uint32(pow(0x9E3779B1, e, 1 << 32)) for e in range(size)]
    head, tails = np.zeros(n, np.uint32), [np.zeros(n, np.uint32)]
    for d in range(size - 1, 0, -1):
        tails.append(tails[-1] + terms[size - 1 - d][d : d + n])
    for d in range(size):
        yield (head + tails[size - 1 - d]) * np.uint32(0x85EBCA6B)
        if d < size - 1:
            head = head + terms[size - 2 - d][d : d + n]


class Pieces:
    """Items cut into pieces of `size` symbols that don't overlap. A place within k edits holds each piece that isn't
    edited, and all of them on k + 1 neighbouring diagonals. Where a piece may have an edit (`loose`), k // 2 pieces at most
    have more; else k at most have one. So the place has all pieces but these, and no place is missed: pieces are counted
    in bins of diagonals, BANDS + 1 of which hold any k + 1 neighbours. Pieces with an edit are found by equal runs that lack
    a symbol. What comes in are parts of items, as (item, offset, symbols): of an item within MAX_EDITS, some part is so
    too."""

    def __init__(self, parts: list[tuple[int, int, np.ndarray]], size: int, loose: int):
        owner, lead, items = zip(*parts, strict=True)
        n = np.asarray([len(x) for x in items])
        many, edits = n // size, (MAX_EDITS * n).astype(np.int64)
        self.items, self.lead, self.size, self.loose, self.reach = np.asarray(owner), np.asarray(lead), size, loose, int((n + edits).max())
        self.least = many - edits // (1 + loose)
        assert (self.least > 0).all() or not loose
        self.width = np.maximum(1, -(-edits // BANDS))
        self.owner = np.repeat(np.arange(len(items)), many)
        self.offset = np.concatenate([np.arange(m) * size for m in many])
        self.edits, self.triples = edits, [grams(x, 3) for x in items]
        names = [np.concatenate([k[::size] for k in one]) for one in zip(*(self.names_of(x) for x in items), strict=True)]
        rows = np.tile(np.arange(len(self.owner)), len(names))
        every = np.concatenate(names)
        order = np.argsort(every, kind="stable")
        self.rows = rows[order].astype(np.int32)
        self.keys, first, count = np.unique(every[order], return_index=True, return_counts=True)
        self.first, self.count = first.astype(np.int32), count.astype(np.int32)
        lead = (self.keys >> np.uint32(32 - KEY_BITS)).astype(np.int64)
        self.maybe = np.zeros(1 << KEY_BITS, bool)
        self.maybe[lead] = True
        of_lead = np.bincount(lead, minlength=1 << KEY_BITS)
        self.most, self.begin = int(of_lead.max()), (np.cumsum(of_lead) - of_lead).astype(np.int32)

    def names_of(self, sym: np.ndarray) -> Iterator[np.ndarray]:
        if self.loose:
            yield from deletion_keys(sym, self.size)
        else:
            yield grams(sym, self.size) << np.uint32(32 - GRAM_BITS)

    def hits(self, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, piece) wherever sym holds a piece, some more than once."""
        places, keys = [], []
        for c in range(0, max(0, len(sym) - self.size + 1), RUN):
            for names in self.names_of(sym[c : c + RUN + self.size - 1]):
                at = np.flatnonzero(self.maybe[names >> np.uint32(32 - KEY_BITS)])
                places.append(at + c)
                keys.append(names[at])
        at, names = np.concatenate([np.zeros(0, np.int64), *places]), np.concatenate([np.zeros(0, np.uint32), *keys])
        key, begin = np.full(len(names), -1, np.int32), self.begin[names >> np.uint32(32 - KEY_BITS)]
        for k in range(self.most):  # keys that begin alike are neighbours
            same = self.keys[np.minimum(begin + k, len(self.keys) - 1)] == names
            key[same] = begin[same] + k
        found = np.flatnonzero(key >= 0)
        at, key = at[found], np.minimum(key[found], len(self.keys) - 1)
        n = self.count[key]
        rows = self.rows[np.repeat(self.first[key] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        return np.repeat(at, n), rows

    def places(self, sym: np.ndarray) -> np.ndarray:
        """Rows (item, least and greatest place of its start) where enough pieces are on neighbouring diagonals. Bins are
        numbered over all items; windows of BANDS + 1 of them begin at bins that hold a piece."""
        if self.loose:  # the last run may lack its last symbol
            sym = np.append(sym, np.uint32(0))
        hit, rows = self.hits(sym)
        bins = (len(sym) + self.reach) // self.width + BANDS + 2
        base = np.cumsum(bins) - bins
        at = (hit + self.reach - self.offset[rows]) // self.width[self.owner[rows]] + base[self.owner[rows]]
        pairs = np.sort(at * len(self.owner) + rows)  # a piece counts once in a bin
        pairs = pairs[new_groups(pairs)]
        at, rows = pairs // len(self.owner), pairs % len(self.owner)
        first = np.flatnonzero(new_groups(at))
        full, least = at[first], self.least[self.owner[rows[first]]]
        enough = np.searchsorted(at, full + BANDS + 1) - first >= least
        full = self.distinct(full[enough], least[enough], at, rows)
        item = np.searchsorted(base, full, "right") - 1
        new = np.flatnonzero((np.diff(full, prepend=-BANDS - 2) > BANDS + 1) | (np.diff(item, prepend=-1) > 0))
        if not len(new):
            return np.zeros((0, 3), np.int64)
        first, last, item = full[new], full[np.append(new[1:], len(full)) - 1], item[new]
        low = (first - base[item]) * self.width[item] - self.reach
        return self.close(np.stack([item, low, np.minimum(len(sym) - 1, low + (last - first + BANDS + 1) * self.width[item] - 1)], 1), sym)

    def close(self, places: np.ndarray, sym: np.ndarray) -> np.ndarray:
        """Those where enough of all the item's runs of three are on these diagonals: an edit spoils three at most."""
        edge = np.zeros(self.reach, np.uint32)
        names = grams(np.concatenate([edge, sym, edge]), 3)
        keep = []
        for r, (item, low, high) in enumerate(places.tolist()):
            mine, k, wide = self.triples[item], int(self.edits[item]), high - low + 1
            if wide < 16 * (k + 1):  # else searching is as cheap
                near = sliding_window_view(names[low + self.reach : low + self.reach + wide + len(mine) - 1], wide)
                if np.count_nonzero((near == mine[:, None]).any(1)) < len(mine) - 3 * k:
                    continue
            keep.append(r)
        part, low, high = places[keep].T
        return np.stack([self.items[part], low - self.lead[part], high - self.lead[part]], 1)

    def distinct(self, full: np.ndarray, least: np.ndarray, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Those of the windows that begin at bins `full` that hold enough pieces when each counts once; at is sorted."""
        low = np.searchsorted(at, full)
        n = np.searchsorted(at, full + BANDS + 1) - low
        every = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        once = np.unique(np.repeat(np.arange(len(full)), n) * len(self.owner) + rows[every])
        return full[np.bincount(once // len(self.owner), minlength=len(full)) >= least]


class ItemIndex:
    """The benchmark block's windows in tables, by class, and its pieces."""

    def __init__(self, items: list[tuple[int, str]]):
        self.alphabet, self.items, self.ids, self.tables, self.exact = Alphabet(), [], [], [], {}
        for item_id, text in items:
            sym, _, _ = self.alphabet.codes([text or ""])
            self.items.append(sym)
            self.ids.append(item_id)
        done: set[int] = set()
        for least, window, stride, steps in CLASSES:
            mine = [i for i, s in enumerate(self.items) if len(s) >= least and i not in done]
            done.update(mine)
            if not mine:
                continue
            sym = np.concatenate([self.items[i] for i in mine])
            base = np.cumsum([0] + [len(self.items[i]) for i in mine])
            starts = np.concatenate([np.arange(base[k], base[k + 1] - window + 1) for k in range(len(mine))])
            owner = np.repeat(np.asarray(mine), [len(self.items[i]) - window + 1 for i in mine])
            offset = starts - np.repeat(base[:-1], [len(self.items[i]) - window + 1 for i in mine])
            n = tables_needed()
            found = []
            sym = np.append(sym, np.zeros(steps, sym.dtype))
            bits = sixths(sym)
            for walk in range(-(-n // TABLES_PER_WALK)):
                width = min(TABLES_PER_WALK, n - walk * TABLES_PER_WALK)
                for keys in walk_keys(sym, bits, starts, window, steps, walk, width):
                    order = np.argsort(keys, kind="stable")
                    found.append((keys[order], owner[order], offset[order]))
            self.tables.append((window, stride, steps, found))
        parts = []
        for i, s in enumerate(self.items):
            cuts = np.linspace(0, len(s), -(-len(s) // PART) + 1).astype(int).tolist()
            parts += [(i, a, s[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        self.pieces, most = [], PART + 1
        for least, size, loose in PIECES:
            mine = [x for x in parts if least <= len(x[2]) < most]
            most = least
            if mine:
                self.pieces.append(Pieces(mine, size, loose))
        for i, s in enumerate(self.items):
            if 0 < len(s) < LEAST:
                self.exact.setdefault(len(s), []).append(i)

    def candidates(self, sym: np.ndarray, ends: np.ndarray, keep: np.ndarray) -> np.ndarray:
        """Rows (text, item, place of the item's start in sym) to verify."""
        out = []
        padded = np.append(sym, np.zeros(max([0, *(t[2] for t in self.tables)]), sym.dtype))
        bits = sixths(padded)
        for window, stride, steps, found in self.tables:
            starts = np.concatenate([np.arange(a, b - window + 1, stride) for a, b in zip(ends[:-1], ends[1:], strict=True)] or [np.zeros(0, np.int64)])
            if not len(starts):
                continue
            texts = np.searchsorted(ends, starts, "right") - 1
            at = 0
            for walk in range(-(-len(found) // TABLES_PER_WALK)):
                width = min(TABLES_PER_WALK, len(found) - at)
                for keys in walk_keys(padded, bits, starts, window, steps, walk, width):
                    table, owner, offset = found[at]
                    at += 1
                    low = np.searchsorted(table, keys, "left")
                    hit = np.flatnonzero(table[np.minimum(low, len(table) - 1)] == keys)
                    low = low[hit]
                    n = np.searchsorted(table, keys[hit], "right") - low
                    rows = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    w = np.repeat(hit, n)
                    out.append(np.stack([texts[w], owner[rows], starts[w] - offset[rows]], 1))
        for size, known in self.exact.items():
            if len(sym) < size:
                continue
            bound = np.concatenate([[True], np.diff(keep) > 1, [True]])
            bound[ends] = True
            whole = np.flatnonzero(bound[: len(sym) - size + 1] & bound[size:])
            runs = sliding_window_view(sym, size)[whole]
            for i in known:
                at = whole[(runs == self.items[i]).all(1)]
                text = np.searchsorted(ends, at, "right") - 1
                inside = at + size <= ends[text + 1]
                out.append(np.stack([text[inside], np.full(inside.sum(), i), at[inside]], 1))
        return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 3), np.int64)

    def spans(self, sym: np.ndarray, ends: np.ndarray, keep: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, start, end) of what to search, each part of a text once for an item."""
        near = self.candidates(sym, ends, keep)
        held = np.concatenate([p.places(sym) for p in self.pieces] or [np.zeros((0, 3), np.int64)])
        n = np.asarray([len(s) for s in self.items])
        k = np.where(n >= LEAST, MAX_EDITS * n, 0).astype(np.int64)
        a, b = np.maximum(0, held[:, 1] - k[held[:, 0]]), np.minimum(len(sym), held[:, 2] + (n + 2 * k)[held[:, 0]])
        held, a, b = held[a < b], a[a < b], b[a < b]
        first, last = np.searchsorted(ends, a, "right") - 1, np.searchsorted(ends, b - 1, "right") - 1
        many = last - first + 1  # texts that a place touches
        row = np.repeat(np.arange(len(a)), many)
        text = np.concatenate([near[:, 0], np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())])
        item = np.concatenate([near[:, 1], held[row, 0]])
        a = np.maximum(ends[text], np.concatenate([near[:, 2] - k[near[:, 1]], a[row]]))
        b = np.minimum(ends[text + 1], np.concatenate([near[:, 2] + (n + 2 * k)[near[:, 1]], b[row]]))
        fit = np.flatnonzero(b - a >= (n - k)[item])
        order = fit[np.lexsort((a[fit], item[fit], text[fit]))]
        now = None
        for t, i, x, y in zip(*(v[order].tolist() for v in (text, item, a, b)), strict=True):
            if now and now[:2] == (t, i) and x <= now[3]:
                now = (t, i, now[2], max(y, now[3]))
                continue
            if now:
                yield now
            now = (t, i, x, y)
        if now:
            yield now

    def verify(self, sym: np.ndarray, ends: np.ndarray, keep: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, edits, start, end) of each item within MAX_EDITS of a place in a text; the best place."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for text, item, a, b in self.spans(sym, ends, keep):
            n = len(self.items[item])
            k = int(MAX_EDITS * n) if n >= LEAST else 0
            edits, end = edit_place(self.items[item], sym[a:b])
            if edits <= k and (edits, a + end) < best.get((text, item), (k + 1, 0, 0))[:2]:
                best[text, item] = (edits, a + end, max(a, a + end - n))
        for (text, item), (edits, end, start) in best.items():
            yield text, item, edits, start, end


HITS_DDL = "item_id long, edits long, similarity double, start long, end long"


def _search(batches: Iterator[pa.RecordBatch], items: list[tuple[int, str]]) -> Iterator[pa.RecordBatch]:
    index = ItemIndex(items)
    for part in blobs.text_blocks(batches, size=1 << 20):
        texts = [t or "" for t in part.column("text").to_pylist()]
        sym, keep, ends = index.alphabet.codes(texts)
        base = np.cumsum([0] + [len(t) for t in texts])
        rows = [(t, index.ids[i], e, 1 - e / len(index.items[i]), int(keep[a] - base[t]), int(keep[b - 1] + 1 - base[t])) for t, i, e, a, b in index.verify(sym, ends, keep)] if len(sym) else []
        if rows:
            at, *columns = zip(*rows, strict=True)
            ids = part.column("doc_id").take(pa.array(at))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c) for c in columns)], ["doc_id", "item_id", "edits", "similarity", "start", "end"])


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, edits, similarity, start, end): each benchmark item found in each document, at its best place;
    offsets in code points. Items come to the driver in blocks of at most block_chars characters; each block is a pass
    over the documents, and only one block is sent at a time."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for items in blocks_of(benchmark, block_chars):
        hits = d.mapInArrow(lambda b, items=items: blobs.freed(_search(b, items)), "doc_id long, " + HITS_DDL)
        out = hits if out is None else out.unionByName(hits)
    return out if out is not None else d.sparkSession.createDataFrame([], "doc_id long, " + HITS_DDL)


def _clean(batches: Iterator[pa.RecordBatch], items: list[tuple[int, str]]) -> Iterator[pa.RecordBatch]:
    index = ItemIndex(items)
    for part in blobs.text_blocks(batches, size=1 << 19):
        sym, keep, ends = index.alphabet.codes([t or "" for t in part.column("text").to_pylist()])
        leaky = {hit[0] for hit in index.verify(sym, ends, keep)} if len(sym) else set()
        yield part.filter(pa.array([i not in leaky for i in range(part.num_rows)]))


def blocks_of(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks of at most block_chars characters (a longer item is a block of its own)."""
    block, size = [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        text = r["text"] or ""
        if block and size + len(text) > block_chars:
            yield block
            block, size = [], 0
        block.append((r["item_id"], text))
        size += len(text)
    if block:
        yield block


def drop_leaky(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs whose text holds no benchmark item, with all their columns, in one pass for each block."""
    for items in blocks_of(benchmark, block_chars):
        docs = docs.mapInArrow(lambda b, items=items: blobs.freed(_clean(b, items)), docs.schema)
    return docs


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
