"""Removal of repeated byte strings across documents, by bucket-pointer refinement.

Every byte that a `length`-byte string covers which also starts in a document of smaller id is removed. Strings get
bucket names by refinement: names of q-grams come from pairs of names of shorter grams, the second at a later offset,
1-2-4-8-16-24-32-50, so each step reuses the last one's names. Only one position in about twelve is exchanged: each
string is filed under its anchor, the 24-gram of least name inside it, and strings with one anchor make a run. 24-grams
that a first pass finds to be common, by counts in bounded room, come last in that order. So they are anchors only where a
string holds nothing else, their runs are copies of few kinds, and each block of input sends one of a kind: no bucket of a
passage that many documents share, or of blanks, grows with the documents that hold it.

1. Runs are sorted by anchor bucket, then refined by the name of all bytes that the run's strings cover. A run whose
   bytes a smaller document has is repeated as a whole; anchors of one document only are dropped.
2. Anchors with several kinds of runs (at the ends of repeats) are refined to the last level: the bytes of one run of
   each kind are fetched and their strings sorted by anchor, place and name.
3. Marks return to their documents, which drop the bytes covered.

Copies inside a block of input are settled there, so that a hot passage sends a row for each block, not for each copy.

Edge cases: null text is empty; texts shorter than `length` lose nothing; rows with null id lose nothing and nothing is
lost to them; repeated rows have one id, so neither loses to the other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worklore.llm import blobs
from worklore.llm.blobs import mix, new_groups, spread
from worklore.llm.common import reread, written
from worklore.sources.tables import read_table

LENGTH = 50
GRAM = 24
POSITION_BITS = 23
#: of the 24-grams that tasks report as frequent, so many are used at most, and those of this count at least
COMMON, LEAST_COUNT = 1 << 16, 32
RUNS, RANGES, CHECKS, TEXTS, CONTEXTS = range(5)
NAMES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def refine(names: np.ndarray, offset: int) -> np.ndarray:
    """Names of longer grams from the names at a position and `offset` later; shorter by offset."""
    return mix(names[:-offset] * np.uint64(0x9E3779B97F4A7C15) + names[offset:] * np.uint64(0xC2B2AE3D27D4EB4F))


def gram_names(raw: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of all grams of `gram` and of `length` bytes; gram is 24 and length 32 to 64."""
    n = NAMES[raw]
    for offset in (1, 2, 4, 8):
        n = refine(n, offset)
    n24 = refine(n, gram - 16)
    n32 = refine(n, 16)
    return n24, refine(n32, length - 32)


class Common:
    """Names of 24-grams that are known as common."""

    def __init__(self, names: np.ndarray):
        self.names, self.maybe = np.sort(names), np.zeros(1 << 22, bool)
        self.maybe[names >> np.uint64(42)] = True

    def among(self, names: np.ndarray) -> np.ndarray:
        """Positions of those."""
        may = np.flatnonzero(self.maybe[names >> np.uint64(42)])
        if not len(may):
            return may
        at = np.minimum(np.searchsorted(self.names, names[may]), len(self.names) - 1)
        return may[self.names[at] == names[may]]


def least(names: np.ndarray, width: int, common: Common | None = None) -> np.ndarray:
    """Position of the least name among each `width` successive ones, the leftmost of equals; common names are the
    greatest."""
    m = (names >> np.uint64(POSITION_BITS + 1) << np.uint64(POSITION_BITS)) | np.arange(len(names), dtype=np.uint64)
    if common is not None:
        m[common.among(names)] |= np.uint64(1 << 63)
    span = 1
    while 2 * span <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if width > span:
        m = np.minimum(m[: -(width - span)], m[width - span :])
    return (m & np.uint64((1 << POSITION_BITS) - 1)).astype(np.int64)


def runs_of(raw: np.ndarray, ends: np.ndarray, length: int, common: Common | None = None) -> tuple[np.ndarray, ...] | None:
    """Of all strings inside one document: (document, first start, last start, anchor, anchor's name, bytes' name)."""
    if len(raw) < length:
        return None
    n24, whole = gram_names(raw, length, GRAM)
    anchor = least(n24, length - GRAM + 1, common)
    doc = np.searchsorted(ends, np.arange(len(whole)), "right") - 1
    ok = np.arange(len(whole)) + length <= ends[doc + 1]
    starts = np.flatnonzero(ok)
    if not len(starts):
        return None
    a, d = anchor[starts], doc[starts]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (d[1:] != d[:-1])])
    first = starts[new]
    last = starts[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(starts) - 1]])]
    a, d = a[new], d[new]
    name = mix(whole[first] * np.uint64(3) + whole[last] * np.uint64(0xD6E8FEB86659FD93) + ((last - first) * 64 + (a - first)).astype(np.uint64))
    return d, first, last, a, n24[a], name


def tags(column: pa.Array, raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 32-bit mark of each text, to tell apart texts that come under one id."""
    import zlib

    view = memoryview(np.ascontiguousarray(raw))
    return np.asarray([zlib.crc32(view[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], np.uint32)


def _same_as_before(*columns: np.ndarray) -> np.ndarray:
    return ~new_groups(*columns)


def _often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, count) of the 24-grams that are the most frequent in a task."""
    often = blobs.Frequent()
    for part in blobs.text_blocks(batches):
        raw, _ = blobs.text_bytes(part.column("text"))
        for at in range(0, len(raw), blobs.BLOCK_BYTES):
            piece = raw[at : at + blobs.BLOCK_BYTES + GRAM - 1]
            if len(piece) >= GRAM:
                n = NAMES[piece]
                for offset in (1, 2, 4, 8):
                    n = refine(n, offset)
                often.add(refine(n, GRAM - 16))
    names, counts = often.reported()
    if len(names):
        yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(counts)], ["name", "count"])


def _runs(batches: Iterator[pa.RecordBatch], length: int, buckets: int, names: np.ndarray) -> Iterator[pa.RecordBatch]:
    common, out = Common(names), blobs.Dealer()
    for part in blobs.text_blocks(batches, size=min(blobs.BLOCK_BYTES, 1 << POSITION_BITS)):
        raw, ends = blobs.text_bytes(part.column("text"))
        ids = part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
        tag = tags(part.column("text"), raw, ends)
        # a longer text is a block of its own, and goes in parts that overlap by less than a string
        step = min(blobs.BLOCK_BYTES, 1 << POSITION_BITS) - length
        for at in range(0, max(1, len(raw)), step):
            piece = raw[at : at + step + length - 1]
            found = runs_of(piece, np.clip(ends - at, 0, len(piece)), length, common)
            if found is None:
                continue
            d, first, last, a, key, name = found
            doc, base = ids[d], at - ends[d]
            order = np.lexsort((doc, name, key))
            d, doc, key, name = d[order], doc[order], key[order], name[order]
            first, last, a = (x[order] + base[order] for x in (first, last, a))
            follows = _same_as_before(key, name)
            lead = np.maximum.accumulate(np.where(follows, 0, np.arange(len(key))))
            settled = doc > doc[lead]
            out.add(RANGES, spread(doc[settled], buckets), [doc[settled], tag[d[settled]], first[settled].astype(np.uint32), last[settled].astype(np.uint32)])
            k = ~settled
            out.add(RUNS, spread(key[k], buckets), [key[k], name[k] >> np.uint64(16), doc[k], tag[d[k]], first[k].astype(np.uint32), (a - first)[k].astype(np.uint8), (last - first)[k].astype(np.uint8)])
            if out.full():
                yield from out.batches()
    yield from out.batches()


def _settle(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    rows: list = []
    runs = []
    for b in batches:
        for bucket, kind, payload in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if kind == RANGES:
                rows.append((bucket, kind, payload))
            else:
                runs.append(blobs.decode(payload))
        if len(rows) > 1024:
            yield blobs.batch(rows)
            rows = []
    if runs:
        key, name, doc, tag, first, off, reach = blobs.merge(runs)
        del runs
        order = np.argsort(key, kind="stable")
        k = key[order]
        starts = np.flatnonzero(~_same_as_before(k))
        low, high = np.minimum.reduceat(doc[order], starts), np.maximum.reduceat(doc[order], starts)
        size = np.diff(np.concatenate([starts, [len(k)]]))
        order = order[np.repeat(low != high, size)]
        key, name, doc, tag, first, off, reach = (x[order] for x in (key, name, doc, tag, first, off, reach))
        if len(key):
            order = np.lexsort((doc, name, key))
            key, name, doc, tag, first, off, reach = (x[order] for x in (key, name, doc, tag, first, off, reach))
            follows, same_key = _same_as_before(key, name), _same_as_before(key)
            place = np.arange(len(key))
            lead = np.maximum.accumulate(np.where(follows, 0, place))
            whole = doc > doc[lead]
            starts = np.flatnonzero(~same_key)
            kinds = np.add.reduceat((~follows).astype(np.int64), starts)
            mixed = np.repeat(kinds > 1, np.diff(np.concatenate([starts, [len(key)]])))
            rows += blobs.deal(spread(doc[whole], buckets), [doc[whole], tag[whole], first[whole], first[whole] + reach[whole]], RANGES)
            c = mixed & ~whole
            rows += blobs.deal(spread(doc[c], buckets), [doc[c], tag[c], key[c], first[c], off[c], reach[c]], CHECKS)
    if rows:
        yield blobs.batch(rows)


def _texts(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Texts on the way to their marks: payload holds ids, tags, sizes, and bytes in a column of its own."""
    held: dict[int, list[tuple]] = {}
    size = 0

    def rows() -> list[tuple[int, int, bytes]]:
        out = []
        for b, parts in held.items():
            ids, tag, sizes, text = blobs.merge(parts)
            head = blobs.encode([ids, tag, sizes])
            out.append((b, TEXTS, len(head).to_bytes(4, "little") + head + blobs.encode([text])))
        held.clear()
        return out

    for part in blobs.text_blocks(batches):
        raw, ends = blobs.text_bytes(part.column("text"))
        ids = part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
        tag, where, sizes = tags(part.column("text"), raw, ends), spread(ids, buckets), np.diff(ends)
        for b in np.unique(where).tolist():
            mine = np.flatnonzero(where == b)
            held.setdefault(b, []).append((ids[mine], tag[mine], sizes[mine], np.concatenate([raw[ends[i] : ends[i + 1]] for i in mine])))
        size += len(raw)
        if size >= blobs.BLOCKS_BYTES:
            yield blobs.batch(rows())
            size = 0
    if held:
        yield blobs.batch(rows())


def _with_marks(batches: Iterator[pa.RecordBatch]) -> tuple[list, dict[int, list]]:
    texts, marks = [], {}
    for b in batches:
        for kind, payload in zip(b.column("kind").to_pylist(), b.column("payload").to_pylist(), strict=True):
            if kind == TEXTS:
                n = int.from_bytes(payload[:4], "little")
                texts.append((blobs.decode(payload[4 : 4 + n]), payload[4 + n :]))
            else:
                marks.setdefault(kind, []).append(blobs.decode(payload))
    return texts, marks


def _grouped(columns: blobs.Columns) -> dict[tuple[int, int], tuple[int, int]]:
    """(doc, tag) -> span of rows; the columns are sorted in place by both."""
    order = np.lexsort((columns[1], columns[0]))
    columns[:] = [c[order] for c in columns]
    starts = np.flatnonzero(~_same_as_before(columns[0], columns[1]))
    return {(int(columns[0][s]), int(columns[1][s])): (int(s), int(e)) for s, e in zip(starts, [*starts[1:], len(order)], strict=True)}


def _contexts(batches: Iterator[pa.RecordBatch], length: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """The bytes that each run to be checked covers, on the way to its anchor's bucket."""
    texts, marks = _with_marks(batches)
    if CHECKS not in marks:
        return
    checks = blobs.merge(marks[CHECKS])
    spans = _grouped(checks)
    doc, tag, key, first, off, reach = checks
    held, n = [], 0
    for (ids, tagged, sizes), packed in texts:
        (raw,) = blobs.decode(packed)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        got: list[np.ndarray] = []
        at: list[int] = []
        for i, (d, t) in enumerate(zip(ids.tolist(), tagged.tolist(), strict=True)):
            s, e = spans.get((d, t), (0, 0))
            got.append(np.arange(s, e))
            at += [int(ends[i])] * (e - s)
        rows_at = np.concatenate(got) if got else np.zeros(0, np.int64)
        if not len(rows_at):
            continue
        width = -(-(2 * length - GRAM) // 8) * 8
        begin = np.asarray(at) + first[rows_at]
        padded = np.concatenate([raw, np.zeros(width, np.uint8)])
        window = padded[begin[:, None] + np.arange(width)]
        window[np.arange(width) >= (length + reach[rows_at].astype(np.int64))[:, None]] = 0
        columns = [key[rows_at], doc[rows_at], tag[rows_at], first[rows_at], off[rows_at], reach[rows_at]]
        columns += [np.ascontiguousarray(window[:, 8 * j : 8 * j + 8]).view(np.uint64)[:, 0] for j in range(width // 8)]
        held.append(columns)
        n += len(rows_at)
        if n >= 100_000:
            columns = blobs.merge(held)
            yield blobs.batch(list(blobs.deal(spread(columns[0], buckets), columns, CONTEXTS)))
            held, n = [], 0
    if held:
        columns = blobs.merge(held)
        yield blobs.batch(list(blobs.deal(spread(columns[0], buckets), columns, CONTEXTS)))


def _refined(batches: Iterator[pa.RecordBatch], length: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Last level of refinement: strings sorted by anchor, place of the anchor and name; those after a smaller
    document's are marked."""
    got = blobs.collected(batches).get(CONTEXTS)
    if not got:
        return
    key, doc, tag, first, off, reach, *packed = blobs.merge(got)
    window = np.stack(packed, axis=1).view(np.uint8).reshape(len(key), -1)
    order = np.argsort(key, kind="stable")
    starts = np.flatnonzero(~_same_as_before(key[order]))
    bounds = [0]
    for s in [*starts[1:].tolist(), len(order)]:  # whole buckets, about 20,000 runs at a time
        if s - bounds[-1] >= 20_000 or s == len(order):
            bounds.append(s)
    rows: list = []
    for a, b in zip(bounds, bounds[1:], strict=False):
        at = order[a:b]
        w = window[at]
        n = NAMES[w]
        for offset in (1, 2, 4, 8, 16):
            n = mix(n[:, :-offset] * np.uint64(0x9E3779B97F4A7C15) + n[:, offset:] * np.uint64(0xC2B2AE3D27D4EB4F))
        o = length - 32
        n = mix(n[:, :-o] * np.uint64(0x9E3779B97F4A7C15) + n[:, o:] * np.uint64(0xC2B2AE3D27D4EB4F))
        who, j = np.nonzero(np.arange(n.shape[1])[None] <= reach[at][:, None])
        k, d, g = key[at][who], doc[at][who], tag[at][who]
        place, name, start = off[at][who].astype(np.int64) - j, n[who, j], first[at][who].astype(np.int64) + j
        s = np.lexsort((d, name, place, k))
        follows = _same_as_before(k[s], place[s], name[s])
        lead = np.maximum.accumulate(np.where(follows, 0, np.arange(len(s))))
        hit = s[d[s] > d[s][lead]]
        rows += blobs.deal(spread(d[hit], buckets), [d[hit], g[hit], start[hit].astype(np.uint32), start[hit].astype(np.uint32)], RANGES)
    if rows:
        yield blobs.batch(rows)


OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])
OUT_DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _finish(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    texts, marks = _with_marks(batches)
    ranges = blobs.merge(marks[RANGES]) if RANGES in marks else [np.zeros(0, np.int64)] * 4
    spans = _grouped(ranges) if len(ranges[0]) else {}
    for (ids, tagged, sizes), packed in texts:
        (raw,) = blobs.decode(packed)
        ends = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        rows = []
        for i, (d, t) in enumerate(zip(ids.tolist(), tagged.tolist(), strict=True)):
            text = raw[ends[i] : ends[i + 1]]
            s, e = spans.get((d, t), (0, 0))
            if s == e:
                rows.append((d, len(text), 0, 0, text.tobytes()))
                continue
            edge = np.zeros(len(text) + 1, np.int32)
            np.add.at(edge, ranges[2][s:e].astype(np.int64), 1)
            np.add.at(edge, ranges[3][s:e].astype(np.int64) + length, -1)
            gone = np.cumsum(edge[:-1]) > 0
            n_spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
            rows.append((d, len(text), int(gone.sum()), n_spans, text[~gone].tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), OUT, strict=True)], schema=OUT)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): kept holds the bytes left. length is 50 to 64."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    named = d.where("doc_id is not null")
    partitions, buckets = blobs.counts(docs)
    often = named.mapInArrow(lambda b: blobs.freed(_often(b)), "name long, count long").groupBy("name").agg(F.sum("count").alias("count")).where(F.col("count") >= LEAST_COUNT)
    # COMMON names at most; any choice of them gives the same result
    common = often.orderBy(F.desc("count"), "name").limit(COMMON).toArrow().column("name").to_numpy().view(np.uint64)
    runs = named.mapInArrow(lambda b: blobs.freed(_runs(b, length, buckets, common)), blobs.DDL)
    settled = written(blobs.exchange(runs, partitions).mapInArrow(lambda b: blobs.freed(_settle(b, buckets)), blobs.DDL), "settled")
    texts = named.mapInArrow(lambda b: blobs.freed(_texts(b, buckets)), blobs.DDL)
    checks = texts.unionByName(settled.where(F.col("kind") == CHECKS))
    contexts = blobs.exchange(checks, partitions).mapInArrow(lambda b: blobs.freed(_contexts(b, length, buckets)), blobs.DDL)
    refined = written(blobs.exchange(contexts, partitions).mapInArrow(lambda b: blobs.freed(_refined(b, length, buckets)), blobs.DDL), "refined")
    marked = texts.unionByName(settled.where(F.col("kind") == RANGES)).unionByName(refined)
    done = blobs.exchange(marked, partitions).mapInArrow(lambda b: blobs.freed(_finish(b, length)), OUT_DDL)
    text = F.coalesce("text", F.lit("")).cast("binary")
    zero = F.lit(0).cast("long")
    return done.unionByName(d.where("doc_id is null").select("doc_id", F.length(text).cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), text.alias("kept")))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(reread(read_table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
