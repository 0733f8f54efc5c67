"""Best-fit packing of token sequences, by hierarchical residual packing.

Documents become token ids; a document longer than `capacity` is cut into pieces, the first of which may be shorter.
Each task packs windows of its pieces by best fit decreasing and emits bins; nearly full bins are final, underfull ones
become items of the next round, where fewer tasks (a tree of `node_bins` a node, nodes drawn anew each round) pack them
again, until one task packs the rest or a round brings nothing more. Only (bin, fill) pairs move between rounds.

Edge cases: null text is empty and becomes the end id alone; null ids, repeated rows and columns of other names pass
through (one set of pieces for each input row); an empty table gives no pieces; equal sizes are packed in input order.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worklore.llm import blobs
from worklore.llm.common import table, written

CAPACITY, END_ID = 1024, 2
WINDOW_TOKENS = 4_000_000
NODE_BINS = 50_000
#: entries of each of the cache's two generations; characters of a chunk that is kept
CACHE_ENTRIES, CACHE_CHARS = 100_000, 64
#: an executor holds a batch of each task in several copies: rows of a batch in and out, bytes of text encoded at a time
BATCH_ROWS, ENCODED_BYTES = 1024, 1 << 20
# Unicode's White_Space, as the tokenizer's pattern has it
SPACES = " \t\n\r\x0b\x0c\x85\xa0  -     　"
# Pre-tokens never span a change from other characters to white space, so texts can be encoded in these chunks.
CHUNK = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")


LOADED: dict = {}  # by path: tokenizer, encoder and frozen cache, loaded once in a worker's life, which spans tasks


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def rank_encoding(path: str):
    """The tokenizer as a rank-merging encoder, or None if it isn't plain byte-level BPE whose ids follow its merges. Both
    then give the same ids, and this one takes a fifth of the time."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if model["type"] != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; others follow 255
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
    merges = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
    if sorted(ranks.values()) != list(range(len(ranks))) or any(model["vocab"].get(m.replace(" ", "", 1)) != 256 + i for i, m in enumerate(merges)):
        return None
    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def frozen(cache: dict[str, bytes]) -> tuple[bytes, bytes, np.ndarray, np.ndarray]:
    """A cache in a few bytes an entry, as a worker keeps it between tasks, when its memory is other stages'."""
    keys = cache.keys()
    return "".join(keys).encode("utf-8", "surrogatepass"), b"".join(cache.values()), np.fromiter(map(len, keys), np.int32, len(cache)), np.fromiter(map(len, cache.values()), np.int32, len(cache))


def thawed(texts: bytes, ids: bytes, chars: np.ndarray, sizes: np.ndarray) -> dict[str, bytes]:
    text = texts.decode("utf-8", "surrogatepass")
    i, k = np.cumsum(chars).tolist(), np.cumsum(sizes).tolist()
    return {text[a:b]: ids[c:d] for a, b, c, d in zip([0, *i], i, [0, *k], k, strict=False)}


class ChunkEncoder:
    """Encodes texts as little-endian uint32 ids; the ids of short chunks are kept, in bounded memory: of a full cache those
    stay that are met again before the next is full."""

    def __init__(self, path: str):
        import tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path not in LOADED:
            LOADED[path] = (tokenizers.Tokenizer.from_file(path), rank_encoding(path), frozen({}))
        self.path, (self.tokenizer, self.ranks, kept) = path, LOADED[path]
        self.cache, self.older = thawed(*kept), {}
        self.line_end = self.ranks.encode_ordinary("\n")[0] if self.ranks else None
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _fill(self, chunks: list[str]) -> dict[str, bytes]:
        made: dict[str, bytes] = {}
        if self.ranks:
            # one call for all: a line end between chunks is a pre-token and an id of its own
            lines = [c for c in chunks if c[0] not in SPACES or c[0] == " " and c[1:2] not in SPACES]  # an empty one is in SPACES
            text = "\n".join(lines)
            if any(x in text for x in self.special):
                lines = [c for c in lines if not any(x in c for x in self.special)]
                text = "\n".join(lines)
            ids = np.asarray(self.ranks.encode_ordinary(text), dtype="<u4")
            cuts = np.flatnonzero(ids == self.line_end) * 4
            raw = ids.tobytes()
            made = {c: raw[i:j] for c, i, j in zip(lines, [0, *(cuts + 4).tolist()], [*cuts.tolist(), len(raw)], strict=True)} if lines else {}
        rest = [c for c in chunks if c not in made]
        for i in range(0, len(rest), 4096):
            part = rest[i : i + 4096]
            for c, e in zip(part, self.tokenizer.encode_batch(part, add_special_tokens=False), strict=True):
                made[c] = np.asarray(e.ids, dtype="<u4").tobytes()
        return made

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [CHUNK.findall(t) for t in texts]
        if len(self.cache) > CACHE_ENTRIES:
            self.cache, self.older = {}, self.cache
        known, older = self.cache, self.older
        fresh = set().union(*split).difference(known)
        new = fresh.difference(older)
        known.update((c, older[c]) for c in fresh - new)
        made = self._fill(list(new))
        long = {c: b for c, b in made.items() if len(c) > CACHE_CHARS}
        known.update(made if not long else ((c, b) for c, b in made.items() if c not in long))
        get = known.__getitem__ if not long else lambda c: long[c] if c in long else known[c]
        return [b"".join(map(get, chunks)) for chunks in split]

    def close(self) -> None:
        """Leave the cache to the worker's next task."""
        LOADED[self.path] = (self.tokenizer, self.ranks, frozen(self.older | self.cache))


def best_fit(sizes: list[int] | np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit decreasing: (bin of each item, offset of each item in its bin, fill of each bin)."""
    sizes = np.asarray(sizes, dtype=np.int64)
    which, place, fills = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit f: a bin with f free tokens is open
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        rest = mask >> n
        if rest:
            free = n + (rest & -rest).bit_length() - 1
            b = with_room[free].pop()
            if not with_room[free]:
                mask &= ~(1 << free)
        else:
            b, free = len(fills), capacity
            fills.append(0)
        which[i], place[i] = b, capacity - free
        fills[b] += n
        free -= n
        if free:
            with_room[free].append(b)
            mask |= 1 << free
    return which, place, np.asarray(fills, np.int64)


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("bin", pa.int64()), ("place", pa.int64()), ("fill", pa.int64())])
PIECES_DDL = "doc_id long, piece int, start long, length long, ids binary, bin long, place long, fill long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of n tokens; all but the first are full."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def _tokenize(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    encoder = ChunkEncoder(path)
    end = np.asarray([end_id], dtype="<u4").tobytes()
    next_bin = TaskContext.get().partitionId() << 36
    rows: list[tuple] = []
    held = 0

    def packed() -> Iterator[pa.RecordBatch]:
        nonlocal next_bin
        which, place, fills = best_fit([r[3] for r in rows], capacity)
        for i in range(0, len(rows), BATCH_ROWS):
            part = rows[i : i + BATCH_ROWS]
            w = which[i : i + BATCH_ROWS]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t.type) for c, t in zip(zip(*part, strict=True), PIECES, strict=False)), pa.array(w + next_bin), pa.array(place[i : i + BATCH_ROWS]), pa.array(fills[w])], schema=PIECES)
        next_bin += len(fills)

    for part in blobs.text_blocks(batches, size=ENCODED_BYTES):
        texts = [t or "" for t in part.column(1).to_pylist()]
        for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode(texts), strict=True):
            ids += end
            for k, (start, n) in enumerate(cut(len(ids) // 4, capacity)):
                rows.append((doc_id, k, start, n, ids[4 * start : 4 * (start + n)]))
            held += len(ids) // 4
        if held >= WINDOW_TOKENS:
            yield from packed()
            rows, held = [], 0
    encoder.close()
    if rows:
        yield from packed()


def _repack(batches: Iterator[pa.RecordBatch], capacity: int, slack: int) -> Iterator[pa.RecordBatch]:
    """One node of a round: members (bin, top, at, fill) of the node's bins, packed again as items."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    t = pa.Table.from_batches(got)
    bin_, top, at, fill = (t.column(c).to_numpy() for c in ("bin", "top", "at", "fill"))
    tops, first, inverse = np.unique(top, return_index=True, return_inverse=True)
    which, place, fills = best_fit(fill[first], capacity)
    heads = np.full(len(fills), np.iinfo(np.int64).max)
    np.minimum.at(heads, which, tops)
    w = which[inverse]
    yield pa.RecordBatch.from_arrays([pa.array(bin_), pa.array(heads[w]), pa.array(at + place[inverse]), pa.array(fills[w]), pa.array(fills[w] >= capacity - slack)], ["bin", "top", "at", "fill", "done"])


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None, slack: int = 8, node_bins: int = NODE_BINS) -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset): every document's pieces and their places in sequences
    of at most `capacity` tokens. ids holds little-endian uint32. The pieces are a table in the shared folder."""
    path = tokenizer or default_tokenizer()
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with blobs.small_batches(docs.sparkSession, BATCH_ROWS):
        pieces = written(texts.mapInArrow(lambda b: blobs.freed(_tokenize(b, path, capacity, end_id)), PIECES_DDL), "pieces")
    under = pieces.where((F.col("place") == 0) & (F.col("fill") < capacity - slack))
    left = under.select("bin", F.col("bin").alias("top"), F.lit(0).cast("long").alias("at"), "fill")
    n, turn, final = left.count(), 0, []
    while n:
        nodes = -(-n // node_bins)
        packed = left.repartition(nodes, F.xxhash64("top", F.lit(turn))).mapInArrow(lambda b, k=slack << turn: blobs.freed(_repack(b, capacity, k)), "bin long, top long, at long, fill long, done boolean")
        packed = written(packed, f"bins{turn}")
        last = nodes == 1
        left = packed.where("not done").drop("done")
        rest = 0 if last else left.count()
        last = last or rest > 0.9 * n
        final.append(packed if last else packed.where("done"))
        if last:
            break
        n, turn = rest, turn + 1
    out = pieces.select("doc_id", "piece", "start", "length", "ids", "bin", "place")
    if not final:
        return out.select("doc_id", "piece", "start", "length", "ids", F.col("bin").alias("sequence_id"), F.col("place").alias("offset"))
    moved = final[0].select("bin", "top", "at")
    for f in final[1:]:
        moved = moved.unionByName(f.select("bin", "top", "at"))
    out = out.join(moved, "bin", "left")
    return out.select("doc_id", "piece", "start", "length", "ids", F.coalesce("top", "bin").alias("sequence_id"), (F.coalesce("at", F.lit(0)) + F.col("place")).alias("offset"))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
