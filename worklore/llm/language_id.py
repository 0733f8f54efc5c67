"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from its code point; a trigram's vector binds (multiplies) its
letters' vectors, cyclically shifted by position; a text bundles (adds) its trigrams' vectors, and a language's
prototype bundles its training texts. A text gets the language of the prototype with the largest cosine.

Edge cases: null text, or text without a letter, is `und` with score 0, and so is every text where nothing could be
learned; equal cosines go to the first language by name; null ids and repeated rows give one output row each; rows with
null lang are not learned from. Whole texts are used, in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worklore.llm import blobs
from worklore.llm.common import fresh_name, table

DIMENSIONS, SEED = 1024, 20
UNKNOWN = "und"
MAX_BLOCK_CHARS, MAX_BLOCK_DOCS = 500_000, 256
CHUNK = 2048  # trigrams whose vectors are held at a time
SMALL = 128  # alphabets below this size get direct tables


class Trigrams:
    """Counts letter trigrams of blocks of texts and bundles their vectors. What is held is bounded: the letters' vectors,
    one block's codes, and the vectors and counts of CHUNK trigrams."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        self.dimensions, self.seed = dimensions, seed
        self.index = np.full(0x110000, -1, np.int32)  # of a code point: 0 for other than letters, -1 for not yet seen
        self.room = np.empty((64, dimensions), np.int8)
        self.n_letters = 0
        self._letter(0)

    def _letter(self, code: int) -> None:
        if self.n_letters == len(self.room):
            self.room = np.concatenate([self.room, np.empty_like(self.room)])
        self.room[self.n_letters] = np.random.default_rng((self.seed, code)).integers(0, 2, self.dimensions, dtype=np.int8) * 2 - 1
        self.index[code] = self.n_letters
        self.n_letters += 1

    def _learn(self, codes: np.ndarray) -> None:
        for c in np.flatnonzero(np.bincount(codes)).tolist():
            if self.index[c] < 0:
                if chr(c).isalpha():
                    self._letter(c)
                else:
                    self.index[c] = 0

    def _add(self, out: np.ndarray, seq: np.ndarray, owner: np.ndarray) -> None:
        """Add to each owner's row of `out` the vectors of the trigrams of a run of letters; 0 stands between words."""
        middle = seq[1:-1] != 0
        a, b, c, owner = seq[:-2][middle], seq[1:-1][middle], seq[2:][middle], owner[1:-1][middle]
        if self.n_letters <= SMALL:
            keys = (a * SMALL + b) * SMALL + c
            found = np.flatnonzero(np.bincount(keys, minlength=1))
            at = np.zeros(SMALL**3, np.int32)
            at[found] = np.arange(len(found))
            column = at[keys]
            fa, fb, fc = found // SMALL**2, found // SMALL % SMALL, found % SMALL
        else:
            found, column = np.unique((a << 42) | (b << 21) | c, return_inverse=True)
            fa, fb, fc = found >> 42, found >> 21 & 0x1FFFFF, found & 0x1FFFFF
        if len(found) > CHUNK:
            order = np.argsort(column.astype(np.uint16) if len(found) <= 1 << 16 else column, kind="stable")
            column, owner = column[order], owner[order]
        for i in range(0, len(found), CHUNK):
            low, high = (0, len(column)) if len(found) <= CHUNK else np.searchsorted(column, (i, i + CHUNK))
            n = min(CHUNK, len(found) - i)
            counts = np.bincount(owner[low:high] * n + (column[low:high] - i), minlength=len(out) * n).reshape(len(out), n)
            vectors = np.roll(self.room[fa[i : i + n]], 2, axis=1)
            vectors *= np.roll(self.room[fb[i : i + n]], 1, axis=1)
            vectors *= self.room[fc[i : i + n]]
            out += counts.astype(np.float32) @ vectors.astype(np.float32)

    def bundle(self, texts: list[str]) -> np.ndarray:
        """A row for each text: the sum of its trigrams' vectors. Long blocks go in parts that overlap by two codes."""
        out = np.zeros((len(texts), self.dimensions), np.float32)
        low = [t.lower() for t in texts]
        ends = np.cumsum([1] + [len(t) + 1 for t in low])
        whole = "\0" + "\0".join(low) + "\0"
        del low
        for start in range(0, max(0, len(whole) - 2), MAX_BLOCK_CHARS):
            codes = np.frombuffer(whole[start : start + MAX_BLOCK_CHARS + 2].encode("utf-32-le", "surrogatepass"), np.uint32)
            self._learn(codes)
            seq = self.index[codes]
            owner = np.minimum(np.searchsorted(ends, np.arange(start, start + len(codes)), "right") - 1, len(texts) - 1).clip(0)
            keep = np.concatenate([[True], (seq[1:] != 0) | (seq[:-1] != 0)])
            self._add(out, seq[keep].astype(np.int64), owner[keep])
        return out


def blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with a bounded number of rows and, but for a single long text, of characters in column 0."""
    start = size = 0
    for i, n in enumerate(pc.fill_null(pc.utf8_length(batch.column(0)), 0).to_pylist()):
        if i > start and (size + n > MAX_BLOCK_CHARS or i - start >= MAX_BLOCK_DOCS):
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


def _prototypes(batches: Iterator[pa.RecordBatch], dimensions: int, seed: int) -> Iterator[pa.RecordBatch]:
    grams, sums = Trigrams(dimensions, seed), {}
    for batch in batches:
        for part in blocks(batch):
            langs = np.asarray(part.column(1).to_pylist(), dtype=object)
            rows = grams.bundle(part.column(0).to_pylist())
            for lang in set(langs):
                sums[lang] = sums.get(lang, 0) + rows[langs == lang].sum(0, dtype=np.float64)
    salt = TaskContext.get().partitionId() % 64
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([salt] * len(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["lang", "salt", "bundle"])


def prototypes(train: DataFrame, dimensions: int = DIMENSIONS, seed: int = SEED) -> dict[str, np.ndarray]:
    """Unit prototype of each lang in train(text, lang). Partial bundles are added up in two steps; the driver gets one
    vector of `dimensions` numbers for each language."""
    rows = train.where("text is not null and lang is not null").select("text", "lang").mapInArrow(lambda b: blobs.freed(_prototypes(b, dimensions, seed)), "lang string, salt long, bundle array<double>")
    add = lambda key, t: t[:1].assign(bundle=[np.sum(np.stack(t["bundle"].to_list()), axis=0).tolist()], salt=0)
    schema = "lang string, salt long, bundle array<double>"
    rows = rows.groupBy("lang", "salt").applyInPandas(add, schema).groupBy("lang").applyInPandas(add, schema)
    out = {}
    for r in sorted(rows.collect(), key=lambda r: r["lang"]):
        v = np.asarray(r["bundle"])
        if norm := np.linalg.norm(v):
            out[r["lang"]] = (v / norm).astype(np.float32)
    return out


def _classify(batches: Iterator[pa.RecordBatch], learned: dict[str, np.ndarray], dimensions: int, seed: int, out: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    grams, names = Trigrams(dimensions, seed), list(learned)
    matrix = np.stack([learned[n] for n in names]) if names else None
    for batch in batches:
        for part in blocks(batch):
            texts = [t or "" for t in part.column(0).to_pylist()]
            langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if names:
                rows = grams.bundle(texts)
                norms = np.linalg.norm(rows, axis=1)
                cosines = rows @ matrix.T / np.maximum(norms, 1e-9)[:, None]
                best = cosines.argmax(1)
                letters = [any(c.isalpha() for c in t) for t in texts]
                langs = [names[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)]
                scores = np.where(letters, np.clip(cosines.max(1), 0, 1), 0).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(1, part.num_columns)), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*part.schema.names[1:], *out])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, learned: dict[str, np.ndarray], text_col: str = "text", dimensions: int = DIMENSIONS, seed: int = SEED, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Add the predicted language and its score to docs, under these names (columns of these names are replaced)."""
    keep = [c for c in docs.columns if c not in names]
    d = docs.select(F.col(text_col).alias(fresh_name(docs.columns, "whole_text")), *keep)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + f", `{names[0]}` string, `{names[1]}` double"
    return d.mapInArrow(lambda b: blobs.freed(_classify(b, learned, dimensions, seed, names)), schema)


def learn(docs: DataFrame) -> dict[str, np.ndarray]:
    return prototypes(docs.where(~held_out(F.col("doc_id"))))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    named = identify(rows, learn(docs.select("doc_id", "text", "lang")))
    return named.select("doc_id", "held_out", "lang_pred", "score")
