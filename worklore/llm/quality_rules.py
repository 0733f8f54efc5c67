"""Quality rules: per-document counts, and lines that too many documents of one host share.

Lines are normalised and hashed; the distinct texts that hold a line are counted by host (`source`). Lines in at least
`min_docs` texts are removed from each text, what is left is returned and its words are counted, and a document of which too
little is left is rejected. Copies of one text count once, so
that a duplicated clean document isn't taken for boilerplate.

Edge cases: null or empty text has no words and fails; null sources form one host; null ids and repeated rows are kept,
one output row for each input row, with equal verdicts for equal rows; other columns are left out. A hot host
or line is spread by the other parts of the aggregation key and combined before the exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worklore.llm.common import SPACE, ascii_lower, let, table, words

WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
MIN_DOCS, MIN_KEPT = 25, 0.2
SYMBOLS = "#*$%&|<>"


def repeated_window_words(w: Column, size: int = WINDOW) -> Column:
    """Words inside windows of `size` words that occur at least twice in the array, the first occurrence included."""
    n = F.size(w)
    hashes = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))

    def covered(h: Column) -> Column:
        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda p: F.filter(p, lambda x, k: F.coalesce(F.get(p, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(p, k + 1)["h"] == x["h"], F.lit(False)))
        starts = F.sort_array(F.transform(let(ranked, same), lambda x: x["i"]))
        return let(starts, lambda s: F.aggregate(F.transform(s, lambda at, k: F.least(F.lit(size), F.coalesce(F.get(s, k + 1) - at, F.lit(size)))), F.lit(0), lambda a, x: a + x))

    some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))
    return F.when(n > size, some).otherwise(0).cast("long")


def text_counts(text: Column) -> Column:
    """struct<n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words> of one text."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(SPACE.replace("[", "[^")))
    return let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            repeated_window_words(w).alias("n_repeat_words"),
        ),
    )


def normal_line(line: Column) -> Column:
    return F.btrim(F.regexp_replace(ascii_lower(line), SPACE + "+", " "))


def line_words(docs: DataFrame) -> DataFrame:
    """A row for each line that has words: (doc_id, text_hash, at, line), line being a hash of host and normal form and at its
    place in the text."""
    lines = F.transform(F.split("text", "\n"), lambda x: let(normal_line(x), lambda v: F.when(v != "", F.xxhash64(F.col("host"), v))))
    return docs.select("doc_id", "text_hash", F.posexplode(lines).alias("at", "line")).where("line is not null")


def without_lines(text: Column, places: Column) -> Column:
    """The text without the lines at these places, which are in order: the runs of lines between them."""

    def runs(lines: Column, gone: Column) -> Column:
        def run(k: Column) -> Column:
            start = F.coalesce(F.get(gone, k - 1) + 1, F.lit(0))
            return F.slice(lines, start + 1, F.coalesce(F.get(gone, k), F.size(lines)) - start)

        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), run)), "\n")

    return let(F.split(text, "\n"), lambda lines: let(places, lambda gone: runs(lines, gone)))


def frequent_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    return lines.groupBy("line").agg(F.countDistinct("text_hash").alias("n_docs")).where(F.col("n_docs") >= min_docs)


def quality_rules(docs: DataFrame, text_col: str = "text", host_col: str = "source", id_col: str = "doc_id", min_docs: int = MIN_DOCS, min_kept: float = MIN_KEPT) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, removed_words, base_failed, kept, clean_text):
    clean_text is the text without its frequent lines, and removed_words are those that it lacks."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(host_col), F.lit("")).alias("host"), text.alias("text")).withColumn("text_hash", F.xxhash64("text", "host"))
    lines = line_words(d)
    # a set: rows that repeat give the text's lines each, and all come to the same places
    gone = lines.join(frequent_lines(lines, min_docs), "line", "left_semi").groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("at")).alias("gone"))
    gone = gone.select(F.col("doc_id").alias("r_id"), F.col("text_hash").alias("r_hash"), "gone")
    base = d.select("doc_id", "text_hash", "text", text_counts(F.col("text")).alias("c")).select("doc_id", "text_hash", "text", "c.*")
    out = base.join(gone, (F.col("text_hash") == F.col("r_hash")) & F.col("doc_id").eqNullSafe(F.col("r_id")), "left")
    rest = let(without_lines(F.col("text"), F.col("gone")), lambda t: F.struct(t.alias("text"), F.size(words(t)).cast("long").alias("n")))
    whole = F.struct(F.col("text"), F.col("n_words").alias("n"))
    out = out.withColumn("left", F.when(F.col("gone").isNull(), whole).otherwise(rest))
    removed, left = F.col("n_words") - F.col("left.n"), F.col("left.n")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    depleted = left < F.greatest(F.lit(float(MIN_WORDS)), F.col("n_words") * min_kept)
    counts = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select(*counts, removed.alias("removed_words"), failed.alias("base_failed"), (~failed & ~((removed > 0) & depleted)).alias("kept"), F.col("left.text").alias("clean_text"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("clean_text")
