"""The corpus pipeline: language, near duplicates, benchmark leaks, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Rows
with null id pass every stage that keys on ids; nulls in other columns are allowed everywhere. Stages run one after another
on the same executors, so each begins by having them give back what the one before has left (`let_go`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worklore.llm.common import fresh_name, let_go, table, written
from worklore.llm.decontaminate import drop_leaky
from worklore.llm.jaccard_join import one_of_each
from worklore.llm.language_id import UNKNOWN, identify, learn
from worklore.llm.packing import pack
from worklore.llm.secrets import redact_secrets

MIN_LANGUAGE_SCORE = 0.05  # what is like no learned language at all


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters, or unlike every language; fill in a missing lang.

    Null and empty texts have no letters. Every row is judged by its own text, so repeated rows stay or go together, and of
    languages that tie the first by name counts; the score decides alone. Where no row names a language, nothing is learned
    and all go. Long texts are read whole, in parts. Columns pass through whatever their names; an empty table stays
    empty."""
    pred, score = fresh_name(docs.columns, "lang_pred"), fresh_name(docs.columns, "score")
    named = identify(docs, learn(docs.select("doc_id", "text", "lang")), names=(pred, score))
    kept = named.where((F.col(pred) != UNKNOWN) & (F.col(score) >= MIN_LANGUAGE_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", pred)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 over five-word shingles, the one of least id stays.

    Texts that are alike but have one id count as such, of them the one of least hash stays, and of equal rows one;
    unlike texts under one id all stay, and so do rows with null id and texts without words. Columns pass through
    whatever their names; an empty table stays empty."""
    let_go(spark)
    return one_of_each(docs, shingle=5, num=80, den=100)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item, or a copy of one within a fifth of its letters.

    Null and empty texts hold nothing and stay; repeated rows stay or go together; items without letters or digits match
    nothing, and an empty benchmark drops nothing. Columns pass through whatever their names; an empty table stays empty."""
    let_go(spark)
    return drop_leaky(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put each secret's kind in its place; all documents stay, with n_chars as it is then.

    Null texts stay null; rows with one text get the same; of findings that overlap the first counts. Columns pass through
    whatever their names; an empty table stays empty."""
    let_go(spark)
    clean = redact_secrets(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset): all documents in sequences of at most 1024 tokens.

    Null text is empty, and an empty one is its end mark alone; each of repeated rows has pieces of its own; equal sizes are
    packed in input order; other columns are left out; an empty table has no pieces."""
    let_go(spark)
    return pack(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("secrets", secrets), ("packing", packing)]

ORACLE_SQL = None  # tests/llm hold the stages against plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
