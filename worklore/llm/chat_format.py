"""Chat formatting by event-sourced reconstruction.

A log holds events (conv_id, seq, kind, msg_id, role, text), and may number those of one seq by a column `step`: `message` opens a message, `delta` appends to it, `edit`
replaces its text, `regenerate` empties it for the deltas that follow. Events are folded by message, in order of seq;
messages are rendered one by one and stay rows, so that no task holds a conversation's whole text. Consumers read them
in order within hash partitions of conv_id, as a stream.

Template: `<s>[NAME] text [/NAME]</s>`, NAME being INST for user, OUT for assistant, SYS for system, and ROLE:name for
others. Within texts and names a backslash is doubled, and one is put into whatever could be read as a mark.

Edge cases: null text and null roles are empty; rows of one turn are put in order of role and text; repeated rows are
turns of their own; null conv_id is a conversation; an empty log gives no messages. Deltas without a message get the
role of their first event with one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from worklore.llm.common import fanout, table

NAMES = {"user": "INST", "assistant": "OUT", "system": "SYS"}
MARKS = r"([<\[])(?=/?(?:s>|INST|OUT|SYS|ROLE))"


def events_of(conversations: DataFrame) -> DataFrame:
    """Turns as a log, of which the fold makes the same turns again: an assistant's message comes as a draft, is generated
    anew, and streams in two deltas; others come as a draft and are then edited. A row's message id is its place, role and
    text's hash, numbered among equal rows."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = conversations.select("conv_id", F.col("turn").alias("seq"), role.alias("role"), text.alias("text"), F.xxhash64(text).alias("h"))
    nth = F.row_number().over(Window.partitionBy("conv_id", "seq", "role", "h").orderBy(F.lit(1)))
    msg_id = F.concat_ws(":", F.coalesce(F.col("seq").cast("string"), F.lit("")), "role", "h", nth)
    cut = F.floor(F.length("text") / 2).cast("int")
    event = lambda kind, text, step: F.struct(F.lit(kind).alias("kind"), text.alias("text"), F.lit(step).alias("step"))
    head, tail, none = F.substr("text", F.lit(1), F.col("cut")), F.substr("text", F.col("cut") + 1), F.lit("")
    streamed = F.array(event("message", head, 0), event("regenerate", none, 1), event("delta", head, 2), event("delta", tail, 3))
    edited = F.array(event("message", head, 0), event("edit", F.col("text"), 1))
    told = rows.withColumn("msg_id", msg_id).withColumn("cut", cut).withColumn("e", F.explode(F.when(F.col("role") == "assistant", streamed).otherwise(edited)))
    return told.select("conv_id", "seq", F.col("e.step").alias("step"), F.col("e.kind").alias("kind"), "msg_id", "role", F.col("e.text").alias("text"))


def reconstruct(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, seq, role, text). Events without msg_id are messages as they stand; others are folded
    by (conv_id, msg_id), a group no larger than one message's own history, in order of seq and, if there is one, step."""
    step = F.col("step") if "step" in events.columns else F.lit(0)
    e = events.select("conv_id", "seq", step.alias("step"), "kind", "msg_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    alone = e.where("msg_id is null").select("conv_id", "seq", "role", "text")
    log = e.where("msg_id is not null").groupBy("conv_id", "msg_id").agg(F.sort_array(F.collect_list(F.struct("seq", "step", "kind", "role", "text"))).alias("log"))
    fold = lambda acc, x: F.when(x["kind"] == "delta", F.concat(acc, x["text"])).when(x["kind"] == "regenerate", F.lit("")).otherwise(x["text"])
    role = F.coalesce(F.get(F.filter("log", lambda x: x["role"] != ""), F.lit(0))["role"], F.lit(""))
    folded = log.select("conv_id", F.get("log", F.lit(0))["seq"].alias("seq"), role.alias("role"), F.aggregate("log", F.lit(""), fold).alias("text"))
    return alone.unionByName(folded)


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), MARKS, "$1\\\\")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, seq, rendered, loss_start, loss_end): each message as its template has it, and the span of `rendered`
    under the loss mask, which is an assistant's text and empty for others."""
    name = F.concat(F.lit("ROLE:"), F.regexp_replace(escape(F.col("role")), r"([\]\[])", "\\\\$1"))
    for role, known in NAMES.items():
        name = F.when(F.col("role") == role, known).otherwise(name)
    body = escape(F.col("text"))
    m = messages.withColumn("_name", name).withColumn("_body", body)
    start = F.length("_name") + 6
    return m.select(
        "conv_id", "seq", "role", "text",
        F.concat(F.lit("<s>["), "_name", F.lit("] "), "_body", F.lit(" [/"), "_name", F.lit("]</s>")).alias("rendered"),
        start.cast("long").alias("loss_start"),
        F.when(F.col("role") == "assistant", start + F.length("_body")).otherwise(start).cast("long").alias("loss_end"),
    )


PIECE = re.compile(r"<s>\[(INST|OUT|SYS|ROLE:(?:\\.|[^\]\\])*)\] (.*) \[/\1\]</s>", re.DOTALL)
ROLES = {v: k for k, v in NAMES.items()}


def parse(rendered: str) -> tuple[str, str]:
    """(role, text) of a rendered message."""
    name, body = PIECE.fullmatch(rendered).groups()
    return ROLES[name] if name in ROLES else unescape(name.removeprefix("ROLE:")), unescape(body)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by conv_id and place; only the digests of one conversation are held."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    at, out = None, []

    def done() -> None:
        conv, n, turns, loss_n, loss, chars = at
        out.append((conv, n, turns.hexdigest(), loss_n, loss.hexdigest(), chars))

    for batch in batches:
        for conv, rendered, a, b in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if at is None or at[0] != conv:
                if at:
                    done()
                at = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, text = parse(rendered)
            loss = unescape(rendered[a:b])
            at[1] += 1
            at[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            at[3] += len(loss)
            at[4].update(loss.encode("utf-8", "surrogatepass"))
            at[5] += len(rendered)
        if len(out) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
            out.clear()
    if at:
        done()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    pieces = render(reconstruct(events_of(rows.unionByName(extra))))
    order = pieces.repartition(fanout(rows), "conv_id").sortWithinPartitions("conv_id", "seq", "role", "text")
    return order.select("conv_id", "rendered", "loss_start", "loss_end").mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
