"""The queue as a stream: closed segments are staged as they come, each once.

`foreachBatch` may run a batch again after a failure; what a batch stages is keyed by segment hash and left out if it is
queued or drained already, so a repeated batch adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from worklore.functions.redact import redact_column
from worklore.operators.segments import segment_hash
from worklore.plans.pipeline import QUEUED, read_state


def stage_batch(closed: DataFrame, home: str, payload: Callable[[DataFrame], DataFrame]) -> int:
    """Queue closed(session_id, start_turn, end_turn, started_at, …); payload adds anchors and the rendered prompt, given
    the segments with their hash. Rows that can't be redacted are not queued."""
    spark = closed.sparkSession
    new = closed.withColumn("hash", segment_hash()).dropDuplicates(["hash"])
    known = read_state(spark, f"{home}/pending", QUEUED).select("hash").unionByName(read_state(spark, f"{home}/drained", "hash string"))
    ready = redact_column(payload(new.join(known, "hash", "left_anti")), "prompt").df
    ready = ready.select("hash", "session_id", "start_turn", "end_turn", "started_at", "anchors", "prompt")
    ready.write.mode("overwrite").parquet(f"{home}/work/stream")
    staged = spark.read.parquet(f"{home}/work/stream")
    n = staged.count()
    if n:
        staged.write.mode("append").json(f"{home}/pending")
    return n


def stage_stream(closed: DataFrame, home: str, payload: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Run `stage_batch` over a stream of closed segments until its input is used up."""
    return closed.writeStream.foreachBatch(lambda df, _: stage_batch(df, home, payload)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def plain_payload(segs: DataFrame) -> DataFrame:
    """A payload from what a stream's segments hold: their files as anchors, and a prompt that lists them."""
    none = F.array().cast("array<string>")
    a = F.struct(F.col("files").alias("files"), none.alias("routes"), none.alias("symbols"), none.alias("settings"), F.lit(None).cast("string").alias("branch"), F.lit(None).cast("string").alias("issue"), none.alias("commits"), F.lit(None).cast("string").alias("head_sha"))
    return segs.withColumn("anchors", a).withColumn("prompt", F.concat_ws(" ", F.lit("turns on"), F.array_join("files", ", ")))
