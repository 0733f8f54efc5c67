"""What the corpus operators share: input tables, the shared work folder, native text helpers."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worklore.sources.tables import dealt, read_table, shared_dir

SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return dealt(read_table(spark, sf_dir, name))


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there, columns stay prunable, and a lost
    executor loses nothing. The driver's return value still names the folder for `drop_written`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/worklore/{tag}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._worklore_path = path
    return out


def drop_written(df: DataFrame) -> None:
    """Delete a table made by `written`, once nothing that is still to run reads it."""
    path = getattr(df, "_worklore_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def let_go(spark: SparkSession) -> None:
    """Between rounds of many joins: the driver forgets broadcast tables that no plan needs any more, of which executors hold
    a page of tens of MB each, however few their rows; then executors collect their garbage and give the room back to the
    system, which else only a nearly full heap makes them do. As many tasks as cores reach each executor."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')").alias("done")).write.format("noop").mode("overwrite").save()


def reread(docs: DataFrame) -> DataFrame:
    """A table that is read several times: one of as many files as cores is left as it lies; another small one is dealt over
    all cores and written, so that it is exchanged once and not for each reading."""
    if len(docs.inputFiles()) >= docs.sparkSession.sparkContext.defaultParallelism:
        return docs
    spread = dealt(docs)
    return docs if spread is docs else written(spread, "dealt")


def input_bytes(df: DataFrame) -> int:
    """Catalyst's sizes of the tables that a plan reads, for choosing partition counts; 0 where no size is known."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(s for s in sizes if s < 1 << 60)


def fanout(df: DataFrame, bytes_each: int = 8 << 20) -> int:
    """How many partitions for an exchange: in proportion to the input, never fewer than the session's setting."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(n, -(-input_bytes(df) // bytes_each))


SMALL_ROWS = 500_000


def held_small(df: DataFrame) -> DataFrame:
    """A table of ids, to be sent whole to a join's other side if it has no more than SMALL_ROWS rows; beyond, both sides
    are exchanged."""
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


def fresh_name(columns: list[str], name: str) -> str:
    """A column name that isn't among these."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and hand it to `body`; optimizer rules cannot copy it into the body."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """The maximal runs of characters other than ASCII white space."""
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda acc, x: acc + x.cast("long"))


def prefix_sums(a: Column, chunk: int = 64) -> Column:
    """Exclusive running sums of an int array, in blocks, so that long arrays don't cost the square of their size."""
    empty = F.array().cast("array<long>")

    def run(a):
        n = F.size(a)
        blocks = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / chunk).cast("int"))).otherwise(F.array().cast("array<int>"))
        sums = F.transform(blocks, lambda b: total(F.slice(a, b * chunk + 1, F.lit(chunk))))
        bases = F.aggregate(
            sums,
            F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out")),
            lambda acc, s: F.struct((acc["at"] + s).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
        )["out"]
        return let(bases, lambda base: F.transform(a, lambda x, i: F.get(base, F.floor(i / chunk).cast("int")) + total(F.slice(a, (F.floor(i / chunk) * chunk + 1).cast("int"), (i % chunk).cast("int")))))

    return let(a, run)


def matches(text: Column, pattern: str, guard: Column | None = None) -> Column:
    """array<struct<start,end,match>> of a pattern's leftmost non-overlapping matches, offsets in code points."""
    none = F.array().cast("array<struct<start:bigint,end:bigint,match:string>>")

    def place(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        steps = let(gaps, lambda g: F.transform(found, lambda m, i: F.length(F.get(g, i)) + F.length(m)))
        lengths = F.transform(found, lambda m: F.length(m))
        return let(
            F.zip_with(prefix_sums(steps), F.arrays_zip(steps.alias("s"), found.alias("m")), lambda at, x: F.struct((at + x["s"]).alias("end"), x["m"].alias("match"))),
            lambda ends: F.zip_with(ends, lengths, lambda e, n: F.struct((e["end"] - n).alias("start"), e["end"].alias("end"), e["match"].alias("match"))),
        )

    every = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, place(m)).otherwise(none))
    return every if guard is None else F.when(guard, every).otherwise(none)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
