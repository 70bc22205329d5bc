"""What the operators of this folder share: word separators, tables, lineage cuts, prefix sums."""

from __future__ import annotations

import os
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space parts words: space and 0x09 to 0x0D, as bytes.split() has it.
SPACE = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]+"
#: Used where a session names no shared folder, as in tests on one machine.
LOCAL_SHARED = "/tmp/checkpoints/hilandera"
#: Rows of one key beyond which a join splits them.
HOT_ROWS = 1_000_000
#: Small tables are broadcast up to this many rows, joined by shuffle beyond.
BROADCAST_ROWS = 500_000
#: Bytes of an Arrow batch that goes to a Python worker.
ARROW_BYTES = 4 << 20
#: Folders that the operators wrote for their own use, by application.
_WRITTEN: dict[str, list[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not (spark.sparkContext.master or "").startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    os.makedirs(LOCAL_SHARED, exist_ok=True)
    return f"file://{LOCAL_SHARED}"


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint; it survives the loss of executors."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


@contextmanager
def lean_writes(spark: SparkSession):
    """What is written meanwhile leaves no shuffle files behind, and Arrow batches hold some ARROW_BYTES
    (one row at least), so that neither an executor nor its Python workers keep 10,000 long texts at once."""
    settings = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(ARROW_BYTES)}
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def new_folder(spark: SparkSession, label: str) -> str:
    """A name in the shared folder that nothing has yet; clean_up() deletes it."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


def clean_up(spark: SparkSession) -> None:
    """Deletes what the operators have put in the shared folder for their own use. To be called when
    the results of this application's queries have been read or written."""
    for path in _WRITTEN.pop(spark.sparkContext.applicationId, []):
        delete(spark, path)


def stored(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """df written to the shared folder as a table and read back: columns can then be pruned. Files of
    the shuffles that made it are dropped once it is written."""
    return stored_at(df, label, compression)[0]


def stored_at(df: DataFrame, label: str, compression: str = "snappy") -> tuple[DataFrame, str]:
    """The same, and the table's folder, for who deletes it before clean_up() does."""
    path = new_folder(df.sparkSession, label)
    with lean_writes(df.sparkSession):
        df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def join_hot(many: DataFrame, one: DataFrame, on: str, counts: DataFrame | None = None) -> DataFrame:
    """many joined with one, which has a row for each value of `on`.

    Values that more than HOT_ROWS rows of `many` have are split: their rows are dealt by a hash to
    parts of some HOT_ROWS, and one's row goes to each part. There are fewer hot values than rows by
    that factor. counts: on, n (rows of many), where they are known already; `on` must not be null.
    """
    counts = many.groupBy(on).agg(F.count(F.lit(1)).alias("n")) if counts is None else counts
    part, parts = free_name(many, "_part"), free_name(many, "_parts")
    hot = cut(counts.filter(F.col("n") > HOT_ROWS).select(on, F.ceil(F.col("n") / HOT_ROWS).cast("int").alias(parts)))
    n = hot.count()
    if not n:
        return many.join(one, on)
    hot = F.broadcast(hot) if n <= BROADCAST_ROWS else hot
    dealt = many.join(hot, on, "left").withColumn(part, F.pmod(F.xxhash64(*many.columns), F.coalesce(parts, F.lit(1)))).drop(parts)
    each = one.join(hot, on, "left").withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(parts, F.lit(1)).cast("long") - 1))).drop(parts)
    return dealt.join(each, [on, part]).drop(part)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not have."""
    names = {c.lower() for c in df.columns}
    while stem.lower() in names:
        stem += "_"
    return stem


def prefix_sums(counts: DataFrame, index: str, value: str, out: str, group: int = 4096) -> DataFrame:
    """counts with out = the sum of value over all rows of a smaller index.

    Two levels: sums of groups of `group` consecutive indices are summed first, so no task
    gets more than a group's rows or one row for each group.
    """
    g, base = free_name(counts, "_group"), free_name(counts, "_base")
    counts = counts.withColumn(g, F.floor(F.col(index) / group))
    before = Window.orderBy(g).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.groupBy(g).agg(F.sum(value).alias(base))
    bases = bases.withColumn(base, F.coalesce(F.sum(base).over(before), F.lit(0)))
    within = Window.partitionBy(g).orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    return (
        counts.join(bases, g)
        .withColumn(out, F.col(base) + F.coalesce(F.sum(value).over(within), F.lit(0)))
        .drop(g, base)
    )


def most_frequent(counts: DataFrame, n: str, size: int) -> tuple[DataFrame, DataFrame]:
    """The rows of the highest counts, `size` of them at most, and the others.

    The cut lies between two grades of the counts' logarithm (at most 8 * 64 of them), so that no
    sort of the table is needed.
    """
    grade = F.floor(F.log2(n) * 8)
    grades = sorted(((r["grade"], r["rows"]) for r in counts.groupBy(grade.alias("grade")).agg(F.count(F.lit(1)).alias("rows")).collect()), reverse=True)
    total, least = 0, 1 << 40
    for g, rows in grades:
        total += rows
        if total > size:
            break
        least = g
    return counts.filter(grade >= least), counts.filter(grade < least)
