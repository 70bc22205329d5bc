"""Sharding by a two-pass external shuffle, in DataFrame functions only.

Pass 1 scatters the rows uniformly into memory-sized buckets by a seeded hash of their key. Pass 2
puts a bucket's rows into a fixed order, shuffles them there (Spark's array shuffle is a
Fisher-Yates shuffle, seeded) and writes them one bucket after the other: a row's place in the
whole is its bucket's offset plus its place in the bucket, and shard s holds the places from
s*n/shards to (s+1)*n/shards. So the law is `rows`: the counts of two shards differ by one at most.

The buckets are as many as the bytes need (bucket_bytes each), so that a task holds one bucket and
neither a hot source nor a group of equal texts changes their sizes. Offsets are two-level prefix
sums over the bucket counts.

Defined cases: a null text has no bytes; a null key is a key like others; rows with equal keys
share a bucket and keep separate slots; an empty table has no buckets; other columns are kept, and
shard and slot get a trailing underscore where the table has such columns already.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hilandera.llm.common import free_name, lean_writes, new_folder, prefix_sums, table

SEED = 6
SHARDS = 40
#: Bytes of rows in a bucket; an array of them must fit in a task's memory a few times over.
BUCKET_BYTES = 8 << 20
#: Partitions of the second pass at most; a partition then holds several buckets, one at a time.
MAX_PARTITIONS = 20_000
#: The table of offsets (a row a bucket) is broadcast up to this many buckets. Beyond, rows keep their
#: places, but the partitions no longer follow one another in the order of places.
BROADCAST_BUCKETS = 1_000_000


def byte_size(text: str = "text") -> Column:
    """UTF-8 bytes of the text (null: none) plus 16 for the record's other fields."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def shuffled(rows: DataFrame, key: str, n_rows: int, n_bytes: int, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """rows with shard (int, 0 to shards-1) and slot (long, gapless from 0 in each shard).

    n_rows, n_bytes: the table's counts, which decide the number of buckets.
    """
    if not n_rows:
        return rows.withColumn(free_name(rows, "shard"), F.lit(0)).withColumn(free_name(rows, "slot"), F.lit(0).cast("long"))
    n_buckets = max(1, math.ceil(n_bytes / bucket_bytes))
    bucket, order = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(n_buckets)), F.xxhash64(F.lit(seed + 1), F.col(key))
    counts = rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    offsets = prefix_sums(counts, "bucket", "n", "offset").drop("n")
    offsets = F.broadcast(offsets) if n_buckets <= BROADCAST_BUCKETS else offsets
    n_parts = min(n_buckets, MAX_PARTITIONS)
    # partitions are runs of buckets, in order
    part = F.floor(bucket * F.lit(n_parts) / F.lit(n_buckets)).cast("int")
    dealt = rows.select(bucket.alias("bucket"), part.alias("part"), F.struct(order.alias("order"), F.struct(*(F.col(c) for c in rows.columns)).alias("row")).alias("item"))
    held = (
        dealt.repartitionById(n_parts, "part")
        .groupBy("part", "bucket")
        .agg(F.sort_array(F.collect_list("item")).alias("items"))
        .sortWithinPartitions("bucket")
        .select("bucket", F.shuffle("items", seed).alias("items"))
    )
    at = F.col("offset") + F.col("pos")
    shard = F.floor(at * shards / n_rows) if n_rows * shards < 1 << 52 else F.expr(f"(offset + pos) * {shards} div {n_rows}")
    placed = held.join(offsets, "bucket").select("offset", F.posexplode("items").alias("pos", "item"))
    first = F.expr(f"(shard * {n_rows}L + {shards - 1}) div {shards}")
    return (
        placed.select("item.row", at.alias("at"), shard.cast("long").alias("shard"))
        .select("row", F.col("shard").cast("int").alias("shard"), (F.col("at") - first).cast("long").alias("slot"))
        .select("row.*", F.col("shard").alias(free_name(rows, "shard")), F.col("slot").alias(free_name(rows, "slot")))
    )


def shard_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Whole documents dealt out to shards; see shuffled()."""
    n = docs.agg(F.count(F.lit(1)).alias("rows"), F.sum(byte_size(text)).alias("bytes")).first()
    return shuffled(docs, key, n["rows"], n["bytes"] or 0, shards, seed, bucket_bytes)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard, its rows in slot order through the numbered files (sharded as
    shuffled() gives it)."""
    with lean_writes(sharded.sparkSession):
        sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def digest(spark, sf_dir: str) -> DataFrame:
    """The documents' shards written to the shared folder; of each written record its size, the crc32
    of its text and where it stands."""
    sharded = shard_documents(table(spark, sf_dir, "documents"))
    write_shards(sharded, path := new_folder(spark, "shards"))
    return spark.read.schema(sharded.schema).parquet(path).select(
        "doc_id", byte_size().alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
